"""Media columns: AVI motion-JPEG.

Writing: a payload's bytes are 8-bit samples, one to an 8x8 block of a grey baseline JPEG frame of
64 blocks a line. The DC quantiser is 8, so a block's DC coefficient is its sample less 128 and
decoding is exact; AC coefficients are zero. The DC table gives category s a code of 9 - s bits, so
every block takes ten bits whatever its value, and packing works on whole arrays. Frames go into a
RIFF file with a header, a movi list and an idx1 index; an INFO entry keeps the payload's length,
since the last frame may be filled up with zeros.

Reading: RIFF chunks are walked, frames found by the index (by the movi list where there is none). Frames
whose blocks all have one length are decoded together; any other baseline frame, grey or colour, with
its own or the standard Huffman tables, is decoded whole (``jpeg``) and its luma taken.

Shots: frames have 16-bin histograms; a cut is where the distance to the frame before exceeds the
mean of the shot's distances so far by three deviations (and a least distance). Clips are rows of
first and last frame with times.

Null and empty texts are one line of 64 zeros. Equal payloads give equal files. Files that cannot be read
have a row with a status and no clip. Long texts are stored whole; columns of the documents named as the
results (any case) give way.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import jpeg
from .bpe import _mapped

LINE = 64
#: Lines of samples in a frame at most, and frames a second.
LINES, RATE = 16, 25
#: A cut needs a histogram distance (0 to 1) of at least this.
LEAST_DISTANCE = 0.1

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Ten bits for each DC difference from -255 to 255: code, its extra bits, and the end of block.
_SYMBOL = np.zeros(511, np.uint64)
for _d in range(-255, 256):
    _s = abs(_d).bit_length()
    _code = (1 << (9 - _s)) - 2  # category 8 is 0, 7 is 10, ... and 0 is 111111110
    _SYMBOL[_d + 255] = (_code << _s | (_d if _d > 0 else _d + (1 << _s) - 1)) << 1

_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
_TABLES = _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def frames_of(samples: np.ndarray) -> list[bytes]:
    """A JPEG file for each row of ``samples`` (frames x samples, in lines of 64)."""
    n = samples.shape[1]
    head = _HEAD + _segment(0xC0, struct.pack(">BHHB", 8, n // LINE * 8, LINE * 8, 1) + b"\x01\x11\x00") + _TABLES
    out = []
    for a in range(0, len(samples), max(1, (1 << 19) // n)):
        part = samples[a : a + max(1, (1 << 19) // n)].astype(np.int16)
        diff = part.copy()
        diff[:, 0] -= 128
        diff[:, 1:] -= part[:, :-1]
        s = _SYMBOL[diff + 255].reshape(len(part), n // 4, 4)
        word = s[..., 0] << np.uint64(30) | s[..., 1] << np.uint64(20) | s[..., 2] << np.uint64(10) | s[..., 3]
        packed = word.astype(">u8").view(np.uint8).reshape(len(part), n // 4, 8)[..., 3:].reshape(len(part), -1)
        out += [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]
    return out


def write(payload: bytes) -> bytes:
    """The AVI file of a payload, whose length is a positive multiple of 64."""
    lines = len(payload) // LINE
    count = -(-lines // LINES)
    height = -(-lines // count)
    samples = np.zeros(count * height * LINE, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    return riff(frames_of(samples.reshape(count, height * LINE)), LINE * 8, height * 8, b"payload %d" % len(payload))


def riff(jpegs: list[bytes], width: int, height: int, subject: bytes = b"") -> bytes:
    """An AVI file of JPEG frames, with an index and ``subject`` in an INFO entry."""
    sizes, count = [len(j) for j in jpegs], len(jpegs)
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, count, 0, 1, max(sizes), width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, count, max(sizes), -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ISBJ", subject + b"\x00"))
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", j) for j in jpegs))
    index, at = [], 4
    for s in sizes:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, s))
        at += 8 + s + s % 2
    return chunk(b"RIFF", b"AVI " + hdrl + info + movi + chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def frame_places(data: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """(start, end) of each frame, microseconds a frame, and the payload's length (-1: not given)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    usec, length, movi, index = 1_000_000 // RATE, -1, None, None
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            usec = next((struct.unpack_from("<I", data, x)[0] for n, x, _ in _chunks(data, a + 4, b) if n == b"avih"), usec)
        elif kind == b"INFO":
            for n, x, y in _chunks(data, a + 4, b):
                if n == b"ISBJ" and data[x:y].startswith(b"payload "):
                    length = int(data[x + 8 : y].rstrip(b"\x00"))
        elif kind == b"movi":
            movi = (a, b)
        elif kind == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [(a, b) for n, a, b in _chunks(data, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")], usec, length
    entries = np.frombuffer(data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16], "<u4").reshape(-1, 4)
    entries = entries[(entries[:, 0] >> 16) == 0x6364]  # ..dc
    # offsets count from the movi list's name, in some files from the file's start
    base = movi[0] if not len(entries) or entries[0, 2] < movi[0] else 0
    return [(base + o + 8, base + o + 8 + s) for o, s in zip(entries[:, 2].tolist(), entries[:, 3].tolist(), strict=True)], usec, length


class Frame:
    """The parsed headers of a grey JPEG frame with tables of its own."""

    def __init__(self, data: bytes):
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        at, self.restart = 2, 0
        self.height = self.width = self.table = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = list(struct.unpack(">64H" if wide else "64B", body[1 : 65 + 64 * wide]))
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, self.height, self.width, parts = struct.unpack(">BHHB", body[:6])
                if parts != 1:
                    raise ValueError("only grey frames are decoded")
                self.table = body[8]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("only baseline frames are decoded")
            elif marker == 0xDA:
                self.dc, self.ac = body[2] >> 4, 16 | body[2] & 15
                break
        self.data = data[at : data.rindex(b"\xff\xd9")]

    def codes(self, which: int) -> list[tuple[int, int, int]]:
        """(code, its length, value) in order."""
        lengths, values = self.huffman[which]
        out, code, i = [], 0, 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                out.append((code, n, values[i]))
                code, i = code + 1, i + 1
            code <<= 1
        return out

    def blocks(self) -> int:
        return -(-self.height // 8) * -(-self.width // 8)


_tables: dict[bytes, tuple[int, np.ndarray] | None] = {}


def _fixed(f: Frame) -> tuple[int, np.ndarray] | None:
    """Bits of a block and the DC difference for each value of them, where all blocks have the same number."""
    key = repr((f.huffman, f.dc, f.ac)).encode()
    if f.dc not in f.huffman or f.ac not in f.huffman or f.table not in f.quant:
        return None
    if key not in _tables:
        dc, ac = f.codes(f.dc), f.codes(f.ac)
        widths = {n + s for _, n, s in dc}
        if len(widths) == 1 and [v for *_, v in ac] == [0] and max(widths) + ac[0][1] == 10 and not f.restart:
            table = np.full(1024, 1 << 14, np.int16)
            for code, n, s in dc:
                for extra in range(1 << s):
                    value = extra if s and extra >> (s - 1) else extra - (1 << s) + 1
                    table[(code << s | extra) << ac[0][1] | ac[0][0]] = value
            _tables[key] = (10, table)
        else:
            _tables[key] = None
    return _tables[key]


def samples_of(jpegs: list[bytes]) -> list[np.ndarray]:
    """The 8-bit samples of frames: a sample for each block of frames as ``write`` makes them, which are decoded
    together, and every sample of the first component (grey or luma) of any others."""
    out: list[np.ndarray] = []
    head, frame = None, None
    group: list[bytes] = []

    def flush() -> None:
        if group:
            raw = np.frombuffer(b"".join(group), np.uint8).reshape(-1, 5)
            word = np.zeros((len(raw), 8), np.uint8)
            word[:, 3:] = raw
            word = word.view(">u8")[:, 0].astype(np.uint64)
            symbol = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).astype(np.int64).reshape(len(group), -1)
            diff = _fixed(frame)[1][symbol].astype(np.int32)
            if (diff == 1 << 14).any():
                raise ValueError("broken code")
            value = np.cumsum(diff, 1)
            got = np.clip((value * frame.quant[frame.table][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
            out.extend(got[:, : frame.blocks()])
            group.clear()

    for j in jpegs:
        if head is None or not j.startswith(head):
            flush()
            frame, head = None, None
            with contextlib.suppress(ValueError, IndexError, struct.error):
                frame, head = Frame(j), j[: j.index(b"\xff\xda") + 10]
        if frame is not None and _fixed(frame) and frame.blocks() % 4 == 0:
            group.append(j[len(head) : -2].replace(b"\xff\x00", b"\xff"))
            if len(group) * frame.blocks() >= 1 << 19:
                flush()
        else:
            flush()
            out.append(jpeg.decode(j)[0].ravel())
    flush()
    return out


def read(data: bytes) -> tuple[np.ndarray | None, list[np.ndarray], int]:
    """The payload (None if its length is not given), the frames' samples, and microseconds a frame."""
    places, usec, length = frame_places(data)
    frames = samples_of([data[a:b].rstrip(b"\x00") if data[b - 1 : b] == b"\x00" else data[a:b] for a, b in places])
    return (np.concatenate(frames)[:length] if length >= 0 and frames else None), frames, usec


def shots(frames: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first, last) frame of each shot, and each frame's histogram as shares."""
    if not frames:
        return [], np.zeros((0, 16))
    size = np.array([len(f) for f in frames])
    flat = np.concatenate(frames)
    hist = np.bincount(np.repeat(np.arange(len(frames)), size) * 16 + (flat >> 4), minlength=16 * len(frames)).reshape(-1, 16) / size[:, None]
    distance = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    for i, d in enumerate(distance.tolist(), 1):
        mean = total / n if n else 0.0
        spread = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        if d > max(LEAST_DISTANCE, mean + 3 * spread) and (n or d > 2 * LEAST_DISTANCE):
            cuts.append(i)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return list(zip(cuts, [*(c - 1 for c in cuts[1:]), len(frames) - 1], strict=True)), hist


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\x00" * (LINE - len(raw) % LINE if len(raw) % LINE or not raw else 0)


def with_media(docs: DataFrame, media: str = "media", text: str = "text") -> DataFrame:
    """``docs`` with the AVI file of each text."""
    return _mapped(docs, text, [(media, T.BinaryType())], lambda: lambda texts: [pa.array([write(payload_of(t)[1]) for t in texts], pa.binary())])


def clips(df: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of ``df`` and a row for each clip of its AVI files: clip, first_frame, last_frame, start_ms, end_ms, status.

    status is ``ok``, or says why a file has no clips, in a row without any: null media, no frames, or what is
    broken or not motion-JPEG of baseline frames. Columns of ``df`` named like the new ones (any case) give way.
    """
    new = ["clip", "first_frame", "last_frame", "start_ms", "end_ms"]
    keep = [f for f in df.schema.fields if f.name != media and f.name.lower() not in (*new, "status")]
    schema = T.StructType(keep + [T.StructField(n, T.LongType()) for n in new] + [T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 64):
                batch, rows = big.slice(a, 64), []
                for i, data in enumerate(batch.column(batch.schema.get_field_index(media))):
                    frames, usec, status = [], 0, "no media"
                    if data.is_valid:
                        try:
                            _, frames, usec = read(data.as_py())
                            status = "ok" if frames else "no frames"
                        except (ValueError, IndexError, KeyError, struct.error) as e:
                            status = f"broken: {e}"
                    if status == "ok":
                        rows += [(i, k, f, n, f * usec // 1000, (n + 1) * usec // 1000, status) for k, (f, n) in enumerate(shots(frames)[0])]
                    else:
                        rows.append((i, None, None, None, None, None, status))
                picked = batch.take(pa.array([r[0] for r in rows], pa.int64()))
                added = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)] + [pa.array([r[6] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([picked.column(picked.schema.get_field_index(f.name)) for f in keep] + added, names=schema.names)

    return df.mapInArrow(run, schema)


DIGEST = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_clips", T.LongType())]


def digest(text: str | None) -> tuple:
    """The values of DIGEST for a text: stored as an AVI file, read back from its bytes, and cut into clips."""
    n, payload = payload_of(text)
    media = write(payload)
    back, frames, _ = read(media)
    back = back.tobytes()
    cut, hist = shots(frames)
    feature = "cuts " + " ".join(str(a) for a, _ in cut) + "; histogram " + " ".join(str(int(x)) for x in np.floor(hist.mean(0) * 1000 + 0.5))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(cut)


def with_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of DIGEST."""

    def make():
        kinds = [pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in DIGEST]
        return lambda texts: [pa.array(c, k) for c, k in zip(zip(*map(digest, texts), strict=True), kinds, strict=True)]

    return _mapped(docs, text, DIGEST, make)
