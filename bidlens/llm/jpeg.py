"""Baseline JPEG frames as motion-JPEG files hold them: one or more components, any sampling, restarts.

Frames may lack Huffman tables; the standard ones hold then. Each component is returned as a plane
of samples at its own size; colours are not converted.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np

#: The standard Huffman tables of JPEG (Annex K), codes of each length and their symbols, by table class and number.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728"
        "292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a83848586878889"
        "8a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2"
        "e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a26"
        "2728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a828384858687"
        "88898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}

#: Zigzag order of an 8x8 block, by its rule: diagonals in turn, up and down by turns.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]

_x = np.arange(8)
_BASIS = np.cos((2 * _x[:, None] + 1) * _x[None, :] * np.pi / 16) * np.where(_x == 0, np.sqrt(1 / 8), 0.5)  # sample by frequency


@cache
def lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the first code's length and symbol (length << 8 | symbol), 0 where there is none."""
    out, code, i = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            if i >= len(symbols) or code >= 1 << n:
                raise ValueError("broken Huffman table")
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out.tolist()


class _Bits:
    """The bits of an entropy-coded part; past its end come ones, as the standard has it."""

    def __init__(self, part: bytes):
        raw = part.replace(b"\xff\x00", b"\xff")
        self.size = 8 * len(raw)
        self.raw, self.at = raw + b"\xff" * 8, 0

    def peek(self) -> int:
        """The next 16 bits."""
        i, off = self.at >> 3, self.at & 7
        return (int.from_bytes(self.raw[i : i + 3], "big") >> (8 - off)) & 0xFFFF

    def symbol(self, table: list[int]) -> int:
        got = table[self.peek()]
        if not got or self.at > self.size:
            raise ValueError("broken code")
        self.at += got >> 8
        return got & 255

    def extra(self, n: int) -> int:
        """A value of n bits, negative where the first is 0."""
        if not n:
            return 0
        if n > 15:
            raise ValueError("broken code")
        v = self.peek() >> (16 - n)
        self.at += n
        return v if v >> (n - 1) else v - (1 << n) + 1


class _Part:
    """A component: sampling, tables, and its coefficients by block."""

    def __init__(self, h: int, v: int, quant: int):
        if not (1 <= h <= 4 and 1 <= v <= 4):
            raise ValueError("broken sampling")
        self.h, self.v, self.quant = h, v, quant
        self.wide = self.high = self.rows = self.columns = 0
        self.blocks = np.zeros((0, 0, 64), np.int32)
        self.dc = self.ac = 0


def _scan(data: bytes, parts: list[_Part], mcus: tuple[int, int], restart: int, tables: dict[int, list[int]]) -> None:
    pieces = re.split(rb"\xff[\xd0-\xd7]", data)
    alone = len(parts) == 1
    across, down = (parts[0].columns, parts[0].rows) if alone else mcus
    total, done = across * down, 0
    for piece in pieces:
        bits, last = _Bits(piece), [0] * len(parts)
        for unit in range(done, min(total, done + (restart or total))):
            y, x = divmod(unit, across)
            for k, p in enumerate(parts):
                dc, ac = tables[p.dc], tables[16 | p.ac]
                for b in range(1 if alone else p.h * p.v):
                    block = p.blocks[y, x] if alone else p.blocks[y * p.v + b // p.h, x * p.h + b % p.h]
                    last[k] += bits.extra(bits.symbol(dc))
                    block[0] = last[k]
                    i = 1
                    while i < 64:
                        rs = bits.symbol(ac)
                        if rs & 15 == 0:
                            if rs != 0xF0:
                                break
                            i += 16
                            continue
                        i += rs >> 4
                        if i > 63:
                            raise ValueError("broken code")
                        block[ZIGZAG[i]] = bits.extra(rs & 15)
                        i += 1
            done = unit + 1
    if done < total:
        raise ValueError("a frame is cut off")


def decode(data: bytes) -> list[np.ndarray]:
    """The planes of a frame's components, 8-bit samples; ValueError for what is no whole baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    huffman = {k: lookup(bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in STANDARD.items()}
    parts: dict[int, _Part] = {}
    at, restart, mcus, seen = 2, 0, (0, 0), set()
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.zeros(64, np.int64)
                q[ZIGZAG] = struct.unpack(">64H" if wide else "64B", body[1 : 65 + 64 * wide])
                quant[body[0] & 15] = q
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not high or not wide or not n:
                raise ValueError("only 8-bit frames of a stated size are decoded")
            parts = {body[6 + 3 * i]: _Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            h, v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            mcus = (-(-wide // (8 * h)), -(-high // (8 * v)))
            for p in parts.values():
                p.wide, p.high = -(-wide * p.h // h), -(-high * p.v // v)
                p.columns, p.rows = -(-p.wide // 8), -(-p.high // 8)
                p.blocks = np.zeros((mcus[1] * p.v, mcus[0] * p.h, 64), np.int32)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            chosen = []
            for i in range(body[0]):
                p = parts[body[1 + 2 * i]]
                p.dc, p.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                chosen.append(p)
                seen.add(body[1 + 2 * i])
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            stop = end.start() if end else len(data)
            _scan(data[at:stop], chosen, mcus, restart, huffman)
            at = stop
    if not parts or seen != set(parts):
        raise ValueError("a frame without all its scans")
    out = []
    for p in parts.values():
        f = (p.blocks * quant[p.quant]).reshape(*p.blocks.shape[:2], 8, 8)
        s = np.clip(np.floor(np.einsum("yv,abvu,xu->abyx", _BASIS, f, _BASIS, optimize=True) + 128.5), 0, 255).astype(np.uint8)
        out.append(s.transpose(0, 2, 1, 3).reshape(8 * s.shape[0], 8 * s.shape[1])[: p.high, : p.wide])
    return out
