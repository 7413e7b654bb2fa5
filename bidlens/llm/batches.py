"""Arrow batches as byte arrays, and word hashes over them; shared by the text operators.

A text column arrives as one UTF-8 buffer and its row offsets. Work goes through it in
chunks of about ``CHUNK_BYTES`` (a longer text is a chunk of its own), so memory is
bounded by the longest text and not by the batch.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20

#: White space of a word rule: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240501)
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, kept for the life of the worker."""
    if len(_powers.get("up", ())) < max(n, 1):
        size = max(n, 2 * CHUNK_BYTES)
        for name, base in (("up", BASE), ("down", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes."""
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it (one entry more than rows).

    A word is a run of bytes for which ``is_word`` holds (default: no white space) and never spans rows.
    """
    n = len(data)
    inside = ~SPACE[data] if is_word is None else is_word
    edge = offs[:-1][offs[:-1] < n]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last[:-1] &= ~inside[1:]
    tail = offs[1:][offs[1:] > 0] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(lower: np.ndarray) -> np.ndarray:
    """Running sums of keyed bytes times powers; differences of two, scaled, hash any substring."""
    out = np.zeros(len(lower) + 1, np.uint64)
    np.cumsum(BYTE_KEY[lower] * powers(len(lower))[0], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it where ``df`` has such a column (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable], text: str = "text") -> DataFrame:
    """``df`` with columns computed from its text column.

    ``make()`` runs once in a worker and gives a function from (bytes, offsets) of a chunk
    to a list of arrays, one for each field. Columns of the same name (any case) give way.
    """
    lean(df.sparkSession)
    names = {n.lower() for n, _ in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names or f.name == text]
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in fields])
    column = next(f.name for f in df.schema.fields if f.name.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            if not batch.num_rows:
                continue
            parts = [f(b, o) for _, _, b, o in chunks(*column_bytes(batch.column(at)))]
            arrays = list(batch.columns)
            out = [arrays[batch.schema.get_field_index(k.name)] for k in keep]
            for i in range(len(fields)):
                got = [p[i] if isinstance(p[i], pa.Array) else pa.array(p[i]) for p in parts]
                out.append(pa.concat_arrays(got))
            yield pa.RecordBatch.from_arrays(out, names=[x.name for x in schema.fields])

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place all executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; on a cluster it is an error, as
    what an executor writes to a disk of its own would be lost to the others.
    """
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.gettempdir() + "/bidlens-shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch at most, so that a task's copies of it (both ways, in both processes) stay small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def lean(spark: SparkSession) -> None:
    """Lower the session's batch limits to BATCH where they are above it."""
    for key, most in BATCH.items():
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


_scratch: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    lean(spark)
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    for tables in _scratch[-1:]:
        tables.append(out)
    return out


def remove(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, if it did; later uses of it fail."""
    spark, path = df.sparkSession, getattr(df, "_folder", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settled(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` with its result written to the shared folder, and all that it wrote on the way deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _scratch.append([])
        try:
            df = f(*args, **kwargs)
            _scratch.append([])  # the result is no scratch table
            try:
                return written(df, f.__name__)
            finally:
                _scratch.pop()
        finally:
            for table in _scratch.pop():
                remove(table)

    return run
