"""One pass of Python over rows: Arrow in, Arrow out, in slices so that a task holds little of a batch."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows and bytes of input whose output is made at once.
ROWS, BYTES = 2000, 2 << 20


def each(df: DataFrame, keep: list[str], given: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """``keep`` of each row beside each of the tuples that ``make()`` gives for its ``given`` columns; ``schema`` names the tuples' parts.

    ``make`` is called once in a task. Rows come out in order and nothing is shuffled.
    """
    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keep)
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    names = [*keep, *StructType.fromDDL(schema).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            step = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at: list[int] = []
                rows: list[tuple] = []
                for i, args in enumerate(zip(*(part.column(j).to_pylist() for j in range(len(keep), part.num_columns)), strict=True)):
                    got = find(*args)
                    if got:
                        at += [i] * len(got)
                        rows += got
                where = pa.array(at, pa.int64())
                columns = zip(*rows, strict=True) if rows else ((),) * len(types)
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(where) for j in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.select(*keep, *given).mapInArrow(run, ", ".join(x for x in (kept, schema) if x))


def by_key(df: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``key`` and the tuples that ``fold`` makes of each key's rows (without the key, in ``order``).

    Keys are dealt out and sorted once and folded as they pass, many to a batch; a call of Spark for each key would cost more than most of them.
    """
    kept = f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}"
    fields = StructType.fromDDL(kept).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True)

        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        held: list[tuple] = []
        for k, own in itertools.groupby(rows(), lambda r: r[0]):
            held += [(k, *r) for r in fold([r[1:] for r in own])]
            if len(held) >= ROWS:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return df.select(key, *(c for c in df.columns if c != key)).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kept)
