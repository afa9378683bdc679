"""Row-wise Python operators over Arrow batches, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handled at a time; their texts and results are all that a worker holds beside the incoming batch.
ROWS = 256
#: As many rows as a batch has.
BATCH = 1 << 30


def _run(batches, function, inputs, outputs, kept, arrow_inputs, rows):
    arrow = to_arrow_schema(T.StructType(outputs))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            made = function(*(part.column(name) if arrow_inputs else part.column(name).to_pylist() for name in inputs))
            columns = [part.column(name) for name in kept]
            columns += [pa.array(values, type=field.type) for values, field in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *arrow.names])


def with_python(df: DataFrame, function: Callable[..., Sequence[list]], inputs: list[str], outputs: list[T.StructField], drop: Sequence[str] = (), arrow: bool = False, rows: int = ROWS) -> DataFrame:
    """``df`` with the columns ``outputs``, which ``function`` makes from lists of the columns ``inputs``,
    or from their Arrow arrays if ``arrow`` is set; of at most ``rows`` rows at a time.

    A column of the same name is replaced; those in ``drop`` are not returned.
    """
    names = {field.name for field in outputs}
    kept = [field for field in df.schema.fields if field.name not in names and field.name not in drop]
    needed = [*dict.fromkeys([*(field.name for field in kept), *inputs])]
    run = partial(_run, function=function, inputs=inputs, outputs=outputs, kept=[field.name for field in kept], arrow_inputs=arrow, rows=rows)
    return df.select([df[f"`{name}`"] for name in needed]).mapInArrow(run, T.StructType([*kept, *outputs]))


def held_in_turn(sent: Sequence[Broadcast]) -> Iterator:
    """The values of broadcasts, one after the other. Each is let go before the next is loaded, and the last one, too: a worker
    that goes on to other stages holds none of them."""
    for block in sent:
        yield block.value
        vars(block).pop("_value", None)


def _run_blocks(batches, function, sent, schema):
    arrow = to_arrow_schema(schema)
    for batch in batches:
        texts = batch.column(0)
        for block in held_in_turn(sent):
            for at in range(0, batch.num_rows, ROWS):
                made = function(texts.slice(at, ROWS).to_pylist(), block)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)


def with_blocks(df: DataFrame, sent: Sequence[Broadcast], function: Callable[..., Sequence[list]], schema: T.StructType) -> DataFrame:
    """The rows that ``function`` makes from lists of the one column of ``df`` and each of the broadcasts in turn."""
    return df.mapInArrow(partial(_run_blocks, function=function, sent=sent, schema=schema), schema)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in batches that are sorted by it."""
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        if held:
            piece = pa.concat_tables([*held, piece])
        change = np.zeros(piece.num_rows, dtype=bool)
        for name in key:
            values = piece.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield piece.slice(a, b - a)
        held = [piece.slice(starts[-1])]
    if held:
        yield held[0]
