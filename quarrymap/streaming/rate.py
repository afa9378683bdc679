"""A sliding-window rate limit: a hit counts unless its key has ``limit`` counted hits in the last ``seconds``.

Rejected hits don't count, so hits of one key are judged in order, with never more than ``limit`` times held for a key. In a
batch the rows stream through sorted partitions; on a stream each key keeps its times as state, which ends with the window.
Rows without a time are allowed and count for nothing; a null key is a key like any other. Equal times go by ``order``.
"""

from __future__ import annotations

from collections import deque
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

ALLOWED = T.StructField("allowed", T.BooleanType(), False)


def _admit(times: deque, at: int, limit: int, span: int) -> bool:
    while times and at - times[0] >= span:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(at)
    return True


def _judge(batches, limit, span, kept):
    last, times = None, deque()
    for batch in batches:
        allowed = []
        for key, at in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist(), strict=True):
            if key != last:
                last, times = key, deque()
            allowed.append(at is None or _admit(times, at, limit, span))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(allowed, type=pa.bool_())], names=[*kept, "allowed"])


def _typed(df: DataFrame, key: str, time: str) -> DataFrame:
    """``df`` with the key as text that tells null from empty, and the time in microseconds."""
    told = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return df.withColumns({"_key": told, "_at": F.unix_micros(F.col(time).cast("timestamp"))})


def limited(df: DataFrame, key: str, time: str, order: str, limit: int, seconds: int) -> DataFrame:
    """``df`` with ``allowed``, judged in order of time and ``order``. A key is one task's work, in bounded memory."""
    plain = df.drop("allowed")
    rows = _typed(plain, key, time).repartition("_key").sortWithinPartitions("_key", "_at", order)
    judge = partial(_judge, limit=limit, span=seconds * 1_000_000, kept=plain.columns)
    return rows.mapInArrow(judge, T.StructType([*plain.schema.fields, ALLOWED]))


def limited_stream(df: DataFrame, key: str, time: str, order: str, limit: int, seconds: int, delay: str) -> DataFrame:
    """The same for a stream: hits are judged in the order of the batches, and in order of time within each.

    The watermark is ``delay`` behind the newest time: older rows are not returned, and a key's state goes once its window
    is older. Columns of whole numbers that hold nulls pass through as floating point.
    """
    span, plain = seconds * 1_000_000, df.drop("allowed")
    kept = plain.columns

    def judge(_, pieces, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(pieces), ignore_index=True).sort_values(["_at", order], ignore_index=True)
        allowed = [pd.isna(at) or _admit(times, int(at), limit, span) for at in rows["_at"]]
        state.update((list(times),))
        if times:
            state.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[kept].assign(allowed=allowed)

    rows = _typed(plain.withWatermark(time, delay), key, time)
    return rows.groupBy("_key").applyInPandasWithState(judge, T.StructType([*plain.schema.fields, ALLOWED]), "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
