"""Repeated deliveries on a stream: the seen ranges of each producer are the state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.dedup import SeenRanges

OUT = "producer string, number bigint, delivery bigint, surplus boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends = (np.frombuffer(x, np.int64).tolist() for x in state.get) if state.exists else ([], [])
    seen = SeenRanges(list(zip(starts, ends, strict=True)))
    b = pd.concat(list(batches)).sort_values("delivery", ignore_index=True)
    b["surplus"] = [not seen.accept(int(n)) for n in b["number"]]
    state.update(tuple(np.array(x, np.int64).tobytes() for x in (seen.starts, seen.ends)))
    yield b[["producer", "number", "delivery", "surplus"]]


def flag_repeated(deliveries: DataFrame, producer: str = "block_number", number: str = "log_index", delivery: str = "delivery_id", span: int = 1 << 16) -> DataFrame:
    """(producer, number, delivery, surplus) of a stream: a number that its producer's ranges cover already is surplus.

    The first delivery to arrive stays; within a micro-batch that is the smallest ``delivery``. State is a few ranges
    per producer and ``span`` numbers, not a row per message. Rows without producer, number or delivery are left out.
    """
    d = deliveries.where(F.col(producer).isNotNull() & F.col(number).isNotNull() & F.col(delivery).isNotNull()).select(
        F.col(producer).cast("string").alias("producer"), F.col(number).cast("bigint").alias("number"), F.col(delivery).cast("bigint").alias("delivery")
    )
    part = F.floor(F.col("number") / F.lit(span)).alias("part")
    return d.select("*", part).groupBy("producer", "part").applyInPandasWithState(
        _step, OUT, "starts binary, ends binary", "append", GroupStateTimeout.NoTimeout
    )
