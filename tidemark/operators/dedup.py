"""Messages delivered more than once: exactly one delivery of each stays."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


class SeenRanges:
    """Disjoint closed ranges of the numbers already accepted, merged as they touch."""

    __slots__ = ("starts", "ends")

    def __init__(self, ranges: list[tuple[int, int]] | None = None) -> None:
        self.starts = [a for a, _ in ranges or []]
        self.ends = [b for _, b in ranges or []]

    def accept(self, n: int) -> bool:
        """True, and ``n`` is covered from now on, if no range covered it before."""
        starts, ends = self.starts, self.ends
        i = bisect_right(starts, n)
        if i and ends[i - 1] >= n:
            return False
        left, right = bool(i) and ends[i - 1] == n - 1, i < len(starts) and starts[i] == n + 1
        if left and right:
            ends[i - 1] = ends[i]
            del starts[i], ends[i]
        elif left:
            ends[i - 1] = n
        elif right:
            starts[i] = n
        else:
            starts.insert(i, n)
            ends.insert(i, n)
        return True

    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))


def hash_number(c: Column | str) -> Column:
    """A 32-byte number written in hex, in one spelling (64 lower-case digits); NULL if it is none.

    Blanks around it, an ``0x`` prefix, case and leading zeros don't matter.
    """
    c = F.col(c) if isinstance(c, str) else c
    digits = F.ltrim(F.regexp_extract(F.lower(c), r"^\s*(?:0x)?([0-9a-f]+)\s*$", 1), F.lit("0"))
    readable = F.lower(c).rlike(r"^\s*(?:0x)?[0-9a-f]+\s*$")
    return F.when(readable & (F.length(digits) <= 64), F.lpad(digits, 64, "0"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by producer and delivery: flags those whose number the producer's ranges already cover."""
    producer, seen = None, SeenRanges()
    for batch in batches:
        p, n, was = (batch.column(i).to_pylist() for i in (0, 1, 3))
        flags = []
        for who, number, surplus in zip(p, n, was, strict=True):
            if surplus:
                flags.append(True)
                continue
            if who != producer:
                producer, seen = who, SeenRanges()
            flags.append(not seen.accept(number))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(flags, pa.bool_())],
            names=["producer", "number", "delivery", "surplus"],
        )


def surplus_deliveries(
    deliveries: DataFrame,
    delivery: str = "delivery_id",
    producer: str = "block_number",
    number: str = "log_index",
    message_hash: str = "tx_hash",
    span: int = 1 << 16,
) -> DataFrame:
    """The deliveries (column ``delivery``) beyond the first of each message, in the order of ``delivery``.

    A message is the ``number`` that a ``producer`` gave it. Per producer, disjoint ranges of the numbers already
    seen are kept: a delivery whose number no range covers is accepted and extends them, any other is surplus.
    Identifiers without a producer are malformed: their (``message_hash``, ``number``) is looked up by exact key
    among the deliveries that have both; those that are found take that producer, the others form messages of their
    own per (hash, number). A delivery without number, or with neither producer nor hash, can't be told from any
    other and is never surplus. A NULL ``delivery`` is no delivery. Repeated rows (one delivery id twice) are one
    delivery each. Other columns don't matter; an empty table gives an empty result.

    Numbers are grouped by producer and ``span`` numbers, so a producer that holds a third of all rows is split.
    A first pass over each input partition drops what is surplus there already (its rows then go to tasks at
    random), so one message delivered very often sends at most one row per partition to the task that decides.
    """
    hashed = hash_number(message_hash)
    d = deliveries.where(F.col(delivery).isNotNull() & F.col(number).isNotNull()).select(
        F.col(producer).cast("bigint").alias("_p"),
        F.col(number).cast("bigint").alias("_n"),
        F.col(delivery).cast("bigint").alias("_d"),
        hashed.alias("_h"),
    )
    sequenced = d.where(F.col("_p").isNotNull()).select(
        F.concat_ws(":", F.lit("p"), F.col("_p").cast("string")).alias("who"), "_n", "_d"
    )
    malformed = d.where(F.col("_p").isNull() & F.col("_h").isNotNull()).select("_h", "_n", "_d")
    # exact keyed lookup, only of the keys that need one; where there is none, nothing of the rest is shuffled for it
    known = (
        d.where(malformed.select(F.lit(1)).exists())
        .where(F.col("_p").isNotNull() & F.col("_h").isNotNull())
        .join(malformed.select("_h", "_n").distinct(), ["_h", "_n"], "left_semi")
        .groupBy("_h", "_n")
        .agg(F.min("_p").alias("_found"))
    )
    looked_up = malformed.join(known, ["_h", "_n"], "left").select(
        F.when(F.col("_found").isNotNull(), F.concat_ws(":", F.lit("p"), F.col("_found").cast("string")))
        .otherwise(F.concat_ws(":", F.lit("h"), F.col("_h")))
        .alias("who"),
        "_n",
        "_d",
    )
    return _surplus(sequenced.unionByName(looked_up), delivery, span)


def _surplus(sequenced: DataFrame, delivery: str, span: int) -> DataFrame:
    schema = "producer string, number bigint, delivery bigint, surplus boolean"
    key = F.concat_ws("/", F.col("who"), F.floor(F.col("_n") / F.lit(span)).cast("string"))
    rows = sequenced.select(
        key.alias("producer"), F.col("_n").alias("number"), F.col("_d").alias("delivery"), F.lit(False).alias("surplus")
    )
    local = rows.sortWithinPartitions("producer", "delivery").mapInArrow(_mark, schema)
    to = F.when(F.col("surplus"), F.concat(F.lit("~"), F.xxhash64("delivery").cast("string"))).otherwise(F.col("producer"))
    final = (
        local.withColumn("to", to)
        .repartition("to")
        .drop("to")
        .sortWithinPartitions("producer", "delivery")
        .mapInArrow(_mark, schema)
    )
    return final.where("surplus").select(F.col("delivery").alias(delivery))


def first_deliveries(deliveries: DataFrame, delivery: str = "delivery_id", **how: object) -> DataFrame:
    """All columns of the deliveries that stay; see :func:`surplus_deliveries`."""
    surplus = written(surplus_deliveries(deliveries, delivery, **how), "surplus")
    return deliveries.join(surplus, delivery, "left_anti")
