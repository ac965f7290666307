"""Attributes as known at event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_known(
    events: DataFrame,
    changes: DataFrame,
    entity: str,
    at: tuple[str, str],
    effective: tuple[str, str],
    known: str,
    carry: Sequence[str],
    prefix: str = "known_",
    chunk_width: int = 4096,
) -> DataFrame:
    """Each event with the attributes of its entity that applied at its position and were already known.

    ``at`` names an event's coarse and fine position (a block and a number in it), ``effective`` that from which a
    change applies, ``known`` the coarse position at which it became known. Of the changes with effective position
    not after the event's and known no later than its coarse position, the one with the last effective position
    counts, then the one known last, then the largest ``carry`` values. All columns of ``events`` come out, and
    ``carry`` under ``prefix``; they are NULL for events without such a change, or without entity or position.
    Changes with NULL entity, position or ``known`` never become available. Repeated events stay repeated. Clashing
    column names don't matter.

    A change becomes available at the later of its effective and known positions; known later than effective, at the
    very start of that coarse position. Events and changes are united and sorted by entity and availability, changes
    before events at the same position, and the latest state so far is carried forward. The window covers
    ``chunk_width`` coarse positions of an entity, so an entity with a third of all rows is split; what was known
    before a chunk enters it as one seed row.
    """
    eb, el = (F.col(c).cast("bigint") for c in at)
    cb, cl, ck = F.col(effective[0]).cast("bigint"), F.col(effective[1]).cast("bigint"), F.col(known).cast("bigint")
    chunk = lambda c: F.floor(c / F.lit(chunk_width)).cast("bigint")
    state = F.struct(cb.alias("b"), cl.alias("l"), ck.alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    c = changes.where(F.col(entity).isNotNull() & cb.isNotNull() & cl.isNotNull() & ck.isNotNull()).select(
        F.col(entity).alias("entity"),
        F.greatest(cb, ck).alias("b"),
        F.when(ck > cb, F.lit(-(1 << 62))).otherwise(cl).cast("bigint").alias("l"),
        state.alias("state"),
    )
    row = F.struct(*[F.col(f"`{x}`") for x in events.columns])
    e = events.select(
        F.col(entity).alias("entity"), eb.alias("b"), el.alias("l"), row.alias("event")
    )
    lost = F.col("entity").isNull() | F.col("b").isNull() | F.col("l").isNull()
    e = e.withColumn("chunk", F.when(lost, -1 - F.pmod(F.xxhash64("event"), F.lit(256))).otherwise(chunk(F.col("b"))))
    c = c.withColumn("chunk", chunk(F.col("b")))
    none = F.lit(None).cast(c.schema["state"].dataType)
    # what is known before each chunk that has events
    marks = (
        e.where(~lost).select("entity", "chunk").distinct().select("entity", "chunk", F.lit(True).alias("wanted"), none.alias("state"))
    ).unionByName(c.groupBy("entity", "chunk").agg(F.max("state").alias("state")).withColumn("wanted", F.lit(False)))
    before = Window.partitionBy("entity").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    seeds = (
        marks.withColumn("seed", F.max("state").over(before))
        .where(F.col("wanted") & F.col("seed").isNotNull())
        .select("entity", "chunk", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("l"), F.col("seed").alias("state"), F.lit(0).alias("tie"))
    )
    nothing = F.lit(None).cast(e.schema["event"].dataType)
    rows = (
        e.select("entity", "chunk", "b", "l", none.alias("state"), F.lit(2).alias("tie"), "event")
        .unionByName(c.select("entity", "chunk", "b", "l", "state", F.lit(1).alias("tie"), nothing.alias("event")))
        .unionByName(seeds.withColumn("event", nothing))
    )
    so_far = (
        Window.partitionBy("entity", "chunk")
        .orderBy(F.col("b").asc_nulls_first(), F.col("l").asc_nulls_first(), "tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.withColumn("best", F.max("state").over(so_far)).where("tie = 2")
    got = F.when(~lost, F.col("best"))
    return out.select(
        *[F.col("event").getField(x).alias(x) for x in events.columns],
        *[got.getField(f"c{i}").alias(f"{prefix}{x}") for i, x in enumerate(carry)],
    )
