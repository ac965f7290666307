"""As-of joins, coverage of tolerances and prioritised fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pointintime import as_known


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_us: str, right_us: str, right_id: str, carry: Sequence[str],
    tolerance_us: int, direction: str = "backward", shift_us: int = 0, prefix: str = "ref_",
) -> DataFrame:
    """Each left row with the nearest right row of its keys not later (``backward``) or not earlier (``forward``).

    Times are microseconds; the tolerance (0 or more) counts with its ends; ``shift_us`` is added to right times. Of
    right rows at one time the smallest ``right_id`` counts. Left rows with NULL keys or time, or without a match,
    come out with NULL. Repeated left rows stay. ``carry`` columns come out under ``prefix`` with ``{prefix}us``.

    Time is cut into buckets as wide as the tolerance (a second at least); the last right row of a bucket also enters
    the next one, as no other can be the nearest there. Both sides of a bucket are united, sorted and the latest right
    row carried forward: skew is that of a bucket, not of a key, and no pairs are made.
    """
    width = max(int(tolerance_us), 1_000_000)
    sign = 1 if direction == "backward" else -1
    keys = list(keys)
    bucket = lambda us: ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")
    l = left.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    l = l.select("_row", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(left_us) * sign).alias("_t"))
    # rows that can't match, by NULL times, are spread; they come first in their groups, so before any right row
    l = l.withColumn("_b", F.coalesce(bucket(F.col("_t")), F.pmod(F.xxhash64("_row"), F.lit(1 << 16))))
    at = (F.col(right_us) + F.lit(shift_us)) * sign
    r = right.where(F.col(right_us).isNotNull() & F.col(right_id).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(at.alias("t"), (-F.col(right_id).cast("bigint")).alias("i"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("_r"),
    )
    for i in range(len(keys)):
        r = r.where(F.col(f"_k{i}").isNotNull())
    k = [f"_k{i}" for i in range(len(keys))]
    r = r.withColumn("_b", bucket(F.col("_r.t")))
    # into the next bucket only the last row of each bucket can matter
    last = r.groupBy(*k, (F.col("_b") + 1).alias("_b")).agg(F.max("_r").alias("_r"))
    # events and observations of a bucket are united and carried forward, so a busy bucket makes no pairs
    rows = (
        l.select("_row", *k, "_b", "_t", F.lit(1).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
        .unionByName(r.unionByName(last).select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *k, "_b", F.col("_r.t").alias("_t"), F.lit(0).alias("_tie"), "_r"))
    )
    w = Window.partitionBy(*k, "_b").orderBy("_t", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_best", F.max("_r").over(w)).where("_tie = 1")
    fit = F.col("_t") - F.col("_best.t") <= int(tolerance_us)
    out = out.select("_row", F.when(fit, F.col("_best")).alias("_best"))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in left.columns],
        (F.col("_best.t") * sign).alias(f"{prefix}us"),
        *[F.col(f"_best.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(carry)],
    )


def latest_before(
    left: DataFrame, right: DataFrame, entity: str, left_us: str, right_us: str, carry: Sequence[str], prefix: str = "ref_", forward: bool = False
) -> DataFrame:
    """As-of without tolerance: the last right row at or before each left time, or with ``forward`` the first at or after it.

    Ties by the largest ``carry``. Rows without entity or time come out with NULL.
    """
    if forward:
        l = left.withColumn("_t", -F.col(left_us))
        return latest_before(l, right.withColumn("_t", -F.col(right_us)), entity, "_t", "_t", carry, prefix).drop("_t")
    second = lambda us: ((F.col(us) - F.pmod(F.col(us), F.lit(1_000_000))) / F.lit(1_000_000)).cast("bigint")
    rest = lambda us: F.pmod(F.col(us), F.lit(1_000_000))
    l = left.withColumn("_s", second(left_us)).withColumn("_f", rest(left_us))
    r = right.withColumn("_s", second(right_us)).withColumn("_f", rest(right_us))
    return as_known(l, r, entity, ("_s", "_f"), ("_s", "_f"), "_s", carry, prefix, chunk_width=86_400).drop("_s", "_f")


def bounds_of(instants: DataFrame, us: str, blocks: DataFrame, block: str, block_us: str) -> DataFrame:
    """``instants`` with ``last_before`` and ``first_after``: the blocks nearest to each instant, its own time included.

    ``blocks`` has a row per block. Of blocks at one time the last counts before, the first after. Both searches are
    as-of joins in chunks of a day; an instant before the first or after the last block has NULL there.
    """
    b = blocks.select(F.lit(1).alias("_all"), F.col(block).cast("bigint").alias("block"), F.col(block_us).alias("_at")).withColumn("neg", -F.col("block"))
    i = instants.withColumn("_all", F.lit(1))
    i = latest_before(i, b, "_all", us, "_at", ["block"], "_last_")
    i = latest_before(i, b, "_all", us, "_at", ["neg"], "_first_", forward=True)
    return i.withColumns({"last_before": F.col("_last_block"), "first_after": -F.col("_first_neg")}).drop("_all", "_last_block", "_first_neg")


def coverage_by_age(matched: DataFrame, age_us: str, weight: str, ages_us: Sequence[int], required: float) -> DataFrame:
    """One row per tolerance of a grid: weighted rows, those matched within it, and whether the share suffices.

    One aggregation for the whole grid; NULL weights count as 0, and of NULL ages none is matched.
    """
    w = F.coalesce(F.col(weight), F.lit(0))
    grid = sorted(set(ages_us))
    sums = [F.sum(F.when(F.col(age_us) <= a, w).otherwise(0)).alias(f"m{i}") for i, a in enumerate(grid)]
    row = matched.agg(F.coalesce(F.sum(w), F.lit(0)).alias("total"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("max_age_us"), F.coalesce(f"m{i}", F.lit(0)).alias("matched")) for i, a in enumerate(grid)]))
    out = row.select("total", each.alias("x")).select("x.max_age_us", "total", "x.matched")
    share = F.col("matched") / F.greatest("total", F.lit(1))
    return out.select("max_age_us", "total", "matched", (F.col("total") - F.col("matched")).alias("missing"), share.alias("coverage"), (share >= required).alias("passes"))


def smallest_passing(coverage: DataFrame) -> DataFrame:
    """One row: the smallest tolerance of a coverage grid that passes as ``max_age_us``, NULL where none does."""
    return coverage.agg(F.min(F.when(F.col("passes"), F.col("max_age_us"))).alias("max_age_us"))


def prefer_source(
    left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, left_us: str, right_us: str, right_id: str, carry: Sequence[str],
    source: str, priority: Sequence[str], tolerance_us: int, prefix: str = "ref_",
) -> DataFrame:
    """Each left row with, of the sources in ``priority``, what the first one with a match within the tolerance offers.

    One as-of join: a left row enters once per source and ``source`` is one more key; then one aggregation per
    ``row_id`` (unique). Columns: ``row_id``, ``{prefix}us``, ``carry`` under ``prefix`` and ``by_source``, a map from each
    source with a match to (us, carry). The former are NULL where the map is empty.
    """
    each = left.select(row_id, *keys, left_us).withColumn(source, F.explode(F.array(*[F.lit(s) for s in priority])))
    a = asof_join(each, right.where(F.col(source).isin(*priority)), [*keys, source], left_us, right_us, right_id, carry, tolerance_us, prefix=prefix)
    names = [f"{prefix}us", *[f"{prefix}{c}" for c in carry]]
    found = F.when(F.col(f"{prefix}us").isNotNull(), F.struct(F.col(source).alias("source"), F.struct(*names).alias("match")))
    m = a.groupBy(row_id).agg(F.map_from_entries(F.collect_set(found)).alias("by_source"))
    best = F.coalesce(*[F.try_element_at("by_source", F.lit(s)) for s in priority])
    chosen = F.coalesce(*[F.when(F.try_element_at("by_source", F.lit(s)).isNotNull(), F.lit(s)) for s in priority])
    return m.select(row_id, chosen.alias("chosen"), *[best.getField(n).alias(n) for n in names], "by_source")


def prefer(primary: DataFrame, fallback: DataFrame, key: str, columns: Sequence[str], names: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """Per key the ``columns`` of the first side whose first column isn't NULL, and which side that was; keys are unique per side."""
    a = primary.select(key, F.struct(*columns).alias("_a"))
    b = fallback.select(key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer")
    first, second = F.col(f"_a.{columns[0]}").isNotNull(), F.col(f"_b.{columns[0]}").isNotNull()
    pick = F.when(first, F.col("_a")).when(second, F.col("_b"))
    return j.select(key, *[pick.getField(c).alias(c) for c in columns], F.when(first, names[0]).when(second, names[1]).alias("chosen"))
