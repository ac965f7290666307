"""First-in first-out lots, interval sums and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import CHUNK, attach, chunk_line, ordered_chunks, running_sums, time_chunks
from tidemark.session import written


def fifo_lots(tape: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, block: str, max_blocks: int | None = None) -> DataFrame:
    """Matches what each key takes out against what it put in, first in first out.

    ``amount`` (whole numbers, up to 38 digits) is positive for what goes in, negative for what comes out; rows with
    NULL or zero amounts don't matter. What is taken out beyond the balance is dropped. One row per matched piece:
    keys, in_block, out_block, amount, lifetime; with ``max_blocks`` only pieces that lived at most so long.

    Running sums give each entry and each exit an interval of the key's cumulative volume; a piece is where both
    overlap. Entry and exit intervals are each disjoint, so cutting the volume line at all their ends and carrying the
    latest entry and exit forward finds all pieces without a join. Sums, smallest sums and carried rows run within
    chunks of the order and of the volume line and go on from the chunks before, so a key may hold any share of all rows.
    """
    keys, dec = list(keys), "decimal(38,0)"
    zero = F.lit(0).cast(dec)
    a = F.col(amount).try_cast(dec)
    t = tape.select(*keys, *order, F.col(block).cast("bigint").alias("_block"), a.alias("_a")).where("_a is not null and _a != 0")
    t = ordered_chunks(t, keys, order, "lots")
    run = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = F.when(F.col("_a") > 0, F.col("_a")).otherwise(zero)
    t = t.withColumn("_s", F.sum("_a").over(run).cast(dec)).withColumn("_in", F.sum(put).over(run).cast(dec))
    past = chunk_line(keys).rowsBetween(Window.unboundedPreceding, -1)
    c = t.groupBy(*keys, CHUNK).agg(F.sum("_a").cast(dec).alias("s"), F.sum(put).cast(dec).alias("i"), F.min("_s").alias("m"))
    c = c.withColumn("_s0", F.coalesce(F.sum("s").over(past).cast(dec), zero)).withColumn("_i0", F.coalesce(F.sum("i").over(past).cast(dec), zero))
    c = c.withColumn("_m0", F.least(F.min((F.col("_s0") + F.col("m")).cast(dec)).over(past), zero)).drop("s", "i", "m")
    lowest = F.least((F.col("_s0") + F.min("_s").over(run)).cast(dec), F.col("_m0"))
    t = attach(t, c, keys).withColumn("_void", (-lowest).cast(dec))
    t = t.withColumn("_in", (F.col("_in") + F.col("_i0")).cast(dec))
    t = t.withColumn("_out", (F.col("_in") - F.col("_s") - F.col("_s0") - F.col("_void")).cast(dec))
    at_start = (F.col("_i0") - F.col("_s0") + F.col("_m0")).cast(dec)
    t = t.withColumn("_out_from", F.coalesce(F.lag("_out").over(Window.partitionBy(*keys, CHUNK).orderBy(*order)), at_start))
    kind = f"struct<to:{dec},block:bigint>"
    came = F.col("_a") > 0
    piece = lambda c: F.struct(F.col(c).alias("to"), F.col("_block").alias("block")).cast(kind)
    t = t.where(came | (F.col("_out") > F.col("_out_from"))).select(
        *keys, F.when(came, F.col("_in") - F.col("_a")).otherwise(F.col("_out_from")).cast(dec).alias("at"), F.when(came, piece("_in")).alias("entry"), F.when(~came, piece("_out")).alias("exit")
    )
    cut = t.groupBy(*keys, "at").agg(F.max("entry").alias("entry"), F.max("exit").alias("exit"))
    cut = ordered_chunks(cut, keys, ["at"], "volume")
    ends = cut.groupBy(*keys, CHUNK).agg(F.max("entry").alias("e"), F.max("exit").alias("x"), F.min("at").alias("a"))
    # both rise along the line, so the latest is the largest
    ends = ends.select(*keys, CHUNK, F.max("e").over(past).alias("_e0"), F.max("x").over(past).alias("_x0"), F.lead("a").over(chunk_line(keys)).alias("_a1"))
    line = Window.partitionBy(*keys, CHUNK).orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = attach(cut, ends, keys)
    cut = cut.withColumn("e", F.coalesce(F.last("entry", True).over(upto), "_e0")).withColumn("x", F.coalesce(F.last("exit", True).over(upto), "_x0"))
    cut = cut.withColumn("nxt", F.coalesce(F.lead("at").over(line), "_a1"))
    end = F.least(F.col("e.to"), F.col("x.to"), F.col("nxt"))
    cut = cut.withColumn("piece", (end - F.col("at")).cast(dec)).where("e is not null and x is not null and piece > 0")
    # pieces cut only by another piece's end belong to one lot
    out = cut.groupBy(*keys, F.col("e.block").alias("in_block"), F.col("x.block").alias("out_block"), F.col("e.to").alias("_e"), F.col("x.to").alias("_x")).agg(
        F.sum("piece").cast(dec).alias("amount")
    )
    out = out.withColumn("lifetime", F.col("out_block") - F.col("in_block")).drop("_e", "_x")
    return out if max_blocks is None else out.where(F.col("lifetime") <= max_blocks)


def sums_over_intervals(intervals: DataFrame, events: DataFrame, key: str, start: str, end: str, at: str, value: str, width: int) -> DataFrame:
    """``intervals`` with ``total`` and ``n_events``: the events of the key in (start, end]; 0 where there is none.

    Both ends read a running sum of the events at their time: running sums within chunks of ``width`` plus the sums of
    all chunks before, so cost is one row per end and event however long the intervals are. NULL ends give NULL.
    Repeated intervals stay repeated. The intervals are written with a number each, as both ends meet again by it.
    """
    chunk = lambda c: ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("bigint")
    i = written(intervals.withColumn("_id", F.monotonically_increasing_id()), "intervals")
    both = F.array(F.struct(F.col(start).alias("t"), F.lit(-1).alias("s")), F.struct(F.col(end).alias("t"), F.lit(1).alias("s")))
    ends = i.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(key).alias("k"), "_id", F.explode(both).alias("x"))
    ends = ends.select("k", F.col("x.t").alias("t"), F.col("x.s").alias("s"), "_id", F.lit(None).cast("double").alias("v"))
    ev = events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("v"))
    rows = ends.unionByName(ev.select("k", "t", F.lit(0).alias("s"), F.lit(None).cast("bigint").alias("_id"), "v")).withColumn("c", chunk(F.col("t")))
    w = Window.partitionBy("k", "c").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.coalesce(F.sum("v").over(w), F.lit(0.0))).withColumn("cnt", F.count("v").over(w)).where("_id is not null")
    per = ev.withColumn("c", chunk(F.col("t"))).groupBy("k", "c").agg(F.sum("v").alias("cv"), F.count("*").alias("cn"))
    # an end in a chunk without events goes on from the last chunk before it: chunks of ends enter with nothing to add
    marks = ends.select("k", chunk(F.col("t")).alias("c"), F.lit(0.0).alias("cv"), F.lit(0).cast("bigint").alias("cn"))
    past = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    base = per.unionByName(marks).groupBy("k", "c").agg(F.sum("cv").alias("cv"), F.sum("cn").alias("cn"))
    base = base.select("k", "c", F.coalesce(F.sum("cv").over(past), F.lit(0.0)).alias("bv"), F.coalesce(F.sum("cn").over(past), F.lit(0)).alias("bn"))
    g = rows.join(base, ["k", "c"], "left").groupBy("_id").agg(
        F.sum(F.col("s") * (F.col("run") + F.coalesce("bv", F.lit(0.0)))).alias("total"),
        F.sum(F.col("s") * (F.col("cnt") + F.coalesce("bn", F.lit(0)))).cast("bigint").alias("n_events"),
    )
    return i.join(g, "_id", "left").select(*[F.col(f"`{c}`") for c in intervals.columns], "total", "n_events")


def active_amounts(points: DataFrame, lots: DataFrame, key: str, block: str, tick: str, max_blocks: int, tick_width: int = 4096) -> DataFrame:
    """``points`` with ``active``: the summed amounts of the key's lots whose blocks and tick range [lower, upper) hold the point.

    Lots (key, in_block, out_block, tick_lower, tick_upper, amount of whole numbers) of at most ``max_blocks`` blocks are
    entered in each of their blocks: the amount comes in at the lower tick and goes out at the upper
    one. What comes in and goes out is summed per key, block and tick, and the running sum over the ticks, within
    chunks of ``tick_width`` ticks and bridged by the chunks' sums, is read at each different point. No lot meets a point, so neither
    a busy block nor many lots at one tick multiply. Points with NULL key, block or tick have 0; repeated points stay.
    """
    dec = "decimal(38,0)"
    at = points.select(F.col(key).alias("_k"), F.col(block).cast("bigint").alias("_b"), F.col(tick).cast("int").alias("_t"), F.lit(None).cast(dec).alias("_a")).dropna(subset=["_k", "_b", "_t"])
    short = lots.where((F.col("out_block") - F.col("in_block") <= max_blocks) & F.col("amount").isNotNull()).select(
        F.col(key).alias("_k"), F.explode(F.sequence("in_block", "out_block")).alias("_b"), "tick_lower", "tick_upper", F.col("amount").cast(dec).alias("a")
    )
    ticks = F.array(F.struct(F.col("tick_lower").alias("t"), F.col("a").alias("a")), F.struct(F.col("tick_upper").alias("t"), (-F.col("a")).cast(dec).alias("a")))
    edges = short.select("_k", "_b", F.explode(ticks).alias("x")).select("_k", "_b", F.col("x.t").cast("int").alias("_t"), F.col("x.a").alias("_a"))
    rows = edges.unionByName(at).groupBy("_k", "_b", "_t").agg(F.sum("_a").cast(dec).alias("_a"), F.count_if(F.col("_a").isNull()).alias("_asked"))
    rows = written(rows, "edges")  # read once for the sums of chunks, once for the rows
    run = running_sums(time_chunks(rows, "_t", tick_width), ["_k", "_b"], ["_t"], "_a", "_active").where("_asked > 0")
    run = run.select("_k", "_b", "_t", F.col("_active").cast("double").alias("_active"))
    own = (F.col(key) == F.col("_k")) & (F.col(block).cast("bigint") == F.col("_b")) & (F.col(tick).cast("int") == F.col("_t"))
    j = points.join(run, own, "left")
    return j.select(*[F.col(f"`{c}`") for c in points.columns], F.coalesce("_active", F.lit(0.0)).alias("active"))
