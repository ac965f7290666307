"""Path-dependent folds over ordered tapes, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.amm import liquidity_for_value, position_amounts
from tidemark.operators.ordered import CHUNK, attach, ordered_chunks, with_previous
from tidemark.session import written
from tidemark.sources.tables import usable


def bounds(target: np.ndarray, price: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions below the first or above the second are off by more than ``band`` in value; without a price there are none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(price > 0, band / price, np.inf)
    return target - far, target + far


def _first_outside(low: np.ndarray, high: np.ndarray, held: float, i: int) -> int:
    """The first row from ``i`` on whose bounds exclude ``held``, or the number of rows."""
    step = 64
    while i < len(low):
        off = (held < low[i : i + step]) | (held > high[i : i + step])
        k = int(off.argmax())
        if off[k]:
            return i + k
        i, step = i + len(off), min(step * 2, 65_536)
    return len(low)


def follow(target: np.ndarray, price: np.ndarray, band: np.ndarray, held: float | None) -> np.ndarray:
    """What is held after each row: the target whenever it is off by more than ``band`` in value, else as before.

    The first row ever (``held`` is None) takes the target. Rows between two changes are skipped in blocks.
    """
    out, n = np.empty(len(target)), len(target)
    low, high = bounds(target, price, band)
    i = 0 if held is None else _first_outside(low, high, held, 0)
    out[:i] = held
    while i < n:
        j = _first_outside(low, high, target[i], i + 1)
        out[i:j] = target[i]
        i = j
    return out


def steps(target: np.ndarray, price: np.ndarray, band: np.ndarray) -> dict[str, object]:
    """What the rows make of any position held before them, as a step function.

    A position is given up at the first row whose bounds exclude it, so at a new highest lower or lowest upper bound;
    what is held at the end follows from that row alone. No position outlasts the row at which the highest lower bound
    passes the lowest upper one, so only new extremes up to there count.
    """
    n = len(target)
    low, high = bounds(target, price, band)
    top, bottom = np.maximum.accumulate(low), np.minimum.accumulate(high)
    crossed = top > bottom
    stop = int(crossed.argmax()) + 1 if crossed.any() else n
    up = np.flatnonzero(np.r_[True, top[1:stop] > top[: stop - 1]])
    down = np.flatnonzero(np.r_[True, bottom[1:stop] < bottom[: stop - 1]])
    ends: dict[int, float] = {}

    def end(i: int) -> float:
        path = []
        while i not in ends:
            path.append(i)
            j = _first_outside(low, high, target[i], i + 1)
            if j == n:
                ends[i] = float(target[i])
            else:
                i = j
        for k in path:
            ends[k] = ends[i]
        return ends[i]

    return {
        "first": end(0),
        "up_at": up.tolist(), "up": top[up].tolist(), "up_end": [end(int(i)) for i in up],
        "down_at": down.tolist(), "down": bottom[down].tolist(), "down_end": [end(int(i)) for i in down],
    }


def after(s: dict[str, object], held: float | None) -> float:
    """The position after the rows of a step function, for the one held before."""
    if held is None:
        return s["first"]
    u = int(np.searchsorted(np.asarray(s["up"], float), held, "right"))
    d = int(np.searchsorted(-np.asarray(s["down"], float), -held, "right"))
    up_at = s["up_at"][u] if u < len(s["up_at"]) else None
    down_at = s["down_at"][d] if d < len(s["down_at"]) else None
    if up_at is None and down_at is None:
        return held
    return s["up_end"][u] if down_at is None or (up_at is not None and up_at <= down_at) else s["down_end"][d]


def follow_edges(target: np.ndarray, price: np.ndarray, band: np.ndarray, held: float | None) -> np.ndarray:
    """What is held after each row if a position off by more than ``band`` in value is brought to the band's edge only."""
    low, high = bounds(target, price, band)
    out, n = np.empty(len(target)), len(target)
    i = 0
    if held is None and n:
        held, out[0], i = target[0], target[0], 1
    while i < n:
        j = _first_outside(low, high, held, i)
        out[i:j] = held
        if j < n:
            out[j] = held = low[j] if held < low[j] else high[j]
        i = j + 1
    return out


def clamp(target: np.ndarray, price: np.ndarray, band: np.ndarray) -> dict[str, object]:
    """What the rows with edges make of any position held before them: one clamp, as clamps of clamps are clamps."""
    return {"first": follow_edges(target, price, band, None)[-1], "low": follow_edges(target, price, band, -np.inf)[-1], "high": follow_edges(target, price, band, np.inf)[-1]}


def after_clamp(s: dict[str, object], held: float | None) -> float:
    return s["first"] if held is None else min(max(held, s["low"]), s["high"])


_STEPS = "first double, up_at array<bigint>, up array<double>, up_end array<double>, down_at array<bigint>, down array<double>, down_end array<double>"
_CLAMP = "first double, low double, high double"


def _sorted(rows: pa.Table, order: Sequence[str]) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))


def _numbers(rows: pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    return [rows[c].cast(pa.float64()).to_numpy() for c in names]


def _chunked_path(tape: DataFrame, key: str, order: Sequence[str], target: str, price: str, band: str, edge: bool = False, size: int | None = None) -> DataFrame:
    names, order = (target, price, band), list(order)
    summary, then, path, kinds = (clamp, after_clamp, follow_edges, _CLAMP) if edge else (steps, after, follow, _STEPS)
    rows = tape
    for c in names:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    rows = ordered_chunks(rows, [key], order, "fold", size)
    kind = rows.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()

    def summarise(k: tuple, t: pa.Table) -> pa.Table:
        s = summary(*_numbers(_sorted(t, order), names))
        return pa.table({"k": pa.array([k[0].as_py()], k[0].type), CHUNK: pa.array([k[1].as_py()], pa.int32()), **{c: [v] for c, v in s.items()}})

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Summaries sorted by key and chunk: what each chunk is entered with. One summary at a time is in use."""
        key_now, held, started = None, None, False
        for b in batches:
            found = []
            for k, s in zip(b.column(0).to_pylist(), b.to_pylist(), strict=True):
                if not started or k != key_now:
                    key_now, held, started = k, None, True
                found.append(held)
                held = then(s, held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], names=["k", CHUNK, "_held"])

    def walk(k: tuple, t: pa.Table) -> pa.Table:
        t = _sorted(t, order)
        h = path(*_numbers(t, names), t["_held"][0].as_py())
        return t.drop_columns(["_held"]).append_column("held", pa.array(h, pa.float64()))

    few = rows.select(F.col(key).alias("k"), CHUNK, *dict.fromkeys([*order, *names]))
    s = few.groupBy("k", CHUNK).applyInArrow(summarise, f"k {kind}, {CHUNK} int, {kinds}")
    entering = s.repartition("k").sortWithinPartitions("k", CHUNK).mapInArrow(enter, f"k {kind}, {CHUNK} int, _held double")
    joined = attach(rows, entering.withColumnRenamed("k", key), [key])
    return joined.groupBy(key, CHUNK).applyInArrow(walk, rows.withColumn("held", F.lit(0.0)).schema)


def band_path(tape: DataFrame, key: str, order: Sequence[str], target: str, price: str, band: str, edge: bool = False) -> DataFrame:
    """``tape`` with ``held``: per key and in order, the position that follows ``target`` with a band of no action.

    A position off by more than ``band`` in value goes to the target, with ``edge`` only to the nearer end of the band.

    The recursion is sequential, but what a chunk of a key's rows makes of any entering position is a step function
    with few steps. So each chunk is summarised, a key's summaries (one row per chunk) are chained, and each chunk is
    walked through from the position with which it is entered: a key may hold any share of all rows. Rows with NULL or
    NaN target, price or band are left out; a price that isn't positive moves nothing, unless the row is the first;
    rows with NULL key form a key of their own. ``order`` must be without ties within a key.
    """
    return _chunked_path(tape, key, order, target, price, band, edge).drop(CHUNK)


def replay(
    tape: DataFrame, key: str, order: Sequence[str], day: str, pool_price: str, ref_price: str, capital: float | str, low: float, high: float, fee_usd: str,
    band: float, cost_bps: float, active: str | None = None, funding: str | None = None,
) -> DataFrame:
    """Per row the increments of a concentrated position in a range around its first price, hedged with a band.

    Columns besides ``key``, ``order`` and ``day``: ``lp_inc``, ``fee_inc``, ``hedge_inc``, ``funding_inc``,
    ``cost_inc``, ``net_inc``, ``held`` and ``trades``. The range is [low, high] times the first pool price; the liquidity
    is that of ``capital`` (a number, or a column that is constant per key) at the first reference price. Amounts follow
    the pool price and are valued at the reference price. A row's fee counts where its price is strictly in the range and
    that of the row before was too. With ``active``, the liquidity that others have in the row (in the units of
    ``amm.position_amounts``), the position earns its share of the fee, and nothing where it is NULL or NaN. ``funding``
    is the sum of price times rate of the payments since the row before; what is held short earns it. The hedge is opened
    at a key's first row and closed at its last one, both at a cost.
    """
    t = tape.where(F.col(pool_price) > 0).where(F.col(ref_price) > 0)
    first = F.struct(*order, F.col(pool_price).alias("p"), F.col(ref_price).alias("r"), (F.col(capital) if isinstance(capital, str) else F.lit(capital)).alias("c"))
    start = t.groupBy(key).agg(F.min(first).alias("s"), F.max(F.struct(*order)).alias("_z"))
    start = start.select(F.col(key).alias("_k"), (F.col("s.p") * low).alias("_lo"), (F.col("s.p") * high).alias("_hi"), F.col("s.r").alias("_r0"), F.col("s.c").alias("_c"), "_z")
    start = start.withColumn("_l", liquidity_for_value(F.col("_c"), F.col("_r0"), F.col("_lo"), F.col("_hi")))
    j = t.join(start, F.col(key).eqNullSafe(F.col("_k")), "inner")
    zero = F.lit(0.0)
    a0, a1 = position_amounts(F.col("_l"), F.col(pool_price), F.col("_lo"), F.col("_hi"))
    fee = F.coalesce(F.col(fee_usd), zero)
    if active:
        others = F.greatest(F.col(active).cast("double"), zero)
        fee = F.coalesce(F.when(usable(F.col(active).cast("double")), fee * F.try_divide(F.col("_l"), others + F.col("_l"))), zero)
    j = j.select(
        key, *order, day, F.col(ref_price).alias("ref"), a0.alias("a0"), (a0 * F.col(ref_price) + a1).alias("lp"), F.lit(band).alias("band"), fee.alias("fee"),
        ((F.col(pool_price) > F.col("_lo")) & (F.col(pool_price) < F.col("_hi"))).alias("inside"), F.struct(*order).eqNullSafe(F.col("_z")).alias("closes"),
        (F.coalesce(F.col(funding).cast("double"), zero) if funding else zero).alias("paid"),
    )
    h = written(_chunked_path(j, key, order, "a0", "ref", "band", size=tape.count()), "path")
    h = with_previous(h, [key], order, ["lp", "held", "ref", "inside"])
    prev = lambda c: F.col("_prev").getField(c)
    before = F.coalesce(prev("held"), zero)
    closing = F.when(F.col("closes"), F.abs("held")).otherwise(zero)
    h = h.withColumns(
        {
            "lp_inc": F.coalesce(F.col("lp") - prev("lp"), zero),
            "fee_inc": F.when(F.col("inside") & F.coalesce(prev("inside"), F.lit(True)), F.col("fee")).otherwise(zero),
            "hedge_inc": F.coalesce(-prev("held") * (F.col("ref") - prev("ref")), zero),
            "funding_inc": before * F.col("paid"),
            "cost_inc": -(F.abs(F.col("held") - before) + closing) * F.col("ref") * (cost_bps / 1e4),
            "trades": (F.col("held") != before).cast("int") + (closing > 0).cast("int"),
        }
    )
    parts = ["lp_inc", "fee_inc", "hedge_inc", "funding_inc", "cost_inc"]
    net = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return h.select(key, *order, day, *parts, net.alias("net_inc"), "held", "trades")


def band_stream(tape: DataFrame, key: str, order: str, target: str, price: str, band: str) -> DataFrame:
    """The same path over a stream whose micro-batches arrive in order per key: (key, order, held), one state value per key.

    Within a micro-batch rows are sorted; rows that arrive after later ones of an earlier micro-batch are taken in the
    order of arrival.
    """
    kind = dict(tape.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).dropna(subset=[target, price, band]).sort_values(order, kind="stable")
        if len(b):
            h = follow(b[target].to_numpy(float), b[price].to_numpy(float), b[band].to_numpy(float), state.get[0] if state.exists else None)
            state.update((float(h[-1]),))
            yield pd.DataFrame({key: [k[0]] * len(b), order: b[order].to_numpy(), "held": h})

    return tape.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {order} {kind[order]}, held double", "held double", "append", GroupStateTimeout.NoTimeout
    )
