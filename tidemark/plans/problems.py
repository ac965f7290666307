"""Queries of the training-data problems 2 to 5, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import surplus_deliveries
from tidemark.operators.grid import regular_grid
from tidemark.operators.pointintime import as_known
from tidemark.operators.timeparse import normalise_timestamps
from tidemark.sources.tables import table, usable

SERIES = ["source", "symbol", "acq_window"]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(F.coalesce("regime_eligible", F.lit(True)))
    return regular_grid(r.select(*SERIES, "timestamp", "mid"), SERIES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("status != 'observed'").select("source", "symbol", "slot_epoch").distinct()


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("value", F.round("value", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return surplus_deliveries(table(spark, d, "pool_events"))


def p3_lost_producers(spark: SparkSession, d: str) -> DataFrame:
    """Surplus deliveries where those of every other batch have lost their block and are told by hash."""
    e = table(spark, d, "pool_events").select("delivery_id", "block_number", "log_index", "tx_hash", "batch_no")
    return surplus_deliveries(e.withColumn("block_number", F.when(F.col("batch_no") % 2 == 0, F.col("block_number"))))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pool_events").where("event = 'Swap'")
    positive = lambda c: usable(c) & (F.col(c) > 0)
    paid = F.when(positive("amount0"), 0).when(positive("amount1"), 1)
    e = e.select(
        "delivery_id",
        F.lower(F.trim("pool")).alias("pool"),
        "block_number",
        "log_index",
        "fee_protocol_packed",
        "lp_fee_fraction",
        paid.alias("paid"),
    )
    s = table(spark, d, "fee_states").withColumn("pool", F.lower(F.trim("pool")))
    s = s.where("fee_protocol_packed is not null")
    return as_known(
        e, s, "pool", ("block_number", "log_index"), ("block_number", "log_index"), "recorded_block",
        ["state_id", "fee_protocol_packed"],
    )


def _fraction(packed: str) -> Column:
    p = F.col(packed)
    den = F.when(F.col("paid") == 0, p.bitwiseAND(15)).when(F.col("paid") == 1, F.shiftright(p, 4).bitwiseAND(15)).otherwise(0)
    return F.when(den == 0, F.lit(1.0)).otherwise(1.0 - F.lit(1.0) / F.nullif(den, F.lit(0)).cast("double"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    j = _p4(spark, d).where("known_state_id is not null").withColumn("right", _fraction("known_fee_protocol_packed"))
    wrong = F.coalesce(F.col("fee_protocol_packed") != F.col("known_fee_protocol_packed"), F.lit(False)) | F.coalesce(
        usable("lp_fee_fraction") & (F.abs(F.col("lp_fee_fraction") - F.col("right")) > 1e-9), F.lit(False)
    )
    return j.where(wrong).select("delivery_id", F.col("known_state_id").alias("state_id"))


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    j = _p4(spark, d)
    return j.select(
        "delivery_id",
        F.col("known_state_id").alias("state_id"),
        F.when(F.col("known_state_id").isNotNull(), F.round(_fraction("known_fee_protocol_packed"), 9)).alias("lp_fraction"),
    )


def _times(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "venue_trades").select("record_id", "venue", "timestamp_raw")
    return normalise_timestamps(t, table(spark, d, "venues"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).where("time_status = 'ok'").select("record_id", "utc_micros")


def p5_formats(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).groupBy("venue", "time_status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_grid, p3_found, p3_lost_producers, p4_found, p4_states, p5_found, p5_formats)}

_SLOT = "CAST(floor(epoch(timestamp) / 300) AS BIGINT) * 300"
_READINGS = f"""r AS (SELECT source, symbol, acq_window, epoch_us(timestamp) AS us, mid, {_SLOT} AS slot FROM reference
  WHERE COALESCE(regime_eligible, TRUE) AND mid IS NOT NULL AND NOT isnan(mid) AND timestamp IS NOT NULL)"""
_STATE = """e AS (SELECT delivery_id, lower(trim(pool)) AS pool, block_number, log_index, fee_protocol_packed AS stamped,
    CASE WHEN isnan(lp_fee_fraction) THEN NULL ELSE lp_fee_fraction END AS fraction,
    CASE WHEN amount0 > 0 AND NOT isnan(amount0) THEN 0 WHEN amount1 > 0 AND NOT isnan(amount1) THEN 1 END AS paid
  FROM pool_events WHERE event = 'Swap'),
j AS (SELECT e.*, s.state_id, s.fee_protocol_packed AS packed,
    row_number() OVER (PARTITION BY e.delivery_id ORDER BY s.block_number DESC, s.log_index DESC, s.recorded_block DESC, s.state_id DESC) AS rn
  FROM e LEFT JOIN fee_states s ON lower(trim(s.pool)) = e.pool AND s.fee_protocol_packed IS NOT NULL AND s.recorded_block <= e.block_number
    AND (s.block_number < e.block_number OR (s.block_number = e.block_number AND s.log_index <= e.log_index))),
k AS (SELECT *, CASE paid WHEN 0 THEN packed & 15 WHEN 1 THEN packed >> 4 & 15 ELSE 0 END AS den FROM j WHERE rn = 1),
x AS (SELECT *, CASE WHEN den = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 1.0::DOUBLE / den::DOUBLE END AS right_fraction FROM k)"""

_FORMATS = "'%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y%m%dT%H%M%S', '%Y-%jT%H:%M:%S', '%d %b %Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p'"
# The abbreviations of the venues' zones with their offsets in minutes; those of no zone hold everywhere.
_NAMES = """('Z', NULL, 0), ('UTC', NULL, 0), ('GMT', NULL, 0), ('EST', 'America/New_York', -300), ('EDT', 'America/New_York', -240),
  ('CET', 'Europe/Berlin', 60), ('CEST', 'Europe/Berlin', 120), ('BST', 'Europe/London', 60), ('JST', 'Asia/Tokyo', 540),
  ('AEST', 'Australia/Sydney', 600), ('AEDT', 'Australia/Sydney', 660)"""
TIMES = rf"""o(abb, of_zone, minutes) AS (VALUES {_NAMES}),
s AS (SELECT record_id, venue, zone_name, date_order, regexp_replace(regexp_replace(timestamp_raw, '^[\s"'']+|[\s"'']+$', '', 'g'), '^[A-Z][a-z][a-z], ', '') AS s
  FROM venue_trades LEFT JOIN venues USING (venue)),
z AS (SELECT *, regexp_extract(s, '(Z|[+-]\d\d(:?\d\d)?(\[[^\]]*\])?| [A-Z]{{3,4}}| [A-Z][a-z]+/[A-Za-z_]+)$', 1) AS z FROM s),
b AS (SELECT *, left(s, length(s) - length(z)) AS b FROM z),
f AS (SELECT *, regexp_extract(b, '[.,](\d+)$', 1) AS f, regexp_replace(b, '[.,]\d+$', '') AS d FROM b),
n AS (SELECT *, COALESCE(try_strptime(d, [{_FORMATS}]),
    CASE date_order WHEN 'dmy' THEN try_strptime(d, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %I:%M:%S %p']) WHEN 'mdy' THEN try_strptime(d, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M:%S %p'])
      ELSE try_strptime(d, ['%Y/%m/%d %H:%M:%S', '%Y/%m/%d %I:%M:%S %p']) END) + INTERVAL 1 MICROSECOND * CAST(rpad(left(f, 6), 6, '0') AS INTEGER) AS local FROM f),
l AS (SELECT *, CASE WHEN z = '' THEN zone_name WHEN contains(z, '/') AND z[1] = ' ' THEN trim(z) END AS named FROM n),
c AS (SELECT *, timezone(named, local) AS c FROM l),
y AS (SELECT record_id, venue, CASE
  WHEN regexp_full_match(s, '\d{{10}}(\.\d+)?') THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000000 + CAST(rpad(left(split_part(s, '.', 2), 6), 6, '0') AS BIGINT)
  WHEN regexp_full_match(s, '\d{{13}}') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_full_match(s, '\d{{16}}') THEN CAST(s AS BIGINT)
  WHEN regexp_full_match(s, '\d{{19}}') THEN CAST(s AS BIGINT) // 1000 WHEN regexp_full_match(s, '0x[0-9a-f]{{8}}') THEN CAST(s AS BIGINT) * 1000000
  WHEN regexp_matches(z, '^[+-]') THEN epoch_us(local) - CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * 60000000::BIGINT
    * (CAST(z[2:3] AS BIGINT) * 60 + CAST(COALESCE(NULLIF(regexp_extract(z, '^...:?(\d\d)', 1), ''), '0') AS BIGINT))
  WHEN named IS NOT NULL THEN epoch_us(CASE WHEN timezone(named, c - INTERVAL 1 HOUR) = local THEN c - INTERVAL 1 HOUR ELSE c END)
  ELSE epoch_us(local) - minutes * 60000000::BIGINT END AS us FROM c LEFT JOIN o ON o.abb = trim(z) AND (of_zone IS NULL OR of_zone = zone_name))"""

ORACLES = {
    "p2_found": f"""WITH {_READINGS},
b AS (SELECT source, symbol, acq_window, min(slot) AS a, max(slot) AS z FROM r GROUP BY ALL),
g AS (SELECT source, symbol, acq_window, unnest(generate_series(a, z, 300)) AS slot_epoch FROM b)
SELECT DISTINCT g.source, g.symbol, CAST(g.slot_epoch AS BIGINT) AS slot_epoch FROM g
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source IS NOT DISTINCT FROM g.source AND r.symbol IS NOT DISTINCT FROM g.symbol
  AND r.acq_window IS NOT DISTINCT FROM g.acq_window AND r.slot = g.slot_epoch)""",
    "p2_grid": f"""WITH {_READINGS},
s AS (SELECT source, symbol, acq_window, slot, count(*) AS n, min(ROW(us, mid)) AS f, max(ROW(us, mid)) AS l FROM r GROUP BY ALL),
b AS (SELECT source, symbol, acq_window, min(slot) AS a, max(slot) AS z FROM s GROUP BY ALL),
g AS (SELECT source, symbol, acq_window, CAST(unnest(generate_series(a, z, 300)) AS BIGINT) AS slot_epoch FROM b),
m AS (SELECT g.*, s.n, s.f, s.l FROM g LEFT JOIN s ON s.source IS NOT DISTINCT FROM g.source AND s.symbol IS NOT DISTINCT FROM g.symbol
  AND s.acq_window IS NOT DISTINCT FROM g.acq_window AND s.slot = g.slot_epoch),
w AS (SELECT *, last_value(l IGNORE NULLS) OVER (PARTITION BY source, symbol, acq_window ORDER BY slot_epoch) AS p,
  first_value(f IGNORE NULLS) OVER (PARTITION BY source, symbol, acq_window ORDER BY slot_epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM m),
v AS (SELECT source, symbol, acq_window, slot_epoch, n, p[1] AS t0, p[2] AS v0, q[1] AS t1, q[2] AS v1 FROM w)
SELECT source, symbol, acq_window, slot_epoch,
  CASE WHEN n IS NOT NULL THEN 'observed' WHEN t1 - t0 <= 900000000 THEN 'interpolated' ELSE 'missing' END AS status,
  COALESCE(n, 0)::BIGINT AS n_readings,
  round(CASE WHEN n IS NOT NULL THEN v0 WHEN t1 - t0 <= 900000000
    THEN v0 + (v1 - v0) * ((slot_epoch * 1000000 - t0)::DOUBLE / (t1 - t0)) END, 6) AS value FROM v""",
    "p3_found": """WITH d AS (SELECT delivery_id, row_number() OVER (PARTITION BY block_number, log_index ORDER BY delivery_id) AS rn FROM pool_events)
SELECT delivery_id FROM d WHERE rn > 1""",
    "p3_lost_producers": r"""WITH h AS (SELECT delivery_id, log_index, CASE WHEN batch_no % 2 = 0 THEN block_number END AS p, ltrim(regexp_extract(lower(tx_hash), '^\s*(?:0x)?([0-9a-f]+)\s*$', 1), '0') AS x,
  regexp_full_match(lower(tx_hash), '\s*(?:0x)?[0-9a-f]+\s*') AS ok FROM pool_events),
d AS (SELECT delivery_id, log_index, p, CASE WHEN ok AND length(x) <= 64 THEN lpad(x, 64, '0') END AS h FROM h WHERE log_index IS NOT NULL),
k AS (SELECT h, log_index, min(p) AS found FROM d WHERE p IS NOT NULL AND h IS NOT NULL GROUP BY ALL),
m AS (SELECT d.delivery_id, d.log_index, COALESCE('p' || COALESCE(d.p, k.found), 'h' || d.h) AS who FROM d LEFT JOIN k ON d.p IS NULL AND d.h = k.h AND d.log_index = k.log_index)
SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY who, log_index ORDER BY delivery_id) AS rn FROM m WHERE who IS NOT NULL) WHERE rn > 1""",
    "p4_found": f"""WITH {_STATE}
SELECT delivery_id, state_id FROM x WHERE state_id IS NOT NULL
  AND (COALESCE(stamped <> packed, FALSE) OR COALESCE(abs(fraction - right_fraction) > 1e-9, FALSE))""",
    "p4_states": f"""WITH {_STATE}
SELECT delivery_id, state_id, CASE WHEN state_id IS NOT NULL THEN round(right_fraction, 9) END AS lp_fraction FROM x""",
    "p5_found": f"""WITH {TIMES} SELECT record_id, us AS utc_micros FROM y WHERE us IS NOT NULL""",
    "p5_formats": f"""WITH {TIMES} SELECT venue, CASE WHEN us IS NULL THEN 'unreadable' ELSE 'ok' END AS time_status, count(*) AS n FROM y GROUP BY 1, 2""",
}
