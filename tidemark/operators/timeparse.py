"""Timestamps in many notations, brought to UTC microseconds.

Every text gets all its valid readings; where these differ, an expectation-maximisation over the source's mixture of
formats decides, or marks the text as ambiguous.
"""

from __future__ import annotations

import re
import zoneinfo
from datetime import date, datetime, timedelta
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# The marks of universal time; other abbreviations are those of the source's own zone.
UNIVERSAL = ("UTC", "GMT", "Z")
# The English names of the months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SCHEMA = "source string, format string, weight double"
READINGS = "array<struct<format:string,micros:bigint>>"
# Field order of the all-numeric dates with slashes.
ORDERS = ("dmy", "mdy", "ymd", "ydm")

_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?\s*([AaPp][Mm](?![A-Za-z]))?"
_ZONE = r"\s*([Zz]|[A-Za-z]{3,5}|[+-]\d\d(?::?\d\d)?(?:\[[^\]]*\])?|[A-Za-z]+/[A-Za-z_/+-]+|)"
_form = lambda day, between=r"(?:T|\s+)", clock=_CLOCK: re.compile(day + between + clock + _ZONE, re.A)
ISO = _form(r"(\d{4})-(\d{1,2})-(\d{1,2})")
ORDINAL = _form(r"(\d{4})-(\d{3})")
SLASHES = _form(r"(\d{1,4})/(\d{1,2})/(\d{1,4})")
DAY_FIRST = _form(r"(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})")
MONTH_FIRST = _form(r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})")
COMPACT = _form(r"(\d{4})(\d\d)(\d\d)", "T", r"(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?()")
WEEKDAY = re.compile(r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+")
NUMBER = re.compile(r"(\d{1,19})(?:\.(\d+))?", re.A)
HEXADECIMAL = re.compile(r"0[xX]([0-9a-fA-F]{1,12})")
OFFSET = re.compile(r"([+-])(\d\d):?(\d\d)?", re.A)
_EPOCH = date(1970, 1, 1).toordinal()
_MICROSECOND = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _sixth(digits: str | None) -> int:
    return int(digits[:6].ljust(6, "0")) if digits else 0


def _month(name: str) -> int:
    return MONTHS.index(name[:3].lower()) + 1 if name[:3].lower() in MONTHS else 0


def _days(s: str) -> tuple[list[tuple[str, object, object, object]], tuple[str | None, ...]]:
    """The readings of a text's date as (format, year, month, day), and its clock and zone fields."""
    if s[:1].isalpha():
        s = WEEKDAY.sub("", s, count=1)
    if s[4:5] == "-":
        if m := ISO.fullmatch(s):
            return [("iso", m[1], m[2], m[3])], m.groups()[3:]
        if m := ORDINAL.fullmatch(s):
            year, n = int(m[1]) or 1, int(m[2])
            day = date(year, 1, 1) + timedelta(n - 1) if 0 < n and year < 9999 else None
            return [("ordinal", year, day.month, day.day)] if day and day.year == year else [], m.groups()[2:]
    elif m := SLASHES.fullmatch(s):
        f = m.groups()[:3]
        return [(o, *(f[o.index(x)] for x in "ymd")) for o in ORDERS if len(f[o.index("y")]) == 4], m.groups()[3:]
    elif m := COMPACT.fullmatch(s):
        return [("iso", m[1], m[2], m[3])], m.groups()[3:]
    elif m := DAY_FIRST.fullmatch(s):
        return [("words", m[3], _month(m[2]), m[1])], m.groups()[3:]
    elif m := MONTH_FIRST.fullmatch(s):
        return [("words", m[3], _month(m[1]), m[2])], m.groups()[3:]
    return [], ()


def _shift(at: datetime, mark: str, home: str | None) -> int | None:
    """Microseconds by which local time is ahead of UTC, by the text's zone or else by the source's own; None if there is no such time.

    An abbreviation must be one that the source's zone has at that local time, in the first or second pass of a repeated hour.
    """
    if m := OFFSET.match(mark):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return (-minutes if m[1] == "-" else minutes) * 60_000_000
    if mark.upper() in UNIVERSAL:
        return 0
    named = mark if "/" in mark else home
    zone = _zone(named) if named else None
    if zone is None:
        return None
    first = at.replace(tzinfo=zone)
    if mark and "/" not in mark:
        first = next((x for x in (first, first.replace(fold=1)) if (x.tzname() or "").upper() == mark.upper()), None)
        return None if first is None else first.utcoffset() // _MICROSECOND
    shift = first.utcoffset()
    # a skipped hour is no time: only there the offset grows from the first pass to the second
    return None if first.replace(fold=1).utcoffset() > shift else shift // _MICROSECOND


def readings_of(text: str | None, home: str | None, low: int, high: int) -> list[tuple[str, int]]:
    """All valid readings (format, UTC microseconds) of one text; epoch numbers only where they lie in [low, high)."""
    s = (text or "").strip("\"'` \t\r\n\v\f\u00a0")
    if m := NUMBER.fullmatch(s):
        n, part = int(m[1]), _sixth(m[2])
        found = (("epoch_s", n * 1_000_000 + part), ("epoch_ms", n * 1_000 + part // 1_000), ("epoch_us", n), ("epoch_ns", n // 1_000))
        return [(name, us) for name, us in found if low <= us < high]
    if m := HEXADECIMAL.fullmatch(s):
        us = int(m[1], 16) * 1_000_000
        return [("hex_s", us)] if low <= us < high else []
    days, clock = _days(s)
    if not days:
        return []
    h, mi, sec, half = int(clock[0]), int(clock[1]), int(clock[2] or 0), (clock[4] or "").lower()
    if half:
        h = h % 12 + 12 * (half == "pm") if 1 <= h <= 12 else 99
    found = []
    for name, y, m, d in days:
        try:
            at = datetime(int(y), int(m), int(d), h, mi, sec)
        except ValueError:
            continue
        shift = _shift(at, clock[5], home)
        if shift is not None:
            local = ((at.toordinal() - _EPOCH) * 86_400 + h * 3_600 + mi * 60 + sec) * 1_000_000 + _sixth(clock[3])
            found.append((name, local - shift))
    return found


def _reader(low: int, high: int):
    @F.arrow_udf(READINGS)
    def read(text: pa.Array, home: pa.Array) -> pa.Array:
        ends, names, micros = [0], [], []
        for t, z in zip(text.to_pylist(), home.to_pylist(), strict=True):
            for name, us in readings_of(t, z, low, high):
                names.append(name)
                micros.append(us)
            ends.append(len(names))
        each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(micros, pa.int64())], names=["format", "micros"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return read


def _fit(rounds: int, prior: float, tolerance: float):
    def em(stats: pd.DataFrame) -> pd.DataFrame:
        """EM over one source: ``stats`` has a row per set of valid formats, with how many texts have it."""
        source, declared = stats["source"].iloc[0], stats["declared"].iloc[0]
        sets = [(list(f), int(n)) for f, n in zip(stats["formats"], stats["n"], strict=True)]
        names = sorted({f for fs, _ in sets for f in fs})
        pseudo = {f: prior * (1.0 if f == declared else 0.01) for f in names}
        total = sum(pseudo.values())
        weight = {f: pseudo[f] / total for f in names}
        for _ in range(rounds):
            share = dict(pseudo)
            for fs, n in sets:
                mass = sum(weight[f] for f in fs)
                for f in fs:
                    share[f] += n * weight[f] / mass
            total = sum(share.values())
            moved = max(abs(share[f] / total - weight[f]) for f in names)
            weight = {f: share[f] / total for f in names}
            if moved < tolerance:
                break
        return pd.DataFrame({"source": source, "format": names, "weight": [weight[f] for f in names]})

    return em


def normalise_timestamps(
    records: DataFrame,
    sources: DataFrame,
    text: str = "timestamp_raw",
    source: str = "venue",
    zone: str = "zone_name",
    order: str = "date_order",
    low: str = "2022-01-01",
    high: str = "2028-01-01",
    certain: float = 0.9,
    rounds: int = 200,
    prior: float = 1.0,
) -> DataFrame:
    """``records`` with ``utc_micros``, ``time_format``, ``time_certainty`` and ``time_status``.

    ``sources`` tells per source (unique; further rows of one are ignored, the smallest counts) the zone of texts
    without zone and the declared order of all-numeric dates. Texts are read under every format that gives a valid
    instant: ISO forms, ordinal and compact dates, month names, the four orders of dates with slashes, and epoch
    numbers, whose unit is the one that puts them in [low, high). Each text is read once; ``records`` with its
    readings are a written table. How many texts of a source have which set of valid formats is counted in Spark; EM
    over these counts (one small group per source, at most as many rows as sets of formats) gives the source's
    mixture, with ``prior`` pseudo-counts on the declared order. The posterior chooses among a text's readings.

    ``time_status``: ``ok``; ``outside`` for an instant that is certain but not in [low, high); ``ambiguous`` where no
    instant reaches the posterior ``certain`` (``utc_micros`` is then NULL; ``time_certainty`` is the best posterior);
    ``unreadable`` for NULL, empty and impossible texts, texts with an unknown zone, and texts without zone of a source
    whose zone is unknown. Abbreviations other than UTC, GMT and Z are read by the source's own zone at that local
    time and are unknown elsewhere. In a repeated local hour the first pass counts, a skipped local hour is impossible. Readings that agree on the instant aren't ambiguous. Rows are
    neither dropped nor merged; a NULL source is a source of its own, without zone. Columns of ``records`` with the
    names of the result columns are replaced; columns of ``sources`` don't come out.
    """
    span = [int(pd.Timestamp(x, tz="UTC").value // 1000) for x in (low, high)]
    info = (
        sources.where(F.col(source).isNotNull())
        .groupBy(F.col(source).alias("_source"))
        .agg(F.min(F.struct(F.col(zone).alias("z"), F.lower(F.col(order)).alias("o"))).alias("_info"))
    )
    keep = [c for c in records.columns if c not in ("utc_micros", "time_format", "time_certainty", "time_status")]
    r = records.select(*keep).join(info, F.col(source).eqNullSafe(F.col("_source")), "left")
    r = written(r.withColumn("_r", _reader(*span)(F.col(text).cast("string"), F.col("_info.z"))), "readings")
    formats = F.array_sort(F.transform("_r", lambda x: x["format"]))
    stats = (
        r.where(F.size("_r") > 0)
        .groupBy(F.col(source).alias("source"), formats.alias("formats"), F.col("_info.o").alias("declared"))
        .agg(F.count("*").alias("n"))
    )
    weights = stats.groupBy("source").applyInPandas(_fit(rounds, prior, 1e-9), SCHEMA)
    mixture = weights.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("format", "weight"))).alias("_w")
    ).withColumnRenamed("source", "_of")
    # a row per source, written: where that is small, Spark sends it to the readings instead of shuffling them by source
    mixture = written(mixture, "mixtures")
    r = r.join(mixture, F.col(source).eqNullSafe(F.col("_of")), "left")
    weighed = F.transform(
        "_r", lambda x: F.struct(F.coalesce(F.try_element_at("_w", x["format"]), F.lit(0.0)).alias("w"), x["format"].alias("f"), x["micros"].alias("us"))
    )
    r = r.withColumn("_r", F.array_sort(weighed, lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).when(a["f"] < b["f"], -1).otherwise(1)))
    total = F.aggregate("_r", F.lit(0.0), lambda s, x: s + x["w"])
    best = F.try_element_at("_r", F.lit(1))
    agreeing = F.aggregate(F.filter("_r", lambda x: x["us"] == best["us"]), F.lit(0.0), lambda s, x: s + x["w"])
    sure = F.when(F.size("_r") == 1, 1.0).when(total > 0, agreeing / total).otherwise(0.0)
    r = r.withColumn("_best", best).withColumn("time_certainty", F.when(F.size("_r") > 0, sure))
    ok = F.col("time_certainty") >= certain
    return r.select(
        *keep,
        F.when(ok, F.col("_best.us")).alias("utc_micros"),
        F.when(ok, F.col("_best.f")).alias("time_format"),
        "time_certainty",
        F.when(ok & (F.col("_best.us") >= span[0]) & (F.col("_best.us") < span[1]), "ok").when(ok, "outside").when(F.size("_r") > 0, "ambiguous").otherwise("unreadable").alias("time_status"),
    )
