"""Matching records by nearest time: a stateful streaming join of two tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.session import scratch_path

OUT = "left_id bigint, right_id bigint, left_us bigint, right_us bigint"
STATE = "left_id binary, left_us binary, right_id binary, right_us binary"
HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def nearest(left_us: np.ndarray, right_us: np.ndarray, right_id: np.ndarray, before: int, after: int) -> np.ndarray:
    """Position of the right record for each left time, -1 for none.

    Eligible: at most ``before`` earlier and ``after`` later. The nearest counts, of two equally near the earlier,
    then the smallest id.
    """
    out = np.full(len(left_us), -1)
    if not len(right_us):
        return out
    back = np.lexsort((-right_id, right_us))
    i = np.searchsorted(right_us[back], left_us, "right") - 1
    prev = back[np.maximum(i, 0)]
    prev_age = np.where(i >= 0, left_us - right_us[prev], before + 1)
    fore = np.lexsort((right_id, right_us))
    k = np.searchsorted(right_us[fore], left_us, "right")
    nxt = fore[np.minimum(k, len(fore) - 1)]
    nxt_age = np.where(k < len(fore), right_us[nxt] - left_us, after + 1)
    ok_prev, ok_next = prev_age <= before, nxt_age <= after
    out[ok_prev] = prev[ok_prev]
    take = ok_next & (~ok_prev | (nxt_age < prev_age))
    out[take] = nxt[take]
    return out


def _step(before: int, after: int, width: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Buffers both sides of an entity's slice of time; emits what the watermark has passed, evicts what has expired."""
        if key[2]:
            return  # an end mark only moves the watermark
        old = [np.frombuffer(x, np.int64) for x in state.get] if state.exists else [np.empty(0, np.int64)] * 4
        parts = [[x] for x in old]
        if not state.hasTimedOut:
            for b in batches:
                is_left = b["is_left"].to_numpy(bool)
                ids, us = b["id"].to_numpy(np.int64), b["us"].to_numpy(np.int64)
                for k, x in enumerate((ids[is_left], us[is_left], ids[~is_left], us[~is_left])):
                    parts[k].append(x)
        left_id, left_us, right_id, right_us = (np.concatenate(x) for x in parts)
        mark = state.getCurrentWatermarkMs() * 1000
        ready = left_us + after <= mark  # every record still to come is later than the watermark
        if ready.any():
            t = left_us[ready]
            at = nearest(t, right_us, right_id, before, after)
            hit = at >= 0
            picked = [np.where(hit, x[at], 0) if len(x) else np.zeros(len(t), np.int64) for x in (right_id, right_us)]
            r_id, r_us = (pd.arrays.IntegerArray(x, ~hit) for x in picked)
            yield pd.DataFrame({"left_id": left_id[ready], "right_id": r_id, "left_us": t, "right_us": r_us})
        left_id, left_us = left_id[~ready], left_us[~ready]
        lower = min(mark, left_us.min()) if len(left_us) else mark
        live = right_us >= lower - before
        right_id, right_us = right_id[live], right_us[live]
        end = (key[1] + 1) * width  # no left record of the slice is later
        if len(left_us) or (len(right_us) and mark < end):
            state.update(tuple(x.tobytes() for x in (left_id, left_us, right_id, right_us)))
            due = (left_us.min() + after) // 1000 + 1 if len(left_us) else end // 1000 + 1
            state.setTimeoutTimestamp(int(max(due, mark // 1000 + 1)))
        elif state.exists:
            state.remove()

    return step


def _paired(both: DataFrame, before: int, after: int, late_seconds: float, slice_seconds: int) -> DataFrame:
    """The join of one stream of (is_left, entity, id, at, ends); records with ``ends`` only move the watermark."""
    width = max(int(slice_seconds) * 1_000_000, before + after, 1)  # so a right record has three slices at most
    at = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    us = F.unix_micros("at")
    own, all_met = F.array(at(us)), F.sequence(at(us - after), at(us + before))
    rows = both.where("at is not null and (ends or (entity is not null and id is not null))")
    rows = rows.withWatermark("at", f"{int(late_seconds * 1000)} milliseconds")
    rows = rows.select("entity", F.explode(F.when(F.col("is_left") | F.col("ends"), own).otherwise(all_met)).alias("slice"), "ends", "is_left", "id", us.alias("us"), "at")
    return rows.groupBy("entity", "slice", "ends").applyInPandasWithState(_step(before, after, width), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _side(df: DataFrame, is_left: bool, entity: str, i: str, t: str) -> DataFrame:
    return df.select(
        F.lit(is_left).alias("is_left"), F.col(entity).cast("string").alias("entity"), F.col(i).cast("bigint").alias("id"),
        F.col(t).cast("timestamp").alias("at"), F.lit(False).alias("ends"),
    )


def _reach(tolerance_seconds: float, direction: str) -> tuple[int, int]:
    tol = round(tolerance_seconds * 1_000_000)
    return (0 if direction == "forward" else tol), (0 if direction == "backward" else tol)


def nearest_time_join(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, left_time: str, right_id: str, right_time: str,
    tolerance_seconds: float, late_seconds: float, direction: str = "backward", slice_seconds: int = 14_400,
) -> DataFrame:
    """Streaming: every left record with the nearest right record of its entity, or NULL, as (left_id, right_id, left_us, right_us).

    ``direction``: ``backward`` (right not later), ``forward`` (not earlier) or ``nearest`` (both). Ends of the
    tolerance count. Of right records at one time the smallest id counts. Both sides are buffered per entity and slice
    of ``slice_seconds`` (of the tolerance's length, if that is longer), so an entity that holds a third of all rows is
    many groups; a right record goes to every slice in which a left record can meet it. A left record comes out once
    the watermark (``late_seconds`` behind the latest record of both sides) passes its tolerance horizon, right records
    are evicted when no left record to come can need them. Records later than the watermark are dropped by
    Spark: ``late_seconds`` must bound how far records come out of order, on both sides together. Records without
    entity, time or id can't be paired and are left out; repeated records are records of their own.
    """
    both = _side(left, True, entity, left_id, left_time).unionByName(_side(right, False, entity, right_id, right_time))
    return _paired(both, *_reach(tolerance_seconds, direction), late_seconds, slice_seconds)


def time_spans(both: DataFrame, path: str, spans: int) -> list[str]:
    """Writes ``both`` as at most ``spans`` folders of successive times under ``path``; their names in order.

    One shuffle by ranges of time, of narrow rows. A span has as many files as the session has cores.
    """
    spark = both.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # further columns split instants that very many records share
    parts = both.repartitionByRange(spans * cores, "at", "id", "entity").withColumn("span", (F.spark_partition_id() / cores).cast("int"))
    parts.write.partitionBy("span").parquet(path)
    names = [s.getPath().getName() for s in _folder(spark, path)[0].listStatus(_folder(spark, path)[1]) if s.isDirectory()]
    return sorted((n for n in names if n.startswith("span=")), key=lambda n: int(n[5:]))


def _folder(spark: SparkSession, path: str):  # noqa: ANN202  objects of the JVM
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def pair_tables(
    spark: SparkSession, left_path: str, right_path: str, entity: str, left_id: str, left_time: str, right_id: str, right_time: str,
    tolerance_seconds: float, direction: str = "backward", right_filter: Column | None = None, rows_per_batch: int | None = None,
    slice_seconds: int = 14_400, progress: list | None = None,
) -> DataFrame:
    """The join of two Parquet tables, streamed to their end: (left_id, right_id, left_us, right_us), a row per left record.

    However the tables' files are cut and ordered, both are first laid out by time in spans of ``rows_per_batch``
    records (default: a million a core). The stream is given span after span, a micro-batch each, so no record is late,
    and what is buffered is one span and the records within the tolerance before it. An end mark beyond the last time
    then passes the watermark over all records. State is kept in RocksDB where the session names no provider. The
    result is a table in the shared folder; a stream that is interrupted goes on from its checkpoint there. Left
    records without id, entity or time aren't in it. ``progress`` gets the stream's last progress reports.
    """
    left, right = spark.read.parquet(left_path), spark.read.parquet(right_path)
    if right_filter is not None:
        right = right.where(right_filter)
    both = _side(left, True, entity, left_id, left_time).unionByName(_side(right, False, entity, right_id, right_time))
    both = both.where("entity is not null and id is not null and at is not null")
    base = scratch_path(spark, "nearest")
    before, after = _reach(tolerance_seconds, direction)
    cores = spark.sparkContext.defaultParallelism
    rows = left.count() + spark.read.parquet(right_path).count()  # from the files' footers
    spans = time_spans(both, f"{base}/spans", max(1, -(-rows // (rows_per_batch or 1_000_000 * cores))))
    empty = StructType.fromDDL(OUT)
    if not spans:
        return spark.createDataFrame([], empty)
    last = spark.read.schema(both.schema).parquet(f"{base}/spans/{spans[-1]}").agg(F.max("at").alias("at"))
    end = last.select(F.lit(True).alias("is_left"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("bigint").alias("id"), "at", F.lit(True).alias("ends"))
    beyond = F.timestamp_micros(F.unix_micros("at") + F.lit(before + after + 10_000_000))
    end.select("is_left", "entity", "id", beyond.alias("at"), "ends").write.parquet(f"{base}/spans/end")

    # settings of the stream's own: other queries of the session keep theirs
    own = spark.newSession()
    named = spark.conf.get(PROVIDER)
    own.conf.set(PROVIDER, ROCKS if named == HDFS and spark.sparkContext.getConf().get(PROVIDER) is None else named)
    # a stateful stream has one state store a shuffle partition, which adaptive execution can't merge
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)))
    fs, live = _folder(spark, f"{base}/live")
    fs.mkdirs(live)
    stream = own.readStream.schema(both.schema).option("recursiveFileLookup", "true").parquet(f"{base}/live")
    joined = _paired(stream, before, after, 1.0, slice_seconds)
    q = joined.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        for name in [*spans, "end"]:
            fs.rename(_folder(spark, f"{base}/spans/{name}")[1], _folder(spark, f"{base}/live/{name}")[1])
            q.processAllAvailable()
        if progress is not None:
            progress += q.recentProgress
    finally:
        q.stop()
    return spark.read.schema(empty).parquet(f"{base}/out")
