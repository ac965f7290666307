"""Filling containers of fixed capacity with texts, measured in tokens."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level tokenizers split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "container_id bigint, doc_id bigint, first_token int, n_tokens int, container_tokens int"


@lru_cache(maxsize=2)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's content."""
    pairs = map(bytes.split, ranks.splitlines())
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _sent(spark: SparkSession, vocabulary: str) -> Broadcast[bytes]:
    """The vocabulary file, read by the driver and sent with the job: executors need no copy. Its size is that of the public file."""
    return spark.sparkContext.broadcast(Path(vocabulary).read_bytes())


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The items (length, how many) with the largest sum of at most ``room``: a bitset of the sums that can be reached.

    ``lengths`` are the keys of ``counts`` in descending order. Bit i of the bitset says that i can be reached; each
    step shifts it by a power of two of items of a length, and the steps are walked back from the best sum.
    """
    if room <= 0:
        return []
    mask, bits, full = (1 << (room + 1)) - 1, 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        n, k = min(counts[length], room // length), 1
        while n > 0:
            k = min(k, n)
            more = (bits | bits << k * length) & mask
            if more != bits:
                steps.append((length, k, bits))
                bits = more
            n -= k
            k *= 2
        if bits & full:
            break
    at, used = bits.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            used[length] += k
    return list(used.items())


def minimum_bin_slack(lengths: list[int], capacity: int) -> Iterator[list[int]]:
    """Bins as lists of positions in ``lengths`` (each between 1 and ``capacity``).

    Every bin takes the longest item left and, of all combinations of the others, one that leaves the least room.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        at[n].append(i)
    counts = {n: len(x) for n, x in at.items()}
    order = sorted(counts, reverse=True)
    while order:
        first = order[0]
        chosen = [at[first].pop()]
        counts[first] -= 1
        for n, k in fullest(counts, order, capacity - first):
            counts[n] -= k
            chosen += [at[n].pop() for _ in range(k)]
        order = [n for n in order if counts[n]]
        yield chosen


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of the whole texts; special tokens' strings are ordinary text. NULL texts have none."""

    ranks = _sent(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(count, "id bigint, n_tokens bigint")


def fill_containers(
    docs: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    items_per_group: int = 5000,
) -> DataFrame:
    """Which tokens of which text go into which container: one row per item, and every token in exactly one.

    Columns: ``container_id``, ``doc_id`` (``id_col``), ``first_token``, ``n_tokens``, ``container_tokens`` (the
    container's sum). A text of more than ``capacity`` tokens is cut into full containers and a rest; no other is
    split. NULL and empty texts have no tokens and give no row. Repeated rows are items of their own; rows with NULL
    ids keep them. An empty table gives an empty result.

    Items are dealt at random into groups of about ``items_per_group``, each packed by minimum bin slack in one task;
    a group wastes about one container, so the size of the groups and not that of the corpus bounds a task. The items
    with their groups are a written table, as a task that runs again could number its rows otherwise.
    """
    groups = max(1, -(-docs.count() // items_per_group))
    n = token_counts(docs, id_col, text, vocabulary).where("n_tokens > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))
    items = n.select("id", "n_tokens", F.explode(starts).alias("first"))
    items = items.withColumn("n", F.least(F.col("n_tokens") - F.col("first"), F.lit(capacity)))
    items = items.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    items = written(items.select("grp", "id", "first", "n"), "items")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "first", "n"], ignore_index=True)  # the same bins if a task runs again
        base = int(pdf["grp"].iloc[0]) << 32
        lengths = pdf["n"].tolist()
        container, total = [0] * len(lengths), [0] * len(lengths)
        for k, chosen in enumerate(minimum_bin_slack(lengths, capacity)):
            used = sum(lengths[i] for i in chosen)
            for i in chosen:
                container[i], total[i] = base + k, used
        return pd.DataFrame(
            {"container_id": container, "doc_id": pdf["id"], "first_token": pdf["first"], "n_tokens": pdf["n"], "container_tokens": total}
        )

    # few bytes but much work: as many tasks as cores, which adaptive execution leaves apart
    spark = docs.sparkSession
    tasks = min(groups, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = items.select("grp", "id", "first", "n").repartition(tasks, "grp").groupBy("grp").applyInPandas(pack, SCHEMA)
    return packed.withColumnRenamed("doc_id", id_col)


def container_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, tokens): the token ids of each container, for ids that are unique; a container bounds each row.

    A text is encoded once, however many pieces it has.
    """
    ranks = _sent(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            for row in range(batch.num_rows):
                i, t, pieces = (batch.column(k)[row].as_py() for k in range(3))
                tokens = encode(t)
                at = [(p["container_id"], p["first_token"], tokens[p["first_token"] : p["first_token"] + p["n_tokens"]]) for p in pieces]
                c, first, each = zip(*at, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), pa.array([i] * len(at), pa.int64()), pa.array(first, pa.int32()), pa.array(each, pa.list_(pa.int32()))],
                    names=["container_id", "id", "first_token", "tokens"],
                )

    per_doc = packed.groupBy(id_col).agg(F.collect_list(F.struct("container_id", "first_token", "n_tokens")).alias("pieces"))
    j = docs.select(id_col, text).join(per_doc, id_col).select(F.col(id_col).cast("bigint").alias("id"), text, "pieces")
    parts = j.mapInArrow(cut, "container_id bigint, id bigint, first_token int, tokens array<int>")
    each = F.sort_array(F.collect_list(F.struct("id", "first_token", "tokens")))
    return parts.groupBy("container_id").agg(F.flatten(F.transform(each, lambda x: x["tokens"])).alias("tokens"))


def packing_report(
    docs: DataFrame, packed: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row that tells whether a packing is right, with the tokens counted anew.

    ``n_texts``: texts with tokens; ``n_lost``: of these, ids whose pieces don't hold the tokens of all their texts;
    ``n_broken``: ids of one text whose pieces overlap or leave gaps; ``n_split``: texts that were split though they
    fit; ``n_over``: containers over capacity or with a wrong sum; ``well_filled``: whether the containers are full to
    99 % but for one a group of 5,000 items and one more.
    """
    n = token_counts(docs, id_col, text, vocabulary).where("n_tokens > 0")
    whole = n.groupBy("id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"), F.max("n_tokens").alias("longest"))
    p = packed.select(F.col(id_col).cast("bigint").alias("_id"), "first_token", "n_tokens")
    p = p.groupBy("_id").agg(
        F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"),
        F.count_distinct("first_token").alias("starts"),
    )
    each = whole.join(p, F.col("id").eqNullSafe(F.col("_id")), "full_outer")
    sums = each.agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("n_texts"),
        F.count_if(~F.col("tokens").eqNullSafe(F.col("packed"))).alias("n_lost"),
        F.count_if((F.col("texts") == 1) & ((F.col("end") != F.col("tokens")) | (F.col("starts") != F.col("pieces")))).alias("n_broken"),
        F.count_if((F.col("longest") <= capacity) & (F.col("pieces") > F.col("texts"))).alias("n_split"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
    )
    c = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.max("container_tokens").alias("told"))
    full = c.agg(F.count("*").alias("containers"), F.count_if((F.col("held") > capacity) | (F.col("held") != F.col("told"))).alias("n_over"))
    spare = F.ceil(F.col("pieces") / 5000) + 1
    filled = F.col("tokens") >= 0.99 * capacity * (F.col("containers") - spare)
    return sums.crossJoin(F.broadcast(full)).select("n_texts", "n_lost", "n_broken", "n_split", "n_over", filled.alias("well_filled"))
