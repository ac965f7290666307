"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lookalike import Rewriter, representatives
from tidemark.session import written

# The spaced seeds. A 1 is compared, a 0 ignored; together they compare every position.
MASKS = ("110110110111", "101101111011", "111011011101")
#: Size of the filter over the test windows' hashes, whatever their number: 2^25 bits are 4 MB.
FILTER_BITS = 25
#: Ids of documents with hits are sent to all tasks up to this number.
BROADCAST_IDS = 200_000
#: Of equal words a passage gains one each, of different ones it loses this many; so at least 3 of 4 words are equal.
MISMATCH = 3
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str, form: Rewriter) -> list[str]:
    """Runs of letters and digits in lower case and in the consistent form."""
    if text.isascii():
        return WORD.findall(text.lower())
    return WORD.findall(form(form(text).lower()))


def _numberer() -> Callable[[list[str]], np.ndarray]:
    """Words to 64-bit numbers; those of a task are remembered up to a bound."""

    class Numbers(dict):
        def __missing__(self, w: str) -> int:
            if len(self) > 500_000:
                self.clear()
            x = self[w] = xxhash.xxh3_64_intdigest(w)
            return x

    cache = Numbers()
    return lambda w: np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def _at(h: np.ndarray, mask: str) -> np.ndarray:
    """A 64-bit hash per window, over the compared positions only."""
    n = len(h) - len(mask) + 1
    out = np.full(n, len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out ^= h[i : i + n]
            out *= _MIX
            out ^= out >> np.uint64(29)
    return out


def _bits(h: np.ndarray, mask_no: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a window's hash in the filter."""
    x = (h ^ np.uint64(mask_no + 1)) * _MIX
    return (x >> np.uint64(64 - size)).astype(np.int64), (x & np.uint64((1 << size) - 1)).astype(np.int64)


def seeds(texts: DataFrame, id_col: str, text: str, masks: Sequence[str], to: Mapping[str, str], passing: object = None, size: int = FILTER_BITS) -> DataFrame:
    """(id, seed, hash, pos): hashes of all windows of the texts' words under every mask.

    With ``passing``, a broadcast filter over the hashes of other texts, only those that may be among them.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, numbers = Rewriter(to), _numberer()
        known = None if passing is None else np.frombuffer(passing.value, np.uint8)

        def may(bit: np.ndarray) -> np.ndarray:
            return (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, which, hashes, places = [], [], [], []
                for row, t in enumerate(b.column(1).to_pylist()):
                    h = numbers(words(t, form) if t else [])
                    for m, mask in enumerate(masks):
                        if len(h) < len(mask):
                            continue
                        x = _at(h, mask)
                        if known is None:
                            start = np.arange(len(x))
                        else:
                            first, second = _bits(x, m, size)
                            start = np.flatnonzero(may(first))
                            start = start[may(second[start])]
                        if start.size:
                            ids.append(np.full(start.size, row))
                            which.append(np.full(start.size, m, np.int32))
                            hashes.append(x[start])
                            places.append(start)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(np.concatenate(ids))),
                            pa.array(np.concatenate(which)),
                            pa.array(np.concatenate(hashes).view(np.int64)),
                            pa.array(np.concatenate(places).astype(np.int32)),
                        ],
                        names=["id", "seed", "hash", "pos"],
                    )

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, text)
    return rows.mapInArrow(make, f"id {kind}, seed int, hash bigint, pos int")


def window_filter(windows: DataFrame, size: int = FILTER_BITS) -> bytes:
    """2^``size`` bits, of which each window of (seed, hash) has set two. What comes to the driver is bounded by the filter's size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            bits = np.concatenate([x for m in np.unique(seed).tolist() for x in _bits(h[seed == m], m, size)]) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits))], names=["bit"])

    each = windows.select("seed", "hash").mapInArrow(places, "bit bigint")
    bytes_set = each.groupBy((F.col("bit") / 8).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("set"))
    rows, out = bytes_set.toArrow(), np.zeros(1 << (size - 3), np.uint8)
    out[rows["at"].to_numpy()] = rows["set"].to_numpy()
    return out.tobytes()


def seed_hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
    masks: Sequence[str] = MASKS, size: int = FILTER_BITS,
) -> DataFrame:
    """(doc, item, doc_pos, item_pos, n_seeds): alignments at which at least one mask's window is the same.

    Window hashes of the test items and of the whole training texts are joined on (mask, hash). A hash that occurs in
    very many documents meets only the few rows of the test items under it. Of the training windows only those that
    pass a filter over the test windows are joined; the filter has 2^``size`` bits and is sent once. If the test side
    fills it, more windows pass than need to, and the result is the same.
    """
    to = representatives()
    test = written(seeds(items, item_id, item_text, masks, to), "seeds")
    passing = docs.sparkSession.sparkContext.broadcast(window_filter(test, size))
    test = test.select(F.col("id").alias("item"), "seed", "hash", F.col("pos").alias("item_pos"))
    train = seeds(docs, doc_id, text, masks, to, passing, size).select(F.col("id").alias("doc"), "seed", "hash", F.col("pos").alias("doc_pos"))
    return (
        train.join(test, ["seed", "hash"])
        .groupBy("doc", "item", "doc_pos", "item_pos")
        .agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("seed")))).alias("n_seeds"))
    )


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
    masks: Sequence[str] = MASKS, size: int = FILTER_BITS,
) -> DataFrame:
    """One row per document and test item whose texts share as many consecutive words as the masks are long.

    Words are runs of letters and digits, in lower case and in the consistent form of look-alike characters. All
    masks have one length and together compare every position: where all of them hit at one alignment, the window is
    the same word by word. NULL ids or texts and texts with fewer words give no row; repeated rows give one row.
    """
    assert len(set(map(len, masks))) == 1 and all(any(m[i] == "1" for m in masks) for i in range(len(masks[0])))
    hits = seed_hits(docs, items, doc_id, item_id, text, item_text, masks, size)
    return hits.where(F.col("n_seeds") == len(masks)).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()


def best_runs(equal: np.ndarray, mismatch: int = MISMATCH) -> list[tuple[int, int, int]]:
    """The maximal scoring runs (from, to, equal words) of a row of equal and different words, by a stack of candidates.

    Equal counts 1, different -``mismatch``. The runs are disjoint, each has the highest score of all runs within it
    and can't be made better by a longer one; they begin and end with equal words.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    stack: list[list[int]] = []  # from, to, score before, score at the end, equal words
    total = last = 0
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        total -= (a - last) * mismatch
        run, last = [a, z, total, total + z - a, z - a], z
        total = run[3]
        while True:
            j = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][2] < run[2]), None)
            if j is None or stack[j][3] >= run[3]:
                stack.append(run)
                break
            run = [stack[j][0], run[1], stack[j][2], run[3], sum(x[4] for x in stack[j:]) + run[4]]
            del stack[j:]
    return [(a, z, n) for a, z, _, _, n in stack]


def word_numbers(texts: DataFrame, id_col: str, text: str, to: Mapping[str, str]) -> DataFrame:
    """(id, words): the numbers of a text's words in order, of texts that are short enough for a row: test items."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, numbers = Rewriter(to), _numberer()
        for b in batches:
            out = [numbers(words(t, form)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "words"])

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, text)
    return rows.mapInArrow(number, f"id {kind}, words array<bigint>")


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
    masks: Sequence[str] = MASKS, size: int = FILTER_BITS, least: int = 12,
) -> DataFrame:
    """Passages that overlap with substituted words tolerated: (doc, item, doc_from, item_from, n_words, n_equal).

    Hits lie on diagonals (document position less item position). On each diagonal with a hit the words of both texts
    are compared one by one, and the maximal scoring runs (see :func:`best_runs`) that a hit's window overlaps and
    that have ``least`` or more equal words are the passages: ``n_words`` long, of which ``n_equal`` are equal (more
    than 3 of 4). Documents with the same id are read as one text each; ids of items are unique. NULL ids and texts
    give no row; repeated rows give one.

    Only documents with hits are read again, each once; what is taken from one for an item is as long as the item, so
    no row holds a document's words for every item.
    """
    span = len(masks[0])
    to = representatives()
    hits = seed_hits(docs, items, doc_id, item_id, text, item_text, masks, size)
    hits = hits.groupBy("doc", "item", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set("item_pos").alias("hits"))
    item_words = written(word_numbers(items, item_id, item_text, to), "items")
    length = item_words.select(F.col("id").alias("item"), F.size("words").alias("length"))
    wanted = written(hits.join(length, "item"), "diagonals")
    per_doc = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("item", "diagonal", "length")).alias("cuts"))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, doc_id), (items, item_id))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, numbers = Rewriter(to), _numberer()
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.slice(row, 1)
                w = numbers(words(b.column(1)[0].as_py(), form)).view(np.int64)
                cuts = b.column(2).flatten()
                for at in range(0, len(cuts), 4096):
                    c = cuts.slice(at, 4096)
                    places = zip(c.field("diagonal").to_pylist(), c.field("length").to_pylist(), strict=True)
                    parts = [w[max(0, d) : max(0, d + n)] for d, n in places]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(0)[0], len(c)), c.field("item"), c.field("diagonal"), pa.array(parts, pa.list_(pa.int64()))],
                        names=["doc", "item", "diagonal", "theirs"],
                    )

    found = docs.where(F.col(text).isNotNull()).select(doc_id, text)
    ids = wanted.select(F.col("doc").alias(doc_id)).distinct()
    if ids.count() <= BROADCAST_IDS:  # so that texts without hits aren't shuffled; with more ids the join does it all
        found = found.join(F.broadcast(ids), doc_id, "left_semi")
    found = found.join(per_doc, F.col(doc_id) == F.col("_doc"))
    theirs = found.select(doc_id, text, "cuts").mapInArrow(cut, f"doc {kinds[0]}, item {kinds[1]}, diagonal int, theirs array<bigint>")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, (d, theirs, hits, mine) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)):
                start = max(0, -d)  # the item's first word that has a counterpart
                own = np.array(mine[start : start + len(theirs)], np.int64)
                at = np.array(hits) - start
                for x, z, n in best_runs(own == np.array(theirs, np.int64)):
                    if n >= least and ((at < z) & (at + span > x)).any():
                        rows.append((k, start + x + d, start + x, z - x, n))
            which, *rest = zip(*rows, strict=True) if rows else ([],) * 5
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *(pa.array(x, pa.int32()) for x in rest)],
                names=["doc", "item", "doc_from", "item_from", "n_words", "n_equal"],
            )

    j = theirs.join(wanted.drop("length"), ["doc", "item", "diagonal"]).join(item_words.withColumnRenamed("id", "item"), "item")
    out = j.select("doc", "item", "diagonal", "theirs", "hits", "words").mapInArrow(
        compare, f"doc {kinds[0]}, item {kinds[1]}, doc_from int, item_from int, n_words int, n_equal int"
    )
    return out.distinct().withColumnsRenamed({"doc": doc_id, "item": item_id})
