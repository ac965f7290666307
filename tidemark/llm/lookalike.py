"""Visually identical text with different characters, brought to one form."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# Letters of other scripts with the shape of a Latin letter, under that letter. The scope is Cyrillic (with
# its extensions) and Greek, in the shapes of upright fonts; other scripts and styled mathematical letters keep apart.
SHAPES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ",
    "v": "ѵ", "w": "ԝ", "x": "х", "y": "у",
}
# Invisible characters that aren't of the Unicode category Cf, and hyphens that look like the ASCII one.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
HYPHENS = "‐‑﹣"


class Classes:
    """Union-find over strings: code points, sequences of them and the empty string."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        parent = self.parent
        root = s
        while (up := parent.get(root, root)) != root:
            root = up
        while s != root:
            parent[s], s = root, parent.get(s, s)
        parent.setdefault(root, root)
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for s in list(self.parent):
            by.setdefault(self.find(s), []).append(s)
        return list(by.values())


@lru_cache(maxsize=1)
def look_alike_classes() -> list[list[str]]:
    """The transitive classes of strings that look the same.

    Related are: full-width and ASCII forms, one-character blanks and the space, invisible characters and nothing,
    hyphens, the letters of ``SHAPES``, and a character and its canonical decomposition, in full and by one step.
    Sequences whose parts look the same look the same too; that is repeated until nothing changes. Compatibility
    forms (superscripts, fractions, ligatures) aren't related. No class has two ASCII members.
    """
    c = Classes()
    sequences: set[str] = set()
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:  # Hangul syllables follow from their parts below
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        if 0xFF01 <= cp <= 0xFF5E:
            c.union(ch, chr(cp - 0xFEE0))
        elif kind == "Zs":
            c.union(ch, " ")
        elif kind == "Cf" or ch in INVISIBLE:
            c.union(ch, "")
        elif ch in HYPHENS:
            c.union(ch, "-")
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<"):
            step, full = "".join(chr(int(x, 16)) for x in parts.split()), unicodedata.normalize("NFD", ch)
            for s in {step, full}:
                c.union(ch, s)
                if len(s) > 1:
                    sequences.add(s)
    for latin, others in SHAPES.items():
        for ch in others:
            c.union(ch, latin)
    moved = True
    while moved:
        moved, by = False, {}
        for s in sorted(sequences):
            key = "\0".join(c.find(x) for x in s)
            if key in by and c.find(by[key]) != c.find(s):
                c.union(by[key], s)
                moved = True
            by.setdefault(key, s)
    groups = [g for g in c.groups() if len(g) > 1]
    assert all(sum(x.isascii() and x != "" for x in g) <= 1 for g in groups), "two ASCII characters in one class"
    return groups


def representatives(counts: Mapping[str, int] | None = None) -> dict[str, str]:
    """Each member of a class that isn't its representative, with the representative.

    Representative is the member most frequent in ``counts``; at equal counts one code point before several, then the
    smallest. An ASCII member, or nothing for invisible characters, outranks any count: so no ASCII text changes, and
    lower-casing a text in the consistent form stays meaningful.
    """
    counts = counts or {}
    out = {}
    for g in look_alike_classes():
        best = min(g, key=lambda s: (not s.isascii(), -counts.get(s, 0), len(s), s))
        out.update((s, best) for s in g if s != best)
    return out


class Rewriter:
    """Rewrites text to the consistent form: leftmost longest matches of one automaton, until nothing matches.

    The automaton only runs over the spans in which a character that can end a match occurs.
    """

    def __init__(self, to: Mapping[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for s, r in to.items():
            self.automaton.add_word(s, (len(s), r))
        self.automaton.make_automaton()
        self.longest = max(map(len, to), default=1)
        self.ends = np.zeros(sys.maxunicode + 1, bool)
        self.ends[[ord(s[-1]) for s in to]] = True

    def __call__(self, text: str) -> str:
        while not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            hits = np.flatnonzero(self.ends[points])
            if not hits.size:
                break
            cut = np.flatnonzero(np.diff(hits) > 64)
            starts, stops = hits[np.concatenate(([0], cut + 1))], hits[np.concatenate((cut, [-1]))]
            out, at = [], 0
            for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
                for end, (n, r) in self.automaton.iter_long(text, max(0, start + 1 - self.longest), stop + 1):
                    out.append(text[at : end + 1 - n])
                    out.append(r)
                    at = end + 1
            if not out:
                break
            out.append(text[at:])
            text = "".join(out)
        return text


def _numbers(texts: Iterable[str], block: int = 1 << 22) -> Iterator[np.ndarray]:
    """Code points of the texts that aren't ASCII, in blocks; texts are kept apart by a zero."""
    part, n = [], 0
    for t in texts:
        if t and not t.isascii():
            part.append(t)
            n += len(t)
            if n >= block:
                yield np.frombuffer("\0".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                part, n = [], 0
    if part:
        yield np.frombuffer("\0".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)


def member_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each class member occurs in the corpus: (member, n); at most one row per known string.

    Code points are counted by array arithmetic per batch; sequences by what stands before the marks that can end one.
    """
    members = {s for g in look_alike_classes() for s in g}
    singles = np.array(sorted(ord(s) for s in members if len(s) == 1 and not s.isascii()), np.uint32)
    sequences = {s for s in members if len(s) > 1}
    lengths = sorted({len(s) for s in sequences})
    lasts = np.array(sorted({ord(s[-1]) for s in sequences}), np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for a in _numbers(batch.column(0).slice(at, 512).to_pylist()):
                    high = np.flatnonzero(a > 127)
                    values, n = np.unique(a[high], return_counts=True)
                    known = np.isin(values, singles)
                    total.update(dict(zip(map(chr, values[known].tolist()), n[known].tolist(), strict=True)))
                    for end in high[np.isin(a[high], lasts)].tolist():
                        before = "".join(map(chr, a[max(0, end + 1 - lengths[-1]) : end + 1].tolist()))
                        for n in lengths:
                            if before[-n:] in sequences and len(before) >= n:
                                total[before[-n:]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["member", "n"]
        )

    return docs.select(text).mapInArrow(count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))


def corpus_representatives(docs: DataFrame, text: str = "text") -> dict[str, str]:
    """Representatives by the frequencies of the whole corpus. What is collected has a row per known string at most."""
    return representatives({r["member"]: r["n"] for r in member_counts(docs, text).collect()})


def consistent_forms(docs: DataFrame, to: Mapping[str, str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, form): the texts in the consistent form; NULL stays NULL."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Rewriter(to)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = [None if t is None else form(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "form"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(rewrite, f"id {kind}, form string").withColumnRenamed("id", id_col)


def look_alike_digests(docs: DataFrame, to: Mapping[str, str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, raw): 128-bit digests of the consistent form and of the text; rows with NULL text are left out."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, h = Rewriter(to), xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                looks, raws = [], []
                for t in b.column(1).to_pylist():
                    raw = t.encode("utf-8", "surrogatepass")
                    raws.append(h(raw))
                    looks.append(raws[-1] if t.isascii() else h(form(t).encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=["id", "look", "raw"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text)
    return d.mapInArrow(digest, f"id {kind}, look binary, raw binary").withColumnRenamed("id", id_col)


def look_alike_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, raw) of the documents whose text some other, differing text looks like. One row per document.

    NULL texts look like nothing; empty texts are texts. Other columns don't matter. Two passes over the corpus: one
    counts the members of the look-alike classes, one rewrites the texts and keeps digests only.
    """
    d = written(look_alike_digests(docs, corpus_representatives(docs, text), id_col, text), "looks")
    varied = d.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a != b").select("look")
    return d.join(varied, "look", "left_semi").select(id_col, "look", "raw").distinct()


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), a < b: all pairs of documents that look the same and differ in their characters.

    Identical texts are no pair, nor are they compared: differing texts of a class are paired first, then their
    documents joined, so the work is in proportion to the pairs that come out.
    """
    m = written(look_alike_members(docs, id_col, text), "members")
    texts = m.select("look", "raw").distinct()
    two = texts.withColumnRenamed("raw", "raw_a").join(texts.withColumnRenamed("raw", "raw_b"), "look").where("raw_a < raw_b")
    a = m.select(F.col(id_col).alias("_a"), F.col("look"), F.col("raw").alias("raw_a"))
    b = m.select(F.col(id_col).alias("_b"), F.col("look"), F.col("raw").alias("raw_b"))
    j = a.join(two, ["look", "raw_a"]).join(b, ["look", "raw_b"])
    return j.select(F.least("_a", "_b").alias(f"{id_col}_a"), F.greatest("_a", "_b").alias(f"{id_col}_b")).where(
        f"{id_col}_a != {id_col}_b"
    )
