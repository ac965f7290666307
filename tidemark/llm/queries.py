"""Queries of the training-data problems 1 and 6 to 8, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.leakage import leaked_items, leaked_passages
from tidemark.llm.lookalike import look_alike_members, look_alike_pairs
from tidemark.llm.nearest_time import pair_tables
from tidemark.llm.packing import fill_containers, packing_report
from tidemark.session import written
from tidemark.sources.tables import table, usable


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    fit = F.coalesce("alignment_eligible", F.lit(True)) & usable("mid")
    return pair_tables(
        spark, f"{d}/swap_targets.parquet", f"{d}/reference.parquet", "symbol", "target_id", "target_timestamp", "ref_id", "timestamp",
        3.0, right_filter=fit,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("right_id is not null").select(F.col("left_id").alias("target_id"), F.col("right_id").alias("ref_id"))


def p1_ages(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return p.select(
        F.col("left_id").alias("target_id"),
        F.col("right_id").alias("ref_id"),
        F.round((F.col("left_us") - F.col("right_us")) / 1e6, 6).alias("age_seconds"),
    )


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What the packing of p6_containers must keep, told by tokens counted anew."""
    docs = table(spark, d, "documents")
    return packing_report(docs, written(fill_containers(docs), "packed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text some other text looks like, with the smallest id of those that look the same."""
    m = written(look_alike_members(table(spark, d, "documents")), "members")
    return m.join(m.groupBy("look").agg(F.min("doc_id").alias("class_id")), "look").select("doc_id", "class_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_ages, p6_containers, p6_check, p7_found, p7_passages, p8_found, p8_classes)}

_PAIR = """WITH r AS (SELECT symbol, timestamp, min(ref_id) AS ref_id FROM reference
  WHERE COALESCE(alignment_eligible, TRUE) AND mid IS NOT NULL AND NOT isnan(mid) GROUP BY symbol, timestamp)
SELECT t.target_id, r.ref_id, round((epoch_us(t.target_timestamp) - epoch_us(r.timestamp)) / 1e6, 6) AS age_seconds FROM swap_targets t
ASOF LEFT JOIN r ON t.symbol = r.symbol AND t.target_timestamp >= r.timestamp"""

# Fixed values for the SQL alone, written apart from the operator's classes: what is nothing, what is a blank, what
# looks like the ASCII hyphen, letters with the shape of a Latin one, and accented ones of these.
_NOTHING = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
_HYPHENS = "‐‑﹣"
_CYRILLIC, _AS_CYRILLIC = "АВСЕНІӀЈКМОРԚЅТԜХҮасԁеһіјӏорԛѕѵԝхуЀЁЇѐёїӐӑӒӓӖӗӦӧ", "ABCEHIIJKMOPQSTWXYacdehijlopqsvwxyÈËÏèëïĂăÄäĔĕÖö"
_GREEK, _AS_GREEK = "ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖϲϳοΆΈΊΌΎΪΫό", "ABCEHIJKMNOPTXYZcjoÁÉÍÓÝÏŸó"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_AS_WIDE = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _form(text: str) -> str:
    plain = rf"regexp_replace(regexp_replace(nfc_normalize({text}), '{_NOTHING}', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    return f"nfc_normalize(translate({plain}, '{_HYPHENS}{_CYRILLIC}{_GREEK}{_WIDE}', '---{_AS_CYRILLIC}{_AS_GREEK}{_AS_WIDE}'))"


def _grams(table: str, i: str) -> str:
    """Every 12 consecutive words of a table's texts."""
    after = " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, 12))
    words = rf"regexp_extract_all({_form(f'lower({_form("text")})')}, '[\p{{L}}\p{{N}}]+')"
    return f"""(SELECT {i}, word || ' ' || {after} AS gram FROM (SELECT {i}, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT {i}, {words} AS w FROM {table}))
  WINDOW o AS (PARTITION BY {i} ORDER BY pos))"""


ORACLES = {
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_grams('documents', 'doc_id')} JOIN {_grams('eval_items', 'item_id')} USING (gram) WHERE gram IS NOT NULL",
    "p8_classes": f"""WITH f AS (SELECT doc_id, text, {_form("text")} AS form FROM documents WHERE text IS NOT NULL),
v AS (SELECT form, min(doc_id) AS class_id FROM f GROUP BY form HAVING count(DISTINCT text) > 1) SELECT doc_id, class_id FROM f JOIN v USING (form)""",
    "p8_found": f"""WITH f AS (SELECT doc_id, text, {_form("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p6_check": """SELECT count(*) FILTER (text <> '') AS n_texts, 0::BIGINT AS n_lost, 0::BIGINT AS n_broken, 0::BIGINT AS n_split, 0::BIGINT AS n_over, TRUE AS well_filled
FROM documents""",
    "p1_found": f"SELECT target_id, ref_id FROM ({_PAIR}) WHERE age_seconds <= 3",
    "p1_ages": f"""SELECT target_id, CASE WHEN age_seconds <= 3 THEN ref_id END AS ref_id,
  CASE WHEN age_seconds <= 3 THEN age_seconds END AS age_seconds FROM ({_PAIR})""",
}
