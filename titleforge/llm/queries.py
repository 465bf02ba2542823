"""The registered queries of the operators for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm import copies, langid, mojibake, neardup, overlap, packing, terms, tokens, visual
from titleforge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_lines(table(spark, sf, "prediction_log"), table(spark, sf, "titles"))


def p1_originals(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.originals(table(spark, sf, "prediction_log"), table(spark, sf, "titles"), table(spark, sf, "anchor_titles"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, sf, "titles"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "titles"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(table(spark, sf, "titles"))


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_counts(table(spark, sf, "titles"))


def p3_words(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_counts(table(spark, sf, "titles"), unit="words")


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_counts(table(spark, sf, "titles"), unit="values")


def p3_long(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_counts(table(spark, sf, "titles"), sizes=(1, 5))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_pairs(table(spark, sf, "title_records"))


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapsed(table(spark, sf, "title_records"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual.with_plain_form(table(spark, sf, "titles").select("title_id", "title"), "title").where("disguised").select("title_id").distinct()


def p5_plain(spark: SparkSession, sf: str) -> DataFrame:
    return visual.with_plain_form(table(spark, sf, "titles").select("title_id", "title").distinct(), "title").select("title_id", "plain_form", "disguised")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf, "ml_titles"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p8_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same ids with chunks so short that nearly every text is cut and stitched."""
    return tokens.token_ids(table(spark, sf, "documents"), chunk=256, overlap=64)


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    report = packing.packing_report(p9_packed(spark, sf))
    return report.withColumn("used_share", F.round("used_share", 6))


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), table(spark, sf, "pack_bins"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.found(table(spark, sf, "documents"), table(spark, sf, "lang_list"))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return langid.segments(documents, langid.fit(documents, table(spark, sf, "lang_list"))).withColumn("confidence", F.round("confidence", 6))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_originals, p2_found, p2_report, p3_found, p3_terms, p3_words, p3_values, p3_long, p4_found, p4_collapsed, p5_found, p5_plain, p6_found, p8_ids, p8_chunks, p9_packed, p9_report, p10_found, p10_segments)
}

_ONCE = "WITH once AS (SELECT title_id, min(title) AS title FROM titles WHERE title IS NOT NULL GROUP BY title_id),"
_PLACES = """
places AS (SELECT title_id, title, k, unnest(range(1, length(title) - k + 2)) AS i FROM once, (VALUES (2), (3)) AS sizes(k)),
terms AS (SELECT title_id, substring(title, CAST(i AS INTEGER), k) AS term FROM places),
"""
_MARKS = """
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT title_id) AS records FROM terms GROUP BY 1),
marked AS (
    SELECT term, occurrences, records,
        CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM once) THEN 'common' END AS mark
    FROM counts
)
"""
_TERMS = _ONCE + _PLACES + _MARKS
_KEYED = "WITH keyed AS (SELECT record_id, " + " || chr(31) || ".join(
    rf"regexp_replace(lower(coalesce(json_extract_string(payload, '$.{f}'), '')), '[^\p{{L}}\p{{N}}]+', '', 'g')" for f in copies.FIELDS
) + " AS k FROM title_records WHERE payload IS NOT NULL), kept AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS kept_id FROM keyed)"

SQL: dict[str, str] = {
    "p3_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p3_words": _ONCE + r" terms AS (SELECT title_id, unnest(regexp_extract_all(title, '[\p{L}\p{N}]+')) AS term FROM once)," + _MARKS + "SELECT term, occurrences, records, mark FROM marked",
    "p3_values": _ONCE + " terms AS (SELECT title_id, title AS term FROM once)," + _MARKS + "SELECT term, occurrences, records, mark FROM marked",
    "p3_long": _ONCE + _PLACES.replace("(2), (3)", "(1), (5)") + _MARKS + "SELECT term, occurrences, records, mark FROM marked",
    "p4_found": _KEYED + " SELECT DISTINCT kept_id, record_id AS copy_id FROM kept WHERE record_id <> kept_id",
    "p4_collapsed": _KEYED + " SELECT kept_id, count(*) AS copies FROM kept GROUP BY kept_id",
}
