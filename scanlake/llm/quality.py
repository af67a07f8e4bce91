"""Quality rules: a threshold table compiled into one projection of Spark expressions, without user functions.

``features`` derives counts from a text; ``THRESHOLDS`` states which ratios of them a document must keep; ``verdict``
compiles the table into one boolean expression. Repeated windows are found by 64-bit hashes of eight
words within one text.

Defined results: a null text is an empty one; texts under ``MIN_WORDS`` words fail; a row without doc_id
is judged like any other; repeated rows are returned as often as they come; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import pinned, quoted, table

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
#: Of 100 words, so many may lie in windows that the text repeats.
MAX_REPEATED = 30
#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he this are at from or have an they which you were",
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas plus au avec il elle ce se ne son ou",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er so wie bei nach",
    "es": "el la los las de del y en un una que por con para es su se al lo como más pero no sus le o este",
}
#: (ratio, least, most): null is no bound. A document outside any bound is rejected.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 2.5, 12.0),
    ("symbols_per_word", None, 0.1),
    ("shouts_per_word", None, 0.1),
    ("stop_word_ratio", 0.05, None),
    ("duplicate_line_ratio", None, 0.5),
]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _from(a: Column, start: int) -> Column:
    """The array from its 1-based ``start`` on."""
    return F.slice(a, start, F.greatest(F.size(a) - (start - 1), F.lit(0)))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use; names that the counts take replace columns of ``docs``."""
    own = [F.col(quoted(c)) for c in docs.columns]
    step = docs.select(F.struct(*own).alias("_row"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text"))
    step = step.withColumn("_trimmed", F.btrim("_text", F.lit(SPACE)))
    step = step.select("_row", "_text", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACES)).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    step = step.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"), lines.alias("_lines"))
    step = step.withColumn("_h", F.zip_with("_h", _from(F.col("_h"), 2), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h", F.zip_with("_h", _from(F.col("_h"), 3), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h", F.zip_with("_h", _from(F.col("_h"), 5), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_sorted", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed))
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i + 1)["h"]) | (x["h"] == F.get("_sorted", i - 1)["h"]))
    step = step.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with(_from(F.col("_starts"), 2), F.slice("_starts", 1, F.greatest(F.size("_starts") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)).cast("long"))
    repeated = F.when(F.col("_starts").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated,
        "n_lines": F.size("_lines").cast("long"),
        "n_shouts": F.regexp_count("_text", F.lit("!")).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))).cast("long"),
    }
    step = pinned(step, counts, ["_row"])
    return step.select(*[F.col("_row." + quoted(c)).alias(c) for c in docs.columns if c not in counts], *counts)


def ratios() -> dict[str, Column]:
    """The ratios that ``THRESHOLDS`` names, of a document with at least one word."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "shouts_per_word": F.col("n_shouts") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "duplicate_line_ratio": F.col("n_dup_lines") / lines,
    }


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def verdict(thresholds: list[tuple[str, float | None, float | None]] | None = None) -> Column:
    """The threshold table as one expression: true if the document is kept."""
    kept, values = ~base_failed(), ratios()
    for name, least, most in THRESHOLDS if thresholds is None else thresholds:
        if least is not None:
            kept = kept & (values[name] >= least)
        if most is not None:
            kept = kept & (values[name] <= most)
    return kept


def judge(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with all counts, ``base_failed`` and ``kept``."""
    rows = features(docs, text_col)
    own = [F.col(quoted(c)) for c in rows.columns if c not in ("base_failed", "kept")]
    return rows.select(*own, base_failed().alias("base_failed"), verdict(thresholds).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *_BASE, "base_failed", "kept")


OP6_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, ws[i:i + 7] AS x FROM win) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
gap AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM dup),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gap GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS n_shouts,
  len(list_filter(ws, lambda x: list_contains({sorted({w for ws in STOP_WORDS.values() for w in ws.split()})!r}, lower(rtrim(x, '.,;:!?'))))) AS n_stop FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12
  AND n_symbols / n_words <= 0.1 AND n_shouts / n_words <= 0.1 AND n_stop / n_words >= 0.05 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept FROM b
"""
