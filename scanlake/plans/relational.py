"""The corpus-level operators applied to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.dims import AMPLIFICATION_BLOCK, AMPLIFICATION_FLOOR, AMPLIFICATION_WARN, CODEC_CVES, CRITICAL_TAGS, FRAME_CAP, PHI_PATTERNS, PROFILE_TAGS
from scanlake.findings import category_prevalence, check_severity_pivot, severity_rank, summarize, verdict_distribution, worst
from scanlake.functions.binary import shannon_entropy
from scanlake.functions.stats import mcnemar_chi2, rule_of_three
from scanlake.operators import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    severity = F.when(e == "error", "fail").when(e == "purchase", "warn").when(e == "signup", "info").otherwise("pass")
    return read(spark, sf, "events", "user_id", "event_type").withColumn("severity", severity)


_SEVERITY = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' ELSE 'pass' END"
_ROLLUP = f"""
SELECT user_id, 0::BIGINT AS n_critical, count(*) FILTER (s = 'fail') AS n_fail, count(*) FILTER (s = 'warn') AS n_warn, count(*) FILTER (s = 'info') AS n_info,
  count(*) FILTER (s = 'pass') AS n_pass, CASE WHEN count(*) FILTER (s = 'fail') > 0 THEN 'FAIL' WHEN count(*) FILTER (s = 'warn') > 2 THEN 'SUSPICIOUS'
  WHEN count(*) FILTER (s = 'warn') > 0 THEN 'CAUTION' ELSE 'CLEAN' END AS overall, count(*) AS total_checks FROM (SELECT user_id, {_SEVERITY} AS s FROM events) GROUP BY user_id"""


@query(f"SELECT *, CASE overall WHEN 'FAIL' THEN 0.2::DOUBLE WHEN 'SUSPICIOUS' THEN 0.4::DOUBLE WHEN 'CAUTION' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS trust_score FROM ({_ROLLUP})")
def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict rollup (A1): events as findings, users as files."""
    return summarize(_events(spark, sf), "user_id")


@query(f"""WITH v AS ({_ROLLUP}) SELECT overall, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v), 6)::DOUBLE AS pct,
  list_position(['CRITICAL', 'FAIL', 'SUSPICIOUS', 'CAUTION', 'CLEAN'], overall)::INT AS ord FROM v GROUP BY overall""")
def verdict_distribution_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict distribution (A3)."""
    return rounded(verdict_distribution(summarize(_events(spark, sf), "user_id")))


@query(f"SELECT event_type AS \"check\", count(DISTINCT user_id) AS files FROM (SELECT *, {_SEVERITY} AS s FROM events) WHERE s IN ('warn', 'fail') GROUP BY 1 ORDER BY files DESC, 1 LIMIT 10")
def category_prevalence_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a finding of each category, the ten most frequent."""
    return category_prevalence(_events(spark, sf), "user_id", "event_type", top=10)


@query(f"SELECT user_id, ['pass', 'info', 'warn', 'fail'][max(list_position(['pass', 'info', 'warn', 'fail'], {_SEVERITY}))] AS worst FROM events GROUP BY user_id")
def worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Gravest severity per file."""
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("severity", severity_rank("severity")).alias("worst"))


@query(f"""SELECT event_type AS "check", count(*) FILTER (s = 'pass') AS n_pass, count(*) FILTER (s = 'info') AS n_info, count(*) FILTER (s = 'warn') AS n_warn,
  count(*) FILTER (s = 'fail') AS n_fail, 0::BIGINT AS n_critical, count(*) FILTER (s = 'fail') AS n_blocking,
  coalesce((list_sort(list_distinct(list(user_id) FILTER (s = 'fail'))))[1:5], []) AS examples FROM (SELECT *, {_SEVERITY} AS s FROM events) GROUP BY 1""")
def check_severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Check by severity, with the first five blocked files."""
    return check_severity_pivot(_events(spark, sf), "user_id", "event_type")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def sha256_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct contents, first key each."""
    return C.content_dedupe(read(spark, sf, "documents", "doc_id", "text"), F.col("text"), "doc_id")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL),
  p AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY doc_id""")
def shannon_entropy_by_document(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of each document's characters (F1), within the row: no shuffle."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return rounded(read(spark, sf, "documents", "doc_id", "text").select("doc_id", shannon_entropy(chars).alias("entropy")))


_MARKERS = [("<!DOCTYPE html><html lang=\"de\"", "doctype-de"), ("<!DOCTYPE html>", "doctype"), ("<html", "html"), ("<?xml", "xml"), ("%PDF", "pdf"), ("PK\x03\x04", "zip")]


@query("SELECT page_id, CASE " + " ".join(f"WHEN starts_with(html, '{m}') THEN '{n}'" for m, n in _MARKERS[:-1]) + " END AS signature FROM pages")
def signature_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """First matching signature at the start."""
    from scanlake.functions.binary import signature_at_start

    marks = [(m.encode(), n) for m, n in _MARKERS]
    return read(spark, sf, "pages", "page_id", "html").select("page_id", signature_at_start(F.col("html").cast("binary"), marks).alias("signature"))


_INSIDE = [("<script", "script"), ("<style", "style"), ("<form", "form")]


@query("""WITH h AS (SELECT page_id, CASE WHEN encode(html) IS NOT NULL THEN substr(decode(encode(html)), 1, 4096) END AS w, html FROM pages)
SELECT page_id, CASE WHEN octet_length(encode(html)) > 0 THEN found END AS marker FROM (SELECT page_id, html, CASE """
+ " ".join(f"WHEN starts_with(html, '{m}') THEN '{n}'" for m, n in _INSIDE)
+ " "
+ " ".join(f"WHEN instr(html, '{m}') > 1 AND octet_length(encode(substr(html, 1, (instr(html, '{m}') - 1)::BIGINT))) + {len(m)} <= 4096 THEN '{n}'" for m, n in _INSIDE)
+ " END AS found FROM h)")
def signature_window(spark: SparkSession, sf: str) -> DataFrame:
    """Long signatures within the first 4096 bytes."""
    from scanlake.functions.binary import signature_in_window

    marks = [(m.encode(), n) for m, n in _INSIDE]
    return read(spark, sf, "pages", "page_id", "html").select("page_id", signature_in_window(F.col("html").cast("binary"), signatures=marks)["name"].alias("marker"))


def _re2(pattern: str) -> str:
    start, end = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    head = r"[\p{L}\p{N}_]" if body.startswith(r"\(") else start
    return head + body.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]") + end


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{_re2(p)}') THEN '{n}' END" for n, p in PHI_PATTERNS) + "], lambda x: x IS NOT NULL) AS matched FROM documents")
def phi_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of identifiers in each text."""
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", C.phi_matches(F.col("text")).alias("matched"))


def header(**values: Column | str) -> Column:
    """The attributes of a parsed file (``attrs``) from columns; nulls are missing ones."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


#: Attributes, when a customer's header holds them (SQL), and what they hold.
_HELD = [("PatientName", "c_custkey % 2 = 0", "c_name"), ("PatientID", "c_custkey % 3 = 0", "c_custkey"), ("InstitutionName", "c_acctbal > 5000", "c_mktsegment"), ("StationName", "c_nationkey < 12", "c_mktsegment"), ("StudyID", "c_custkey % 5 < 2", "c_nationkey"), ("AccessionNumber", "c_acctbal < 0", "c_name")]
_HELD = [x for x in _HELD if x[0] in {k for _, _, k, _ in PROFILE_TAGS}]
_COUNT = {c: " + ".join(["0", *[f"({when})::INT" for k, when, _ in _HELD if (k in CRITICAL_TAGS) == c]]) for c in (True, False)}


@query(f"""WITH c AS (SELECT c_custkey, {_COUNT[True]} AS n_critical, {_COUNT[False]} AS n_other FROM customer)
  SELECT c_custkey, n_critical::INT AS n_critical, n_other::INT AS n_other, CASE WHEN n_critical > 0 OR n_other > 5 THEN 'fail' WHEN n_other > 0 THEN 'warn' ELSE 'pass' END AS severity FROM c""")
def profile_tags_join(spark: SparkSession, sf: str) -> DataFrame:
    """Profile tags that hold data, critical and other, and the rule on them."""
    from scanlake.operators import privacy

    rows = spark.read.parquet(f"{sf}/customer.parquet")
    rows = rows.select("c_custkey", header(**{k: F.when(F.expr(when), F.col(what)) for k, when, what in _HELD}).alias("attrs"))
    critical, other = privacy.profile_counts()
    return rows.select("c_custkey", critical.alias("n_critical"), other.alias("n_other"), worst(privacy.profile_completeness()).alias("severity"))


_DECODERS = list(CODEC_CVES)


@query("SELECT p_partkey, CASE p_size % 10 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DECODERS)) + " ELSE 'native' END AS decoder, CASE p_size % 10 "
+ " ".join(f"WHEN {i} THEN '{', '.join(c for c, _ in CODEC_CVES[d][:3])}'" for i, d in enumerate(_DECODERS)) + " ELSE '' END AS cves FROM part")
def ts_codec_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Left joins with fixed dimensions and a default (J1, J2, C7): syntax to decoder, decoder to its first three vulnerabilities."""
    syntax = C.dimension(spark, list(enumerate(_DECODERS)), "ts int, decoder string")
    cves = C.dimension(spark, [(d, [i for i, _ in ids]) for d, ids in CODEC_CVES.items()], "decoder string, ids array<string>")
    parts = read(spark, sf, "part", "p_partkey", "p_size").withColumn("ts", F.col("p_size") % 10)
    named = parts.join(syntax, "ts", "left").withColumn("decoder", F.coalesce("decoder", F.lit("native"))).join(cves, "decoder", "left")
    return named.select("p_partkey", "decoder", F.coalesce(F.array_join(F.slice("ids", 1, 3), ", "), F.lit("")).alias("cves"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 2 = 0)::INT + (trim(c_mktsegment) <> 'BUILDING')::INT + (c_acctbal > 0)::INT AS n FROM customer)
  SELECT c_custkey, CASE WHEN n >= 2 THEN 'pass' WHEN n = 1 THEN 'info' ELSE 'warn' END AS severity FROM c""")
def provenance_count(spark: SparkSession, sf: str) -> DataFrame:
    """The rule on non-blank fields of origin (M8)."""
    from scanlake.operators import metadata

    fields = header(
        InstitutionName=F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), Manufacturer=F.when(F.trim("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")), StationName=F.when(F.col("c_acctbal") > 0, "x")
    )
    return read(spark, sf, "customer", "c_custkey", fields.alias("attrs")).select("c_custkey", worst(metadata.provenance()).alias("severity"))


@query("""WITH s AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS crit, count(o_orderkey) FILTER (o_orderpriority <> '1-URGENT') AS other,
  bool_or(o_orderstatus = 'F') AS ft, bool_or(o_orderstatus = 'P') AS pv, max(c_mktsegment) AS seg FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
  p AS (SELECT c_custkey, least(45, 18 * crit + 3 * other) AS struct_pts, least(22, CASE WHEN ft THEN 14 ELSE 0 END + CASE WHEN pv THEN 10 ELSE 0 END) AS text_pts,
  CASE seg WHEN 'BUILDING' THEN 18 ELSE 0 END AS burned_pts, CASE seg WHEN 'MACHINERY' THEN 30 WHEN 'AUTOMOBILE' THEN 18 WHEN 'FURNITURE' THEN 6 ELSE 0 END AS face_pts FROM s)
  SELECT c_custkey, least(100, struct_pts + text_pts + burned_pts + face_pts)::INT AS score, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' WHEN score >= 1 THEN 'LOW' ELSE 'MINIMAL' END AS band FROM p""")
def reid_score(spark: SparkSession, sf: str) -> DataFrame:
    """The additive capped score and its bands (P7). Orders are aggregated before the join."""
    from scanlake.operators.privacy import score_points

    orders = read(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("crit"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("other"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("ft"), F.bool_or(F.col("o_orderstatus") == "P").alias("pv"),
    )
    seg = F.col("c_mktsegment")
    rows = read(spark, sf, "customer", "c_custkey", "c_mktsegment").join(per, "c_custkey", "left")
    face = F.when(seg == "MACHINERY", "fail").when(seg == "AUTOMOBILE", "warn").when(seg == "FURNITURE", "info").otherwise("pass")
    zero, no = F.lit(0), F.lit(False)
    points = score_points(F.coalesce("crit", zero), F.coalesce("other", zero), F.coalesce("ft", no), F.coalesce("pv", no), seg == "BUILDING", no, face)
    return rows.select("c_custkey", points.alias("p")).select("c_custkey", "p.score", "p.band")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["quantity", "extendedprice", "discount", "tax"]
    wide = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *[f"l_{n}" for n in names])
    pairs = ", ".join(f"'{n}', l_{n}" for n in names)
    return wide.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("modality"), F.expr(f"stack(4, {pairs}) AS (feature, value)"))


_LONG = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_returnflag AS modality, '{n}' AS feature, l_{n} AS value FROM lineitem" for n in ("quantity", "extendedprice", "discount", "tax"))
_BASE = f"SELECT modality, feature, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM ({_LONG}) GROUP BY ALL HAVING count(*) >= 3"


@query(f"SELECT modality, feature, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'std', 'median', 'min', 'max', 'p5', 'p95'))} FROM ({_BASE})")
def modality_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Per-modality baselines of features."""
    return rounded(C.baselines(_features(spark, sf), ["modality", "feature"]))


@query(f"""WITH b AS ({_BASE}), z AS (SELECT l_orderkey, l_linenumber, feature, abs(value - mean) / std AS z FROM ({_LONG}) JOIN b USING (modality, feature) WHERE std > 0)
  SELECT l_orderkey, arg_max(feature, z) AS feature, round(max(z), 6) AS z, count(*) AS n_anomalies FROM z WHERE z > 1.6 GROUP BY l_orderkey""")
def zscore_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    """Values beyond a limit of deviations from their baseline, the worst per key."""
    long = _features(spark, sf)
    scored = C.zscores(long, C.moments(long, ["modality", "feature"]), ["modality", "feature"])
    return rounded(C.anomalies(scored, ["l_orderkey"], ["l_linenumber", "feature"], 1.6).select("l_orderkey", "feature", "z", "n_anomalies"))


_W = "(k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n)"
_H = "1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)"


@query(f"""WITH g AS (SELECT quality, count(*) FILTER (toxic = 1)::DOUBLE AS k, count(*)::DOUBLE AS n, grouping(quality)::INT AS is_total FROM labels GROUP BY ROLLUP (quality))
  SELECT quality, k::BIGINT AS k, n::BIGINT AS n, round(k / n, 6) AS p, round(greatest(0, {_W} - {_H}), 6) AS lo, round(least(1, {_W} + {_H}), 6) AS hi, is_total FROM g""")
def wilson_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Rates with Wilson intervals, by group and over all."""
    return rounded(C.rates(read(spark, sf, "labels", "quality", "toxic"), ["quality"], F.col("toxic") == 1))


@query("SELECT quality, count(*) AS n, round(least(1.0, -ln(0.05) / count(*)), 9)::DOUBLE AS upper95 FROM labels GROUP BY quality")
def rule_of_three_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bounds of rates without events."""
    n = read(spark, sf, "labels", "quality").groupBy("quality").agg(F.count("*").alias("n"))
    return rounded(n.select("quality", "n", rule_of_three(F.col("n")).alias("upper95")), 9)


@query("""WITH m AS (SELECT count(*) FILTER (toxic = 1 AND n_chars >= 1000) AS b, count(*) FILTER (toxic = 0 AND n_chars < 1000) AS c, count(*) AS n FROM labels JOIN documents USING (doc_id))
  SELECT b, c, n, round(CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) ** 2 / (b + c)::DOUBLE END, 6) AS chi2 FROM m""")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    """Discordant pairs and their chi-square."""
    rows = read(spark, sf, "labels", "doc_id", "toxic").join(read(spark, sf, "documents", "doc_id", "n_chars"), "doc_id")
    t, long = F.col("toxic") == 1, F.col("n_chars") >= 1000
    c = rows.agg(F.count_if(t & long).alias("b"), F.count_if(~t & ~long).alias("c"), F.count("*").alias("n"))
    return rounded(c.select("*", mcnemar_chi2(F.col("b"), F.col("c")).alias("chi2")))


@query("""SELECT lang AS label, count(*) AS n, count(*) FILTER (toxic = 1) AS detected, count(*) FILTER (quality = 0) AS neut_n, count(*) FILTER (quality = 0 AND toxic = 0) AS neutralized
  FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Detection and neutralisation per class."""
    rows = read(spark, sf, "labels", "doc_id", "toxic", "quality").join(read(spark, sf, "documents", "doc_id", "lang"), "doc_id")
    return C.by_class(rows.select("lang", (F.col("toxic") == 1).alias("detected"), (F.col("quality") == 0).alias("intrinsic_danger"), (F.col("toxic") == 0).alias("neutralized")), "lang")


@query("""WITH b AS (SELECT lang, CASE WHEN quality IS NULL THEN 'skipped' WHEN toxic = 1 THEN 'lossy' WHEN quality = 1 THEN 'exact' ELSE 'break' END AS bucket FROM documents LEFT JOIN labels USING (doc_id))
  SELECT lang, count(*) FILTER (bucket = 'skipped') AS skipped, count(*) FILTER (bucket = 'lossy') AS lossy, count(*) FILTER (bucket = 'exact') AS exact, count(*) FILTER (bucket = 'break') AS broken, count(*) AS total,
  grouping(lang)::INT AS is_total FROM b GROUP BY ROLLUP (lang)""")
def bucket_by_key_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets by key and over all."""
    rows = read(spark, sf, "documents", "doc_id", "lang").join(read(spark, sf, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    bucket = F.when(F.col("quality").isNull(), "skipped").when(F.col("toxic") == 1, "lossy").when(F.col("quality") == 1, "exact").otherwise("break")
    named = (("skipped", "skipped"), ("lossy", "lossy"), ("exact", "exact"), ("break", "broken"))
    out = rows.select("lang", bucket.alias("b")).rollup("lang").agg(*[F.count_if(F.col("b") == k).alias(v) for k, v in named], F.count("*").alias("total"), F.grouping("lang").cast("int").alias("is_total"))
    return out


@query("""WITH c AS (SELECT source, unnest(['long', 'dotted', 'digits']) AS channel, unnest([CASE WHEN n_chars > 2000 THEN 18 ELSE 0 END, CASE WHEN contains(text, '|') THEN 14 ELSE 0 END, CASE WHEN regexp_matches(text, '[0-9]') THEN 10 ELSE 0 END]) AS points FROM documents)
  SELECT source, channel, count(*) FILTER (points > 0) AS hits, count(*) AS n, round(avg(points), 6) AS mean_points, round(100.0 * count(*) FILTER (points > 0) / count(*), 6)::DOUBLE AS pct, grouping(source)::INT AS is_total
  FROM c GROUP BY GROUPING SETS ((source, channel), (channel))""")
def channel_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Unpivoted channels: prevalence and mean points per data set and over all."""
    rows = read(spark, sf, "documents", "source", "text", "n_chars").select(
        "source", F.when(F.col("n_chars") > 2000, 18).otherwise(0).alias("long"), F.when(F.contains("text", F.lit("|")), 14).otherwise(0).alias("dotted"), F.when(F.col("text").rlike("[0-9]"), 10).otherwise(0).alias("digits")
    )
    rows = rows.select("source", F.expr("stack(3, 'long', `long`, 'dotted', dotted, 'digits', digits) AS (channel, points)"))
    hits = F.count_if(F.col("points") > 0)
    out = rows.cube("source", "channel").agg(hits.alias("hits"), F.count("*").alias("n"), F.mean("points").alias("mean_points"), (100.0 * hits / F.count("*")).alias("pct"), F.grouping_id().alias("gid"))
    return rounded(out.filter("gid IN (0, 2)").select("source", "channel", "hits", "n", "mean_points", F.col("pct").cast("double").alias("pct"), (F.col("gid") > 0).cast("int").alias("is_total")))


@query("""WITH p AS (SELECT a.role, sha256(a.text) = sha256(b.text) AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
  SELECT role, count(*) AS pairs, count(*) FILTER (same) AS identical, count(*) FILTER (NOT same) AS changed FROM p GROUP BY role""")
def paired_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes before and after, paired by key (A20, J16, F18). Only hashes are shuffled, not texts."""
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("h").alias("h2"))
    same = F.col("h") == F.col("h2")
    return rows.join(after, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("pairs"), F.count_if(same).alias("identical"), F.count_if(~same).alias("changed"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def perf_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and interpolated percentile."""
    rows = read(spark, sf, "events", "event_type", "value")
    return rounded(rows.groupBy("event_type").agg(F.count("value").alias("n"), F.mean("value").alias("mean"), F.median("value").alias("median"), F.percentile("value", 0.95).alias("p95")))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


_PX = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query(f"SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(max(x) - min(x), 6) AS dynamic_range FROM ({_PX}) GROUP BY vec_id")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel statistics within the row."""
    m = F.col("m")
    std = F.sqrt(_mean(F.transform("px", lambda x: (x - m) * (x - m))))
    rows = _pixels(spark, sf).withColumn("m", _mean(F.col("px")))
    return rounded(rows.select("vec_id", m.alias("mean"), std.alias("std"), F.array_min("px").alias("min"), F.array_max("px").alias("max"), (F.array_max("px") - F.array_min("px")).alias("dynamic_range")))


@query(f"WITH p AS ({_PX}) SELECT a.vec_id, round(corr(a.x, b.x), 6) AS ncc FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = a.i - a.i % 8 + 7 - a.i % 8 GROUP BY a.vec_id")
def mirror_ncc(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of an 8 by 8 image with its mirror image."""
    rows = _pixels(spark, sf).withColumn("m", _mean(F.col("px")))
    centred = rows.select("vec_id", F.transform("px", lambda x: x - F.col("m")).alias("c"))
    pairs = F.transform("c", lambda x, i: x * F.get("c", (i - i % 8 + 7 - i % 8).cast("int")))
    power = F.transform("c", lambda x: x * x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rounded(centred.select("vec_id", F.try_divide(total(pairs), total(power)).alias("ncc")))


@query(f"""WITH p AS (SELECT vec_id, x, i // 16 AS r, i % 8 // 2 AS c, i // 8 % 2 AS y, i % 2 AS z FROM ({_PX})),
  q AS (SELECT vec_id, r, c, sum(x * CASE WHEN y = 0 THEN 1 ELSE -1 END) / 2 AS lh, sum(x * CASE WHEN z = 0 THEN 1 ELSE -1 END) / 2 AS hl, sum(x * CASE WHEN y = z THEN 1 ELSE -1 END) / 2 AS hh FROM p GROUP BY ALL)
  SELECT vec_id, round(sum(lh * lh), 6) AS lh, round(sum(hl * hl), 6) AS hl, round(sum(hh * hh), 6) AS hh FROM q GROUP BY vec_id""")
def haar_level1(spark: SparkSession, sf: str) -> DataFrame:
    """Energies of the first Haar level of an 8 by 8 image."""
    at = lambda k, dy, dx: F.get("px", (F.floor(k / 4) * 16 + k % 4 * 2 + 8 * dy + dx).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit(15))

    def energy(sign: Callable[[int, int], int]) -> Column:
        band = F.transform(blocks, lambda k: sum(at(k, y, x) * sign(y, x) for y in (0, 1) for x in (0, 1)) / 2)
        return F.aggregate(band, F.lit(0.0), lambda s, v: s + v * v)

    return rounded(_pixels(spark, sf).select("vec_id", energy(lambda y, x: 1 - 2 * y).alias("lh"), energy(lambda y, x: 1 - 2 * x).alias("hl"), energy(lambda y, x: 1 if x == y else -1).alias("hh")))


@query("SELECT vec_id, len(list_distinct(u))::INT AS unique_values, CASE WHEN len(list_distinct(u)) <= 32 THEN 'warn' WHEN len(list_distinct(u)) / 65536 < 0.0009 THEN 'info' ELSE 'pass' END AS severity FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 8)::BIGINT) AS u FROM embeddings)")
def bit_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values against the declared depth."""
    n = F.size(F.array_distinct(F.transform("px", lambda x: F.floor(x * 8))))
    return _pixels(spark, sf).select("vec_id", n.alias("unique_values"), F.when(n <= 32, "warn").when(n / 65536 < 0.0009, "info").otherwise("pass").alias("severity"))


@query("SELECT l_returnflag, round(-regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS b2, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 4) AS b1, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def loglog_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Power-law fit on logarithms."""
    rows = read(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").filter("l_quantity > 0 AND l_extendedprice > 0")
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    out = rows.groupBy("l_returnflag").agg((-F.regr_slope(y, x)).alias("b2"), F.round(F.exp(F.regr_intercept(y, x)), 4).alias("b1"), F.regr_r2(y, x).alias("r2"))
    return rounded(out)


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)
  SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts and rates."""
    return rounded(C.confusion(read(spark, sf, "labels", "toxic", "quality"), F.col("toxic"), 1 - F.col("quality")))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(coalesce(max(value) FILTER (event_type = '{t}'), 0.0), 6) AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def matrix_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Feature maps to a matrix, missing as zero."""
    return rounded(C.matrix(read(spark, sf, "events", "user_id", "event_type", "value"), "user_id", "event_type", "value", _TYPES))


@query("""WITH m AS (SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_shipmonth)::BIGINT AS cum FROM m""")
def throughput_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Files per period and cumulated (A6, A26), aggregated before the window."""
    rows = read(spark, sf, "lineitem", "l_returnflag", F.trunc("l_shipdate", "month").alias("l_shipmonth")).groupBy("l_returnflag", "l_shipmonth").agg(F.count("*").alias("n"))
    order = Window.partitionBy("l_returnflag").orderBy("l_shipmonth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum("n").over(order))


@query("SELECT doc_id, sha256(text) AS sha256, rank FROM (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def largest_files_top20(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the twenty first files by an order."""
    rows = read(spark, sf, "documents", "doc_id", "text", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))


@query("SELECT s_name AS name, 'supplier' AS origin, s_acctbal AS bal FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT c_name, 'customer', c_acctbal FROM customer WHERE c_acctbal < 0")
def concatenate_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Corpora with labels, one after another."""
    a = read(spark, sf, "supplier", F.col("s_name").alias("name"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("bal"))
    b = read(spark, sf, "customer", F.col("c_name").alias("name"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(b).filter("bal < 0")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'P' THEN 'warn' ELSE 'clean' END AS expected, CASE WHEN o_totalprice > 200000 THEN 'block' WHEN o_totalprice > 100000 THEN 'warn' ELSE 'clean' END AS verdict FROM orders)
  SELECT expected, verdict, count(*) AS n, bool_and(CASE expected WHEN 'clean' THEN verdict <> 'block' WHEN 'block' THEN verdict = 'block' ELSE verdict IN ('warn', 'block') END) AS detected FROM o GROUP BY ALL""")
def detected_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts against labels."""
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    rows = read(spark, sf, "orders", "o_orderstatus", "o_totalprice").select(
        F.when(s == "F", "block").when(s == "P", "warn").otherwise("clean").alias("expected"), C.verdict_of_rank(F.when(p > 200000, 3).when(p > 100000, 2).otherwise(0)).alias("verdict")
    )
    return rows.groupBy("expected", "verdict").agg(F.count("*").alias("n"), F.bool_and(C.detected(F.col("expected"), F.col("verdict"))).alias("detected"))


@query("""WITH m AS (SELECT o_custkey, list(CASE o_orderstatus WHEN 'F' THEN 'clean' WHEN 'O' THEN 'crash(sig11)' ELSE 'n/a' END) AS v FROM orders GROUP BY 1)
  SELECT o_custkey, len(list_filter(v, lambda x: starts_with(x, 'crash'))) > 0 AS dangerous, len(list_filter(v, lambda x: x <> 'n/a')) > 0 AND len(list_filter(v, lambda x: x <> 'n/a' AND x <> 'clean')) = 0 AS accepted FROM m""")
def outcome_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes per target: danger, and acceptance by all."""
    s = F.col("o_orderstatus")
    rows = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", F.col("o_orderkey").cast("string").alias("t"), F.when(s == "F", "clean").when(s == "O", "crash(sig11)").otherwise("n/a").alias("v"))
    maps = rows.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    return maps.select("o_custkey", C.outcome_dangerous(F.col("m")).alias("dangerous"), C.all_accept(F.col("m")).alias("accepted"))


