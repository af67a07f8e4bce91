"""Line dedup: a deletion-neighbourhood join over words, in DataFrame operations alone.

A line is compared by its words: lower case, white space collapsed. Two lines are near-duplicates if they are
equal, or if one word inserted, removed or replaced makes them equal and the longer has at least
``MIN_WORDS`` words (so at least 0.8 of it agrees). A line goes if any line before it in the corpus, by
(doc_id, line number), is a near-duplicate of it; the earliest stays. Lines without words stay.

Method. Distinct lines emit their deletion variants, each as one hashed key: the line itself and the line
without each of its words. Variants that are equal meet: a line and another's deletion (one word inserted), or two
deletions at one place (one word replaced). In a group of equal variants every member is compared with the
earliest alone, which suffices for "some earlier line is near" and is linear in the group; candidates
are then verified by word edit distance on the texts.

Variants that can't meet any other are left out, exactly. One edit leaves the first half or the last half of the
words untouched, so lines whose halves no other line has are dropped. The others are cut into eight zones: an
edit in a zone leaves all words outside it untouched, so only zones whose outside another line has emit variants,
and only those of their own words.

Defined results: a null text has no lines and stays null; a row without doc_id counts as after all others; rows
that agree in doc_id and text are one document and get one outcome; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import passing, pinned, quoted, scratch_path, table, written

MIN_WORDS = 5
#: Zones in either half of a line.
ZONES = 4
#: A word: anything but white space (\x20, \x09-\x0D).
WORDED = r"[^\x20\x09-\x0D]"
#: A key that more than so many rows share, and more than one in ``HOT_ROWS`` of them, is a hot one; there are fewer than ``HOT_ROWS`` of them.
HOT_LEAST, HOT_ROWS = 4096, 10_000
#: Up to so many lines with a possible partner (about 100 bytes each) are sent to all executors; beyond, texts are shuffled to them.
BROADCAST_LINES = 200_000


def _normal(line: Column) -> Column:
    """Lower case, white space collapsed to single blanks. Runs are rare, so only lines that hold one pay for it."""
    x = F.lower(line)
    for c in "\t\x0b\f\r":
        x = F.replace(x, F.lit(c), F.lit(" "))
    return F.trim(F.when(F.instr(x, "  ") > 0, F.regexp_replace(x, " +", " ")).otherwise(x))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _tags(n: Column) -> list[tuple[Column, Column | None]]:
    """Numbers m, each at most half the words, such that lines whose lengths differ by at most one have one in common.

    Even n has n / 2 and n / 2 - 1, odd n only (n - 1) / 2; the condition is null where the number always applies.
    """
    return [(F.floor(n / 2).cast("int"), None), ((F.floor(n / 2) - 1).cast("int"), n % 2 == 0)]


def _half_keys(norm: Column, n: Column, least: int) -> Column:
    """Keys of the first and the last m words for the line's tags m; none for lines too short to have a partner."""
    keys = []
    for m, only in _tags(n):
        ok = (n >= least - 1) & (F.lit(True) if only is None else only)
        keys += [F.when(ok, F.xxhash64(m, F.lit(side), F.call_function("substring_index", norm, F.lit(" "), m * side))) for side in (1, -1)]
    return F.array_compact(F.array(*keys))


def _zones(words: Column, n: Column) -> Column:
    """Zones as ``array<struct<key, left, right>>``: the words but the first ``left`` and last ``right``; the key is of those."""
    out = []
    for m, only in _tags(n):
        cut = [F.floor(m * k / ZONES).cast("int") for k in range(ZONES + 1)]
        sides = [(cut[k], 2 * m - cut[k + 1]) for k in range(ZONES)] + [(2 * m - cut[k + 1], cut[k]) for k in reversed(range(ZONES))]
        for q, (left, right) in enumerate(sides):
            key = F.xxhash64(m, F.lit(q), F.slice(words, 1, left), F.slice(words, n - right + 1, right))
            zone = F.struct(key.alias("key"), left.alias("left"), right.alias("right"))
            k = min(q, 2 * ZONES - 1 - q)
            # the last zone takes what the halves leave over, so it is never empty
            here = F.lit(True) if q == 2 * ZONES - 1 else cut[k] < cut[k + 1]
            out.append(F.when(here if only is None else here & only, zone))
    return F.array_compact(F.array(*out))


def _few(df: DataFrame, most: int, n: str) -> DataFrame:
    """``df``, marked to be sent to all executors if the sum of its column ``n`` is at most ``most``; it must be written already."""
    return F.broadcast(df) if (df.agg(F.sum(n)).first()[0] or 0) <= most else df


def _hot(total: int) -> int:
    """The count from which a key is a hot one. Of ``total`` rows fewer than ``HOT_ROWS`` keys reach it, so a table of them can always be sent to all executors."""
    return max(HOT_LEAST, total // HOT_ROWS)


def _join_split(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``left``, of ``total`` rows, with ``right``, one row per key with ``c``, how often ``left`` has it.

    A key that many rows share would meet its one row in one task; such keys are sent to all executors instead.
    """
    hot = F.broadcast(right.filter(F.col("c") > _hot(total)).drop("c"))
    rest = left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col("c") <= _hot(total)).drop("c"), on)
    return left.join(hot, on).unionByName(rest)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per line with words: where it stands, two hashes of its normal form, its words and its half keys."""
    lines = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("ln", "line")).filter(F.col("line").rlike(WORDED))
    lines = lines.select("doc_id", "th", "ln", _normal(F.col("line")).alias("norm"))
    lines = lines.withColumn("n", (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("int"))
    return lines.select("doc_id", "th", "ln", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"), _half_keys(F.col("norm"), F.col("n"), min_words).alias("halves"))


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "th", "ln")


def variants(zones: DataFrame) -> DataFrame:
    """From (h1, h2, rank, n, key, seg): (key, place, h1, h2, rank, n); place is null for the line itself, else that of the word left out."""
    size = F.size("seg")
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.xxhash64("key", F.slice("seg", 1, i), F.slice("seg", i + 2, size)).alias("key"), i.alias("place")))
    whole = F.array(F.struct(F.xxhash64("key", "seg").alias("key"), F.lit(None).cast("int").alias("place")))
    return zones.select("h1", "h2", "rank", "n", F.explode(F.when(size > 0, F.concat(whole, cut)).otherwise(whole)).alias("v")).select("v.key", "v.place", "h1", "h2", "rank", "n")


def one_edit(a: Column, b: Column) -> Column:
    """True if word arrays ``a`` and ``b`` are equal or one word inserted, removed or replaced makes them so."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1
    at = F.array_position(F.zip_with(F.slice(long, 1, F.size(short)), short, lambda x, y: x == y), False)
    at = F.when(at == 0, F.size(short) + 1).otherwise(at).cast("int")
    inserted = F.slice(long, at + 1, F.size(long) - at) == F.slice(short, at, F.size(short) - at + 1)
    return F.when(F.size(a) == F.size(b), replaced).when(F.size(long) == F.size(short) + 1, inserted).otherwise(False)


def near_lines(docs: DataFrame, firsts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier distinct line is within one edit of."""
    halves = written(firsts.select("h1", F.explode("halves").alias("half")), "lines-halves")
    shared = written(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("c")).filter("a <> b").select("half", "c"), "lines-shared")
    alive = written(_join_split(halves, shared, ["half"], halves.count()).select("h1").distinct(), "lines-met")
    where = firsts.join(alive, "h1", "left_semi").select(F.col("rank.doc_id").alias("d"), F.col("rank.missing").alias("m"), F.col("rank.th").alias("t"), F.struct(F.col("rank.ln").alias("ln"), "h1", "h2").alias("at"))
    wanted = written(where.groupBy("d", "m", "t").agg(F.collect_list("at").alias("at"), F.count("*").alias("c")), "lines-wanted")
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("m"), F.xxhash64("text").alias("t"), "text")
    chosen = keyed.join(_few(wanted, BROADCAST_LINES, "c"), ["d", "m", "t"]).select("d", "m", "t", _lines(F.col("text")).alias("ls"), "at")
    chosen = chosen.select("d", "m", "t", F.explode(F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["ln"].alias("ln"), F.get("ls", x["ln"]).alias("line")))).alias("x"))
    rank = F.struct(F.col("m").alias("missing"), F.col("d").alias("doc_id"), F.col("t").alias("th"), F.col("x.ln").alias("ln")).alias("rank")
    texts = chosen.select("x.h1", "x.h2", rank, F.split(_normal(F.col("x.line")), " ").alias("words")).dropDuplicates(["h1", "h2"])
    texts = written(texts.withColumn("n", F.size("words")), "lines-texts")
    zones = texts.select("h1", "h2", F.explode(_zones(F.col("words"), F.col("n"))).alias("z")).select("h1", "h2", "z.*")
    zones = written(zones, "lines-zones")
    common = zones.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("c")).filter("a <> b").select("key", "c")
    zones = _join_split(zones, written(common, "lines-common"), ["key"], zones.count()).join(texts, ["h1", "h2"])
    lines = zones.select("h1", "h2", "rank", "n", "key", F.slice("words", F.col("left") + 1, F.col("n") - F.col("left") - F.col("right")).alias("seg"))
    keys = written(variants(lines), "lines-variants")
    me = F.struct("rank", "h1", "h2")
    total = keys.count()
    met = keys.groupBy("key").agg(F.min(F.when(F.col("place").isNull(), me)).alias("whole"), F.min(F.when(F.col("place").isNotNull(), me)).alias("cut"), F.count("*").alias("c")).filter("whole IS NOT NULL AND cut IS NOT NULL")
    inserted = _join_split(keys, written(met, "lines-inserted"), ["key"], total).withColumn("hub", F.when(F.col("place").isNull(), F.col("cut")).otherwise(F.col("whole")))
    same = keys.filter(F.col("place").isNotNull() & (F.col("n") >= min_words))
    tops = same.groupBy("key", "place").agg(F.min(me).alias("hub"), F.count("*").alias("c")).filter("c > 1")
    replaced = _join_split(same, written(tops, "lines-replaced"), ["key", "place"], total)
    pick = ["h1", "h2", F.col("hub.h1").alias("g1"), F.col("hub.h2").alias("g2")]
    pairs = inserted.filter("hub.rank < rank").select(*pick).union(replaced.filter("hub.rank < rank").select(*pick)).distinct()
    texts = texts.select("h1", "h2", "words")
    pairs = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("hub_words")), ["g1", "g2"])
    long = F.greatest(F.size("words"), F.size("hub_words"))
    return pairs.filter((long >= min_words) & one_edit(F.col("words"), F.col("hub_words"))).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``, and ``n_lines`` (with words), ``n_exact``, ``n_near`` (gone as equal, as near)."""
    core = docs.select("doc_id", "text")
    lines = written(line_table(core, min_words), "lines")
    spark = docs.sparkSession
    path = scratch_path(spark, "lines-status")
    with passing(spark):
        firsts = written(lines.select("h1", "h2", _rank().alias("rank"), "halves").groupBy("h1", "h2").agg(F.min("rank").alias("rank"), F.count("*").alias("c"), F.any_value("halves").alias("halves")), "lines-first")
        near = near_lines(core, firsts, min_words).withColumn("near", F.lit(True))
        status = firsts.select("h1", "h2", "rank", "c").join(near, ["h1", "h2"], "left").filter("near OR c > 1")
        status = status.select("h1", "h2", F.col("rank").alias("first"), F.coalesce("near", F.lit(False)).alias("near"), "c")
        status.write.parquet(path)
    status = spark.read.schema(status.schema).parquet(path)
    gone = _join_split(lines.select("h1", "h2", "doc_id", "th", "ln"), status, ["h1", "h2"], lines.count())
    exact = _rank() != F.col("first")
    gone = gone.filter(F.col("near") | exact)
    per_doc = gone.groupBy("doc_id", "th").agg(F.collect_set("ln").alias("gone"), F.size(F.collect_set(F.when(exact, F.col("ln")))).alias("n")).select(F.struct("doc_id", "th", "gone", "n").alias("x"))
    # whatever other columns there are, and however they are called, stays within one struct
    mine = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), _lines(F.col("text")).alias("ls"), F.xxhash64("text").alias("th"), F.col("doc_id").alias("id"))
    both = mine.join(per_doc, F.col("id").eqNullSafe(F.col("x.doc_id")) & (F.col("th") == F.col("x.th")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "x.gone")
    text = F.when(F.col("x.gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("ls", i)), "\n"))
    n_lines = F.size(F.filter("ls", lambda x: x.rlike(WORDED)))
    n_exact = F.coalesce("x.n", F.lit(0))
    made = {
        "text": text,
        "n_lines": F.greatest(n_lines, F.lit(0)).cast("long"),
        "n_exact": n_exact.cast("long"),
        "n_near": (F.greatest(F.coalesce(F.size("x.gone"), F.lit(0)), F.lit(0)) - n_exact).cast("long"),
    }
    rest = [c for c in docs.columns if c not in made]
    out = pinned(both.select(F.col("row").alias("row"), "ls", "x"), made, ["row"])
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c in rest or c == "text"]
    return out.select(*own, "n_lines", "n_exact", "n_near")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with words, lines gone as equal and as near, and what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, ln) AS r FROM n WHERE norm <> ''),
f AS (SELECT norm, min(r) AS r, string_split(norm, ' ') AS ws FROM o GROUP BY norm),
d AS (SELECT norm, r, len(ws) AS k, i, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM f)),
near AS (SELECT a.norm FROM d a JOIN f b ON a.v = b.norm WHERE b.r < a.r AND a.k >= 5
  UNION SELECT b.norm FROM d a JOIN f b ON a.v = b.norm WHERE a.r < b.r AND a.k >= 5
  UNION SELECT norm FROM (SELECT norm, r, min(r) OVER (PARTITION BY v, i) AS top FROM d WHERE k >= 5) WHERE top < r),
g AS (SELECT o.doc_id, o.ln, o.r <> f.r AS exact, near.norm IS NOT NULL AS near FROM o JOIN f USING (norm) LEFT JOIN near USING (norm)),
c AS (SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near, count(*) AS n_lines FROM g GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS kept FROM l LEFT JOIN g USING (doc_id, ln) WHERE NOT coalesce(exact OR near, FALSE) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN text IS NOT NULL THEN length(coalesce(kept, ''))::BIGINT END AS kept_chars, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
