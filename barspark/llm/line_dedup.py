"""Delete runs of lines that repeat earlier ones, found by winnowing over line hashes.

Lines are split at \\n; lines without a word are kept and not compared. A repeated run counts if it has MIN_RUN
lines or MIN_WORDS words, or is a whole document of fewer lines. Of every window (MIN_RUN consecutive lines, one
or two lines of enough words, a whole short document) the smallest line hash is the fingerprint, so two equal
runs that count select the same lines: none can be missed. Positions are joined on fingerprints; where one
occurs twice, the windows that selected it are compared, and each that stood before is matched with its first
place. Of neighbouring matches on one diagonal only the first is a seed, and it is extended to both sides
through the line hashes of the two documents. The later run (larger doc_id, or later in the same document) is
deleted, with blank lines inside; overlapping and touching runs grow together. Runs are judged on the input,
not on what is left of it.

Windows are compared by 128 bits of hash, lines beside them by 64. Equal windows meet in a partial aggregate
that keeps the first place, never as pairs, and the joins back are ordinary ones that adaptive execution may
split.

Defined results: a null text is an empty one; texts are read whole, however long; rows equal in doc_id and text
are judged once and get the same answer; rows of one doc_id with different texts are ordered by a digest; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty, with_key, words_of

MIN_RUN, MIN_WORDS = 3, 50
HAS_WORD = r"[^\x20\x09-\x0D]"


def _windows(lines: Column, hashes: Column, counts: Column, min_run: int, min_words: int) -> Column:
    """Each window: its start, length, fingerprint (the smallest line hash) and 128-bit hash."""

    def window(i: Column, length: int, whole: bool = False) -> Column:
        part = [F.get(lines, i + k) for k in range(length)]
        least = F.array_min(F.slice(hashes, i + 1, F.lit(length)))
        kind = F.lit(-length if whole else length)
        return F.struct(i.alias("start"), F.lit(length).alias("length"), least.alias("mark"), F.xxhash64(*part).alias("h1"), F.xxhash64(kind, *reversed(part)).alias("h2"))

    def of(length: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - length)
        if length < min_run:
            words = lambda i: sum((F.get(counts, i + k) for k in range(length)), F.lit(0))
            starts = F.filter(starts, lambda i: words(i) >= min_words)
        return F.when(F.size(lines) >= length, F.transform(starts, lambda i: window(i, length)))

    whole = [F.when(F.size(lines) == k, F.array(window(F.lit(0), k, True))) for k in range(1, min_run)]
    none = F.expr("cast(array() as array<struct<start:int,length:int,mark:bigint,h1:bigint,h2:bigint>>)")
    return F.concat(*(F.coalesce(w, none) for w in (*map(of, range(1, min_run + 1)), *whole)))


def _extended(mine: Column, first: Column, start: Column, length: Column, origin: Column) -> Column:
    """The run of lines from lo up to hi around a match that two arrays of line hashes share on one diagonal."""

    def equal(steps: Column, at: Column, sign: int) -> Column:
        """How many steps on from at the two stay equal."""
        differs = F.transform(F.sequence(F.lit(1), steps), lambda k: F.get(mine, at + sign * k) != F.get(first, at - start + origin + sign * k))
        return F.when(steps < 1, 0).otherwise(F.coalesce(F.nullif(F.array_position(differs, True).cast("int"), F.lit(0)) - 1, steps))

    last = start + length - 1
    left = equal(F.least(start, origin), start, -1)
    right = equal(F.least(F.size(mine) - 1 - last, F.size(first) - origin - length), last, 1)
    return F.struct((start - left).alias("lo"), (last + 1 + right).alias("hi"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, gone): the runs, as lo and hi among lines with a word, that repeat an earlier run."""
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(HAS_WORD))
    rows = with_key(docs.select("doc_id", "text")).select("doc_id", "_key", lines.alias("lines")).filter(F.size("lines") > 0)
    rows = rows.select("*", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.size(words_of(x))).alias("counts"))
    windows = _windows(F.col("lines"), F.col("hashes"), F.col("counts"), min_run, min_words)
    rows = settle(rows.select("doc_id", "_key", "hashes", windows.alias("windows")).distinct(), "line-windows")
    # Fingerprints that stand at two places, in one document or in two.
    marks = rows.select(F.explode(F.array_distinct(F.transform("windows", lambda r: F.struct(r["mark"].alias("mark"), r["start"].alias("start"))))).alias("m"))
    met = marks.groupBy("m.mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("mark").alias("_mark"))
    windows = rows.select("doc_id", "_key", F.explode("windows").alias("r")).select("doc_id", "_key", "r.*")
    windows = settle(windows.join(met, F.col("mark") == F.col("_mark"), "left_semi").drop("mark"), "line-met")
    place = F.struct("doc_id", "_key", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    later = later.select("_key", "start", "length", F.col("first._key").alias("_first"), F.col("first.start").alias("origin"))
    along = Window.partitionBy("_key", "_first", F.col("start") - F.col("origin"), "length").orderBy("start")
    seeds = later.withColumn("before", F.lag("start").over(along)).filter("before is null or before < start - 1").drop("before")
    mine = rows.select(F.col("_key").alias("_mine"), F.col("hashes").alias("mine"))
    theirs = rows.select(F.col("_key").alias("_theirs"), F.col("hashes").alias("theirs"))
    seeds = seeds.join(mine, F.col("_key") == F.col("_mine")).join(theirs, F.col("_first") == F.col("_theirs"))
    run = _extended(F.col("mine"), F.col("theirs"), F.col("start"), F.col("length"), F.col("origin"))
    return seeds.select("_key", run.alias("run")).groupBy("_key").agg(F.sort_array(F.collect_set("run")).alias("gone"))


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: n_lines (with a word), n_removed and the kept text."""
    found = repeated_runs(docs, min_run, min_words).withColumnRenamed("_key", "_found")
    rows = with_key(docs.select("doc_id", "text"))
    rows = rows.join(found, F.col("_key") == F.col("_found"), "left").drop("_found")
    lines, lit = F.split(text_or_empty(), "\n"), F.lit
    rows = rows.select("doc_id", "text", "gone", lines.alias("lines"))
    # Places of the lines with a word, and the deleted runs grown together: from, to and number of lines.
    rows = rows.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull()))

    def grow(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, lit(-1))["hi"] >= x["lo"]), F.concat(F.slice(runs, lit(1), F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, F.array(x)))

    none = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
    rows = rows.withColumn("gone", F.when(F.col("gone").isNotNull(), F.aggregate("gone", none, grow)))
    rows = rows.withColumn(
        "gone",
        F.transform("gone", lambda r: F.struct(F.get("at", r["lo"]).alias("lo"), F.get("at", r["hi"] - 1).alias("hi"), (r["hi"] - r["lo"]).alias("n"))),
    )
    end = lambda j: F.coalesce(F.get("gone", j - 1)["hi"], lit(-1))
    between = F.transform("gone", lambda g, j: F.slice("lines", end(j) + 2, g["lo"] - end(j) - 1))
    after = F.slice("lines", end(F.size("gone")) + 2, F.size("lines") - end(F.size("gone")) - 1)
    kept = F.array_join(F.concat(F.flatten(between), after), "\n")
    return rows.select(
        "doc_id",
        F.size("at").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", lit(0), lambda n, g: n + g["n"]), lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text_or_empty()).otherwise(kept).alias("kept_text"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS x FROM d),
w AS (SELECT doc_id, p, x, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS n,
             row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS c
      FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
v AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(n, 1) OVER o AS n1 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, 1 AS c, [x] AS t FROM v WHERE n >= 50
      UNION ALL SELECT doc_id, i, 2, [x, x1] FROM v WHERE x1 IS NOT NULL AND n + n1 >= 50
      UNION ALL SELECT doc_id, i, 3, [x, x1, x2] FROM v WHERE x2 IS NOT NULL
      UNION ALL SELECT doc_id, 1, c, [x, x1, NULL, 'whole'] FROM v WHERE i = 1 AND c < 3),
f AS (SELECT doc_id, i, c, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM r),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM f, (SELECT unnest(range(0, 3)) AS j) o WHERE n > 1 AND j < c),
k AS (SELECT a.doc_id, a.p, a.x, w.i, g.i AS gone, count(w.i) OVER (PARTITION BY a.doc_id ORDER BY a.p) AS i0
      FROM a LEFT JOIN w USING (doc_id, p) LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = w.i),
b AS (SELECT k.*, k.i IS NULL AND g0.i IS NOT NULL AND g1.i IS NOT NULL AS inside FROM k
      LEFT JOIN g g0 ON g0.doc_id = k.doc_id AND g0.i = k.i0 LEFT JOIN g g1 ON g1.doc_id = k.doc_id AND g1.i = k.i0 + 1)
SELECT doc_id, count(i)::BIGINT AS n_lines, count(gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE gone IS NULL AND NOT inside), '')) AS kept_sha256
FROM b GROUP BY doc_id
"""
