"""Mix sources to target weights with a low-discrepancy schedule of equal blocks.

Each source's documents are put in a shuffled order (by a digest of doc_id) and their words form a stream
that is cut into blocks of equally many words (the last may be shorter). As many whole passes as a target holds
are taken exactly; what is left of it is a part of one more pass and is scheduled. The schedule is a sequence of
slots: slot j is the point j * golden ratio (mod 1), mapped through the cumulative weights of what is left to a
source, so every stretch of the schedule is near these weights. A source's r-th slot takes its r-th block.

Orders and offsets come from two levels (inside a bucket, then over about sqrt(rows) buckets), so no source
is ordered in one task. All schedule arithmetic is on integers, so reruns agree.

Defined results: a null text has no words and takes none; null is a source of its own, last in order;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty, words_of

#: Weights of the sources in code point order, repeating; a source is taken this many times at most.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Words in a block, and the slots a mix has at least (blocks of a small corpus are shorter).
BLOCK_WORDS = 256
MIN_SLOTS = 65_536
#: Neighbouring Fibonacci numbers: their quotient stands for the golden ratio, and no point repeats before the second.
GOLDEN = (2504730781961, 4052739537881)
#: Slot weights are whole thousandths of a slot.
UNIT = 1000


def _sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source with its rank in code point order (null last), weight and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks over ranges: rows are ranked inside a range, and the ranges' counts are added up.
    order = [F.col("source").isNull(), F.col("source")]
    ranged = settle(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    ranged = ranged.join(before, "part").withColumn("sid", rank.cast("long")).drop("part", "before")
    return ranged.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))


def _targets(sources: DataFrame, max_passes: int) -> DataFrame:
    """Add target: shares of all words by weight, with what a full source cannot take shared out again."""
    most = max_passes * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        done = most <= level * F.col("weight")
        n, held, rest = sources.agg(
            F.sum(done.cast("long")), F.sum(F.when(done, most).otherwise(0)), F.sum(F.when(done, 0).otherwise(F.col("weight")))
        ).first()
        if n == full or not rest:
            break
        level, full = (total - held) / rest, n
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def _passes() -> Column:
    """Whole passes that a source's target holds."""
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """(sid, block, times): the blocks of each source that are taken once more than in its whole passes."""
    size = F.col("source_size")
    slots = F.when(size > 0, (F.col("target") - _passes() * size) / F.least(F.lit(block), size)).otherwise(0.0)
    units = sources.withColumn("blocks", F.ceil(size / block)).withColumn("units", F.floor(slots * UNIT + 0.5).cast("long"))
    units = units.filter("units > 0").select("sid", "blocks", "units")
    all_units, n_sources = units.agg(F.sum("units"), F.count(F.lit(1))).first()
    all_units = all_units or 1
    n_slots = math.ceil((all_units if n_sources else 0) / UNIT)
    # Cumulative weights: inside ranges of source ranks, then over the ranges.
    chunk = max(1, math.isqrt(n_sources))
    units = units.withColumn("chunk", F.floor(F.col("sid") / chunk))
    sums = units.groupBy("chunk").agg(F.sum("units").alias("u"))
    sums = sums.select("chunk", (F.sum("u").over(Window.orderBy("chunk")) - F.col("u")).alias("offset"))
    upto = F.sum("units").over(Window.partitionBy("chunk").orderBy("sid")) + F.col("offset")
    cuts = units.join(sums, "chunk").select("sid", "blocks", upto.alias("hi"), (upto - F.col("units")).alias("lo"))
    # A point finds its source by the cell of the unit interval that both fall in.
    cell = max(1, all_units // max(1024, 4 * n_sources))
    cuts = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    p, q = GOLDEN
    point = F.expr(
        f"(cast({all_units} as decimal(19,0)) * ((cast(id as decimal(13,0)) * cast({p} as decimal(13,0))) % cast({q} as decimal(13,0))))"
        f" div cast({q} as decimal(13,0))"
    )
    points = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point.cast("long").alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    placed = points.join(cuts, "cell").filter("point >= lo AND point < hi").select("slot", "sid", "blocks")
    # Rank of a slot among its source's slots, again in two levels.
    stretch = max(1, math.isqrt(n_slots))
    placed = placed.withColumn("stretch", F.floor(F.col("slot") / stretch))
    counts = placed.groupBy("sid", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("n")
    placed = placed.join(counts.select("sid", "stretch", before.alias("before")), ["sid", "stretch"])
    rank = F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1 + F.col("before")
    placed = placed.withColumn("rank", rank).filter(F.col("rank") < F.col("blocks"))
    return placed.groupBy("sid", F.col("rank").alias("block")).agg(F.count(F.lit(1)).alias("times"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS, key: Column | None = None
) -> DataFrame:
    """One row per document: source, size, source_size, target, taken (words taken, repeats counted), and key.

    key is given to tell rows by, a digest of the text by default; it settles the order of equal doc_ids.
    """
    text = text_or_empty()
    sized = docs.select(
        "doc_id", "source", F.size(words_of(text)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("ord"),
        (F.md5(text) if key is None else key).alias("key"),
    )
    sized = settle(sized, "mix-sized")
    sources = settle(_targets(_sources(sized, weights), max_passes), "mix-targets")
    n_docs, words = sized.agg(F.count(F.lit(1)), F.sum("size")).first()
    block = max(1, min(block_words, (words or 0) // MIN_SLOTS))
    times = _schedule(sources, block)

    # Place of each document in its source's stream.
    parts = max(1, math.isqrt(n_docs))
    known = sources.withColumnRenamed("source", "_source")
    part = F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight").withColumn("part", part)
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("s"))
    before = F.sum("s").over(Window.partitionBy("sid").orderBy("part")) - F.col("s")
    inner = Window.partitionBy("sid", "part").orderBy("ord", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums.select("sid", "part", before.alias("before")), ["sid", "part"])
    rows = rows.withColumn("start", F.sum("size").over(inner) - F.col("size") + F.col("before"))
    cols = ["doc_id", "source", "size", "source_size", "target", "key"]
    none = rows.filter("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))

    # Blocks a document lies in, joined to how often each is taken.
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = rows.filter("size > 0").select(*cols, "sid", "start", F.explode(F.sequence(first, last)).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    spans = spans.withColumn("inside", inside).join(times, ["sid", "block"], "left")
    taken = F.sum(F.col("inside") * (F.coalesce(F.col("times"), F.lit(0)) + _passes())).cast("long").alias("taken")
    return spans.groupBy("sid", "start", *cols).agg(taken).select(*cols, "taken").unionByName(none)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Words are taken by blocks, so the schedule takes the first and last document of a stretch in part; such a part counts
    as a whole copy from half on, and a document that is taken at all stays at least once.
    """
    marks = [F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in docs.columns]
    key = F.md5(F.concat(*marks))
    times = F.when(F.col("size") > 0, F.greatest(F.round(F.col("taken") / F.col("size")), F.least(F.col("taken"), F.lit(1)))).otherwise(0).cast("int")
    taken = mix_sources(docs, key=key).groupBy(F.col("key").alias("_taken")).agg(F.sum(times).cast("int").alias("_times")).filter("_times > 0")
    # Rows with one key agree in every column.
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")).groupBy("_key").agg(F.first("row").alias("row"))
    rows = rows.join(taken, F.col("_key") == F.col("_taken"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS ord,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(z) OVER () AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(3 * z) OVER (ORDER BY 3 * z / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
              sum(w) OVER (ORDER BY 3 * z / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
lv AS (SELECT (total - held)::DOUBLE / rest AS level FROM s2 WHERE 3 * z / w >= (total - held)::DOUBLE / rest
       ORDER BY 3 * z / w, sid LIMIT 1),
s3 AS (SELECT s2.*, least((3 * z)::DOUBLE, coalesce((SELECT level FROM lv), 1e300) * w) AS target,
              greatest(1, least(256, total::BIGINT // 65536)) AS b FROM s2),
s4 AS (SELECT *, ceil(z / b)::BIGINT AS n,
              CASE WHEN z > 0 THEN floor(target / z)::BIGINT ELSE 0 END AS f,
              CASE WHEN z > 0 THEN floor((target - floor(target / z) * z) / least(b, z) * 1000 + 0.5)::BIGINT ELSE 0 END AS u FROM s3),
s5 AS (SELECT *, sum(u) OVER (ORDER BY sid)::BIGINT AS hi, (sum(u) OVER ())::BIGINT AS v FROM s4),
sl AS (SELECT j, ((v::HUGEINT * ((j::HUGEINT * 2504730781961) % 4052739537881)) // 4052739537881)::BIGINT AS pt
       FROM (SELECT v, unnest(range(0, ceil(v / 1000)::BIGINT)) AS j FROM (SELECT max(v) AS v FROM s5) a) t),
pl AS (SELECT sl.j, s5.sid, s5.n FROM sl JOIN s5 ON sl.pt >= s5.hi - s5.u AND sl.pt < s5.hi),
rk AS (SELECT sid, n, row_number() OVER (PARTITION BY sid ORDER BY j) - 1 AS r FROM pl),
tm AS (SELECT sid, r AS blk, count(*) AS times FROM rk WHERE r < n GROUP BY 1, 2),
o AS (SELECT doc_id, size, sid, z, target, b, f,
             sum(size) OVER (PARTITION BY sid ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
e AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((start // b)::BIGINT, ((start + size - 1) // b + 1)::BIGINT) ELSE [0] END) AS blk FROM o)
SELECT doc_id, size, z AS source_size, target,
       sum(CASE WHEN size = 0 THEN 0 ELSE (least(start + size, (blk + 1) * b) - greatest(start, blk * b)) * (coalesce(times, 0) + f) END)::BIGINT AS taken
FROM e LEFT JOIN tm USING (sid, blk) GROUP BY doc_id, size, z, target, sid, start
"""
