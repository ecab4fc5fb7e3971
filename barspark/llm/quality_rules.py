"""Quality rules of documents, and of the hosts they come from.

Per document, word, symbol, line and repetition rules are judged inside the row. Rule failures are then
counted per host, a host's failure rate is shrunk towards the rate of all hosts by a beta prior fitted to
the hosts themselves, and the verdict on the host is joined back to its documents.

Defined results: a null text is an empty one and fails the base rule; a null host is a host of its own;
repeated rows are judged and counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import GAP, settle, table, text_or_empty, words_of

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
WINDOW = 5
#: A host is rejected if more than this share of its documents is expected to fail, at odds so many times the usual ones.
MAX_HOST_RATE, WORSE = 0.5, 4


def _covered(words: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted with their places, equal neighbours found."""
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )

    def places(s: Column) -> Column:
        def at(k: Column) -> Column:
            w = F.get(s, k)["w"]
            return F.when((w == F.get(s, k - 1)["w"]) | (w == F.get(s, k + 1)["w"]), F.get(s, k)["i"])

        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), at), lambda x: x.isNotNull()))

    found = F.get(F.transform(F.array(windows), places), F.lit(0))
    step = lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end"))
    return F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def document_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rule verdicts per document, from whole texts, with no shuffle.

    The columns in carry come along as a struct, row, where the base rules hold.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    along = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    rows = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"), *along)
    word = F.col("words")
    at = lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(WINDOW)))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.regexp_replace("text", GAP, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), at)),
        }
    )
    # Equal windows have equal hashes, so only rows with a repeated hash compare the windows themselves.
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("n_repeat_words", F.when(some, _covered(word)).otherwise(0).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
    )
    if carry:
        rows = rows.withColumn("row", F.when(~F.col("base_failed"), F.col("row")))
    return rows.withColumn("rule_failed", failed).drop("text", "words", "lines", "hashes")


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, and whether the host is rejected.

    The prior is Beta(mu * m, (1 - mu) * m), fitted to the mean of the hosts' rates and to their variance without
    what chance alone gives hosts of few documents; m is held between 2 and 1,000,000 where the rates vary more
    than a beta can, or not at all. A host is rejected above max_rate and where the odds of
    its rate are more than WORSE times those of the hosts' mean, a bound below 1 whatever the mean.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    mu, var, chance = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("host_docs"))).first()
    mu = mu or 0.0
    var = (var or 0.0) - mu * (1 - mu) * (chance or 0.0)
    m = min(max(mu * (1 - mu) / var - 1, 2.0), 1e6) if var > 0 else 1e6
    shrunk = (F.col("host_failures") + F.lit(mu * m)) / (F.col("host_docs") + F.lit(m))
    bound = WORSE * mu / (1 + (WORSE - 1) * mu)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > max(max_rate, bound))


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base verdict and kept per document row, with what its host is charged with, and carried columns."""
    judged = settle(document_rules(docs, carry), "quality")
    hosts = host_verdicts(judged, max_host_rate)
    out = judged.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures")
    return quality_rules(table(spark, sf_dir, "documents")).select(*cols)


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS w
      FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5) t),
p AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS c FROM w) t WHERE c > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM p, (SELECT unnest(range(0, 5)) AS j) o GROUP BY k),
m AS (
  SELECT d.k, doc_id, host, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM b),
h AS (SELECT host, count(*) AS host_docs, sum(rule_failed::INT)::BIGINT AS host_failures FROM f GROUP BY host),
q0 AS (SELECT avg(host_failures / host_docs) AS mu, var_pop(host_failures / host_docs) AS v, avg(1 / host_docs) AS c FROM h),
q AS (SELECT mu, v - mu * (1 - mu) * c AS v FROM q0),
g AS (SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 2.0), 1e6) ELSE 1e6 END AS m FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((host_failures + mu * m) / (host_docs + m) > greatest(0.5, 4 * mu / (1 + 3 * mu))) AS kept, host_docs, host_failures
FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host, g
"""
