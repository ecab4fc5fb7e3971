from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from barspark.llm import mixing, quality_rules
from barspark.llm.mixing import mix_sources, mixed_documents
from barspark.llm.quality_rules import quality_rules as judge
from tests.llm.texts import frame, odd_rows, rule_counts, words


def test_rules_against_plain_counts(spark):
    rows = odd_rows()
    got = sorted(tuple(r) for r in judge(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted((-1 if i is None else i, *rule_counts(t)) for i, t, _, _ in rows)


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{k}" for k in range(30))
    rows = [(k, "too short", "en", "bad") for k in range(40)] + [(40, good, "en", "bad")] + [(100 + k, f"{good} {k}", "en", f"h{k % 9}") for k in range(90)]
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in judge(frame(spark, rows)).collect()}
    assert kept[40] == (False, False) and all(kept[100 + k][0] for k in range(90))
    small = [(1, "too short", "en", "few"), *rows[41:]]
    verdict = {r["doc_id"]: (r["host_rate"], r["host_rejected"]) for r in judge(frame(spark, small)).collect()}
    assert verdict[1][0] < 0.5 and not verdict[1][1]  # one failure is drawn to the other hosts


def test_a_host_is_judged_by_more_than_the_base_rule(spark):
    noisy = " ".join(f"w{k}####" for k in range(30))
    rows = [(k, f"{noisy} {k}", "en", "signs") for k in range(20)] + [(100 + k, " ".join(f"w{j}{k}" for j in range(20)), "en", f"h{k % 5}") for k in range(50)]
    out = judge(frame(spark, rows))
    assert out.filter("doc_id < 100 and (kept or base_failed)").count() == 0 and out.filter("doc_id >= 100 and not kept").count() == 0


def test_worst_host_among_bad_ones(spark):
    """Where most hosts fail in more than half of their documents, one that always fails is still told apart."""
    good = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(1000 * h + k, "short" if k < 60 else good(k), "en", f"h{h}") for h in range(8) for k in range(100)]
    rows += [(9000 + k, "short" if k < 99 else good(k), "en", "worst") for k in range(100)]
    verdict = {r["host"]: r["host_rejected"] for r in judge(frame(spark, rows)).select("host", "host_rejected").distinct().collect()}
    assert verdict.pop("worst") and not any(verdict.values())


@pytest.mark.parametrize("query", ["op1", "op3"])
def test_sql_twin_on_odd_rows(spark, query):
    rows = [r for r in odd_rows() if r[0] is not None]
    df = frame(spark, rows)
    got = (judge(df) if query == "op1" else mix_sources(df)).toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(quality_rules.OP1_SQL if query == "op1" else mixing.OP3_SQL).df()
    cols = list(want.columns)
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    got = mix_sources(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(words(t)) for _, t, _, _ in rows)
    sums = got.groupby(got["source"].fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(sums["target"].sum() - got["size"].sum()) < 1e-6 and (sums["target"] <= 3 * sums["size"] + 1e-9).all()
    assert ((sums["taken"] - sums["target"]).abs() <= 8).all()
    again = mix_sources(df.repartition(5)).toPandas()
    view = lambda g: sorted(map(tuple, g[["doc_id", "size", "taken"]].fillna(-1).to_numpy().tolist()))
    assert view(got) == view(again)


def test_mixed_documents_repeat_whole_rows(spark):
    df = frame(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    out = mixed_documents(df)
    assert out.columns == df.columns
    n = out.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))).alias("n")).toPandas()
    sums = mix_sources(df).groupBy("source").agg(F.first("target").alias("t"), F.max("size").alias("m")).toPandas()
    both = sums.fillna("-").merge(n.fillna("-"), on="source", how="left").fillna(0)
    assert ((both["n"] - both["t"]).abs() <= both["m"] / 2 + 8).all()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert judge(none).count() == 0 and mix_sources(none).count() == 0 and mixed_documents(none.select("doc_id", "text", "source")).count() == 0
    nothing = mix_sources(frame(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [r["taken"] for r in nothing] == [0, 0]


def test_small_sources_get_their_whole_passes(spark):
    """Sources far smaller than a block, some with a target of three passes, one very large source."""
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(k, text, "en", f"s{k:02d}") for k in range(40)] + [(1000 + k, " ".join(["x"] * 2000), "en", "t") for k in range(60)]
    got = mix_sources(frame(spark, rows)).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.first("source_size").alias("z")).collect()
    for r in got:
        if r["t"] == 3 * r["z"]:
            assert r["n"] == r["t"]
        assert abs(r["n"] - r["t"]) <= max(256, r["z"] if r["z"] < 256 else 0)
    assert sum(r["t"] == 3 * r["z"] for r in got) >= 10


def test_a_source_of_one_document_stays_in_the_mix(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(300)), "en", f"s{k}") for k in range(9)]
    assert {r["source"] for r in mixed_documents(frame(spark, rows)).collect()} == {f"s{k}" for k in range(9)}
