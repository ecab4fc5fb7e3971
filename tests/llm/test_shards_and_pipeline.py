from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import decontamination as dc
from barspark.llm import simhash_dedup as sd
from barspark.llm.common import settle
from barspark.llm.sharding import difference, shard_documents
from tests.llm.texts import classes, crc, frame, odd_rows, prose, rule_counts


def test_differencing_keeps_loads_and_beats_greedy():
    rng = np.random.default_rng(1)
    loads = np.zeros((400, 24), np.int64)
    loads[:, 0] = rng.integers(1, 10_000, 400)
    total, to = difference(loads)
    sums = np.zeros(24, np.int64)
    np.add.at(sums, to[:, 0], loads[:, 0])
    assert (sums == total).all() and all(sorted(r) == list(range(24)) for r in to.tolist())
    greedy = np.zeros(24, np.int64)
    for x in sorted(loads[:, 0], reverse=True):
        greedy[greedy.argmin()] += x
    assert np.ptp(total) < np.ptp(greedy)


@pytest.mark.parametrize("block", [4096, 7])
def test_shards_of_odd_rows(spark, block):
    rows = odd_rows()
    got = shard_documents(frame(spark, rows), shards=5, block=block).toPandas()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, crc(t)) for i, t, _, _ in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    assert (got.groupby("text_md5")["shard"].nunique() == 1).all() and got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert shard_documents(frame(spark, [])).count() == 0


def test_shards_are_nearly_equal(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 40)), "en", "s") for k in range(900)]
    got = shard_documents(frame(spark, rows), shards=6, block=100).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(got) == 6 and got.max() - got.min() <= 0.01 * got.mean()


def bad_hosts(rows):
    """Hosts whose shrunk failure rate is above a half and twice the usual."""
    hosts = {}
    for _, t, _, host in rows:
        n, chars, symbols, dups, _, failed = rule_counts(t)
        lines = sum(bool(x.split()) for x in (t or "").split("\n"))
        hosts.setdefault(host, []).append(failed or 100 * symbols > 10 * chars or 100 * dups > 30 * lines)
    rates = [sum(v) / len(v) for v in hosts.values()]
    mu = float(np.mean(rates))
    spread = float(np.var(rates)) - mu * (1 - mu) * float(np.mean([1 / len(v) for v in hosts.values()]))
    m = min(max(mu * (1 - mu) / spread - 1, 2), 1e6) if spread > 0 else 1e6
    return {h for h, v in hosts.items() if (sum(v) + mu * m) / (len(v) + m) > max(0.5, 2 * mu)}


def test_stages_against_plain_answers(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, prose(rng, 30)) for k in range(4)]
    rows = [r for r in odd_rows() if r[0] not in (406, 407)]
    rows += [(800 + k, f"{prose(rng, 40)} {items[k][1]} {prose(rng, 40)}", "en", "src1") for k in range(4)]
    rows += [(900 + k, prose(rng, 120), "en", f"src{k % 5}") for k in range(20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    (_, quality), (_, near), (_, leaks), (_, mix), (_, shards) = corpus_pipeline.STAGES
    view = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["source"] or "") for r in df.collect())

    kept = settle(quality(spark, docs, str(tmp_path)), "t")
    bad = bad_hosts(rows)
    left = [r for r in rows if not rule_counts(r[1])[-1] and r[3] not in bad]
    assert bad == {None} and view(kept) == sorted((-1 if i is None else i, t, s or "") for i, t, _, s in left)
    assert kept.columns == list(corpus_pipeline.COLUMNS)

    one = settle(near(spark, kept, str(tmp_path)), "t")
    prints = [sd.near_copy_print()(r[1]) for r in left]
    bits = lambda a, b: [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
    root = classes(len(left), lambda a, b: (d := bits(a, b))[0] <= sd.NEAR_DISTANCE and d[1] + d[2] <= sd.CHECK_DISTANCE)
    ids = {}
    for r, k in zip(left, root, strict=True):
        ids.setdefault(k, set()).add(-1 if r[0] is None else r[0])
    assert sorted(i for i, _, _ in view(one)) == sorted(min(s) for s in ids.values())
    assert {100 + k for k in range(7)}.isdisjoint(i for i, _, _ in view(one)) and 300 not in {i for i, _, _ in view(one)}

    clean = settle(leaks(spark, one, str(tmp_path)), "t")
    held = {k for k, t, _ in view(one) if any(dc.best_place([w.decode() for w in dc.words_in(i)], [w.decode() for w in dc.words_in(t)])[0] <= dc.edits(len(dc.words_in(i))) for _, i in items)}
    assert {800, 801, 802, 803} <= held
    assert view(clean) == [r for r in view(one) if r[0] not in held]

    mixed = settle(mix(spark, clean, str(tmp_path)), "t")
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and set(view(mixed)) <= set(view(clean))
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 3

    last = shards(spark, mixed, str(tmp_path)).toPandas()
    assert sorted(last["text_crc32"]) == sorted(crc(t) for _, t, _ in view(mixed))
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, whole[["size", "text_crc32", "slot"]].to_numpy().tolist())) == sorted(map(tuple, last[["size", "text_crc32", "slot"]].to_numpy().tolist()))


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), "t")
        assert docs.count() == 0
