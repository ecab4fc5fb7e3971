from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from xxhash import xxh64_intdigest

from barspark.llm import simhash_dedup as sd
from barspark.llm.components import components
from tests.llm.texts import classes, frame, lower, odd_rows, words


def plain_print(text):
    w = words(lower(text or ""))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_prints_and_components_against_plain_search(spark):
    rows = [r for r in odd_rows() if r[0] not in (406,)]
    got = sd.near_groups(frame(spark, rows), sd.word_run_print(3), 2).toPandas()
    prints = [plain_print(t) for _, t, _, _ in rows]
    root = classes(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for k, (i, _, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((-1 if r[0] is None else r[0], p, least.get(root[k], -1)) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
    have = sorted((-1 if pd.isna(i) else int(i), int(f) % (1 << 64), -1 if pd.isna(c) else int(c)) for i, f, c in zip(got["doc_id"], got["fp"], got["component_id"], strict=True))
    assert have == want


@pytest.mark.parametrize("distance", [1, 2, 4, 7])
@pytest.mark.parametrize("small", [32, 2])
def test_links_reach_every_near_pair(spark, monkeypatch, distance, small):
    """Random prints with clusters: the components are those of all pairs, also where meetings are searched in full or cut."""
    monkeypatch.setattr(sd, "SMALL", small)
    monkeypatch.setattr(sd, "LARGE", 20)
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(30)}
    prints = sorted(prints | {int(x) for x in rng.integers(0, 1 << 63, 100, dtype=np.uint64)})
    rows = [(p.to_bytes(8, "big") + bytes(16), p - (1 << 64) if p >> 63 else p, 0, 0) for p in prints]
    nodes = spark.createDataFrame(rows, "node binary, fp long, c0 long, c1 long")
    n, together = sd.bit_statistics(nodes)
    assert n == len(prints)
    plan = sd.search_plan(n, together, distance)
    assert sum(t for _, t in plan) >= distance - len(plan) + 1 - (sd.BITS - sum(len(b) for b, _ in plan))
    found = {(bytes(r["a"]), bytes(r["b"])) for r in sd.links(nodes, plan, distance, 0).collect()}
    code = {r[0]: k for k, r in enumerate(rows)}
    pairs = {frozenset((code[a], code[b])) for a, b in found}
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in map(tuple, pairs))
    assert classes(len(prints), lambda a, b: frozenset((a, b)) in pairs) == classes(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)


def test_thresholds_sum_and_grow_with_nodes():
    together = np.full((64, 64), 0.25)
    np.fill_diagonal(together, 0.5)
    for n in (10**3, 10**6, 10**12):
        plan = sd.search_plan(n, together * n, 2)
        total = sum(t for _, t in plan)
        assert total >= 0 and all(t >= 0 for _, t in plan)
    assert len(sd.search_plan(10**3, together * 10**3, 2)) > len(sd.search_plan(10**13, together * 10**13, 2))


def test_components_of_chains_and_stars(spark):
    links = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)] + [("hub", f"s{k}") for k in range(50)] + [("x", "x")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len({v for k, v in got.items() if k.startswith("c")}) == 1 and len({v for k, v in got.items() if k[0] in "hs"}) == 1 and "x" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_near_copies_of_similarity_above_the_bound_are_joined(spark):
    import random

    from tests.llm.texts import prose

    rng, rows, pairs = random.Random(9), [], []
    for k in range(150):
        w = prose(rng, rng.randint(60, 400)).split()
        rows.append((2 * k, " ".join(w), "en", "s"))
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((2 * k + 1, " ".join(w), "en", "s"))
        runs = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (rows[-1][1].split(), rows[-2][1].split())]
        if len(runs[0] & runs[1]) >= 0.8 * len(runs[0] | runs[1]):
            pairs.append(k)
    groups = sd.near_groups(frame(spark, rows), sd.near_copy_print(), sd.NEAR_DISTANCE, sd.CHECK_DISTANCE)
    got = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    joined = sum(got[2 * k] == got[2 * k + 1] for k in pairs)
    assert len(pairs) > 100 and joined >= 0.95 * len(pairs)
    assert all(got[2 * k] == 2 * k for k in range(150))
    kept = [r["doc_id"] for r in sd.keep_one(frame(spark, rows), groups).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_one_row_of_a_group_stays(spark):
    text = "a copy of one text that is long enough to have some words"
    rows = [(5, text, "en", "b"), (3, text, "en", "b"), (3, text, "en", "a"), (3, text, "en", "a"), (None, "", "en", "a"), (9, None, None, None)]
    df = frame(spark, rows)
    kept = sd.keep_one(df, sd.near_groups(df, sd.near_copy_print(), 6, 24)).select("doc_id", "source").collect()
    assert sorted((r["doc_id"] or -1, r["source"]) for r in kept) == [(-1, "a"), (3, "a")]
    none = frame(spark, [])
    assert sd.keep_one(none, sd.near_groups(none, sd.word_run_print(3), 2)).count() == 0
