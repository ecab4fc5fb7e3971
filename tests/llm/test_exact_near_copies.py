from __future__ import annotations

import random

from pyspark.sql import functions as F

from barspark.llm import near_copies as nc
from barspark.llm.simhash_dedup import keep_one, near_copy_print
from tests.llm.texts import classes, frame, lower, odd_rows, prose, words


def plain_set(text):
    w = words(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_groups_against_plain_search(spark, monkeypatch):
    """Also where every meeting is searched in full."""
    rng = random.Random(2)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] not in (406,)]
    base = prose(rng, 120).split()
    for k in range(40):  # a large group, in part near each other only over third ones
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((600 + k, " ".join(w), "en", "s"))
    sets = [plain_set(t) for _, t, _, _ in rows]
    root = classes(len(rows), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min(r[0], least.get(k, r[0]))
    want = sorted((r[0], least[k]) for r, k in zip(rows, root, strict=True))
    for small in (32, 1):
        monkeypatch.setattr(nc, "SMALL", small)
        assert sorted((r["doc_id"], r["component_id"]) for r in nc.near_copy_groups(frame(spark, rows)).collect()) == want
    assert nc.near_copy_groups(frame(spark, [])).count() == 0


def test_different_documents_with_close_prints_both_stay(spark):
    """Two texts that share words but not shingles enough: fingerprints agree within the bounds, similarity is below 0.8."""
    rng = random.Random(1)
    rows = []
    for k in range(400):
        w = prose(rng, 400).split()
        v = list(w)
        for _ in range(26):
            v[rng.randrange(len(v))] = rng.choice(w)
        a, b = " ".join(w), " ".join(v)
        d = [(x ^ y).bit_count() for x, y in zip(near_copy_print()(a), near_copy_print()(b), strict=True)]
        if d[0] <= 10 and d[1] + d[2] <= 24 and likeness(plain_set(a), plain_set(b)) < 0.78:
            rows += [(2 * k, a, "en", "s"), (2 * k + 1, b, "en", "s")]
    assert len(rows) >= 10
    df = frame(spark, rows)
    assert keep_one(df, nc.near_copy_groups(df)).count() == len(rows)


def test_added_cut_and_changed_passages_are_joined(spark):
    rng, rows, pairs = random.Random(6), [], {"added": [], "cut": [], "changed": []}
    for k in range(300):
        kind = ("added", "cut", "changed")[k % 3]
        w, other = prose(rng, rng.randint(60, 400)).split(), prose(rng, 100).split()
        x = int(len(w) * rng.uniform(0.1, 0.2) / (2 if kind == "changed" else 1))
        at = rng.randrange(len(w) - x)
        v = w + other[:x] if kind == "added" else w[:at] + (other[:x] if kind == "changed" else []) + w[at + x :]
        a, b = " ".join(w), " ".join(v)
        rows += [(2 * k, a, "en", "s"), (2 * k + 1, b, "en", "s")]
        if likeness(plain_set(a), plain_set(b)) >= 0.8:
            pairs[kind].append(k)
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copy_groups(frame(spark, rows)).collect()}
    for ks in pairs.values():
        assert len(ks) >= 50 and sum(got[2 * k + 1] == 2 * k for k in ks) >= 0.99 * len(ks)
    near = {k for ks in pairs.values() for k in ks}
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(300) if k not in near)


def test_fingerprints_alone_find_near_copies(spark):
    """Without a key of the bands: the pigeonhole search finds copies with changed words, and only similar ones are linked."""
    rng, rows, pairs = random.Random(6), [], []
    for k in range(120):
        w = prose(rng, rng.randint(60, 400)).split()
        v = list(w)
        if k % 3 == 0:
            v += prose(rng, len(w) // 20).split()
        elif k % 3 == 1:
            del v[: len(w) // 20]
        else:
            for _ in range(max(1, len(w) // 100)):
                v[rng.randrange(len(v))] = "edited"
        rows += [(2 * k, " ".join(w), "en", "s"), (2 * k + 1, " ".join(v), "en", "s")]
        pairs += [k] * (likeness(plain_set(rows[-1][1]), plain_set(rows[-2][1])) >= 0.8)
    rows += [(1000 + k, f"few words {k // 2}" + " " * k, "en", "s") for k in range(6)] + [(1010, "", "en", "s"), (1011, None, "en", "s")]
    docs = frame(spark, rows)
    sketches = nc.sketches(docs).cache()
    nodes = sketches.groupBy("node").agg(*(F.first(c).alias(c) for c in ("tie", *nc.SKETCH)))
    name = {r["doc_id"]: bytes(r["node"]) for r in sketches.collect()}
    text = {v: k for k, v in name.items()}
    found = nc.exact_links(docs, nodes.withColumn("keys", F.array().cast("array<long>"))).collect()
    got = {tuple(sorted(text[bytes(r[c])] for c in "ab")) for r in found}
    wanted = {(2 * k, 2 * k + 1) for k in pairs}
    assert got <= wanted and len(got) >= 0.9 * len(wanted) and len(wanted) > 100


def test_one_fingerprint_for_several_sets(spark):
    """Texts of the same words and fingerprints but different shingle sets are candidates of each other."""
    w = [f"w{k}" for k in range(3000)]
    rows = [(0, " ".join(w), "en", "s")]
    for k in range(1, 40):
        v = list(w)
        v[70 * k], v[70 * k + 1] = v[70 * k + 1], v[70 * k]
        rows.append((k, " ".join(v), "en", "s"))
    nodes = nc.sketches(frame(spark, rows)).withColumns({"c0": F.lit(5).cast("long"), "c1": F.lit(6).cast("long")}).cache()
    assert nodes.select("node").distinct().count() == 40 and nodes.select("fp").distinct().count() == 1
    got = nc.close_prints(nodes).collect()
    least = min(bytes(r["node"]) for r in nodes.collect())
    assert len(got) == 39 and all(bytes(r["a"]["node"]) == least < bytes(r["b"]["node"]) for r in got)
