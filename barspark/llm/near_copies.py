"""Near copies of documents: SimHash fingerprints find candidates, the exact similarity of shingle sets decides.

A text stands for the set of its five-word shingles (64-bit hashes); equal sets are one node. A pair is linked
if and only if it meets and its exact Jaccard similarity is MIN_SIMILARITY or more; nothing is linked on a sketch.

* Fingerprints of the distinct words are searched with the generalised pigeonhole of simhash_dedup.py: all that lie
  within NEAR_DISTANCE bits meet, in large meetings along a spanning forest. A 128-bit fingerprint of the shingles must
  agree in all but CHECK bits; at a similarity of 0.8 some 20 differ, so this spares sets and no links.
* A passage that is added or cut can move a fingerprint further than any radius that can be searched, and a forest
  leaves pairs out. For these, MinHash bands add candidates: of BANDS * ROWS hash orders the smallest hashes are
  taken; ROWS of them are a key. Two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, which
  is 0.9998 at 0.8, wherever and however they differ.
* Keys with one node go away. At keys of up to SMALL nodes every pair is a candidate. Candidates of both kinds whose
  sizes allow the similarity are listed once and joined with the sets of both sides. Larger meetings of the bands are
  searched from set to set, which gives a spanning forest of exact links, so no list of pairs grows with the square of
  a group.
* Sets are made again from the texts that met something, so no table of all shingles is written.

Defined results: a null text is an empty one; texts without words are one node; shorter texts are one shingle;
component_id is the smallest doc_id of the component (null if it has none); repeated rows are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import settle, text_or_empty
from barspark.llm.components import components
from barspark.llm.simhash_dedup import CHECK_SHINGLE, NEAR_DISTANCE, bit_statistics, links, majority, search_plan, shingles, tokens

#: Least similarity of a link, as a fraction.
MIN_SIMILARITY = (4, 5)
BANDS, ROWS = 16, 4
#: Bits of 128 that the shingle fingerprints of candidates may differ in.
CHECK = 40
#: What is the same for all texts of a node.
SKETCH = ("n_hashes", "keys", "fp", "c0", "c1")
#: Nodes at a key whose pairs are listed.
SMALL = 32
#: Hashes ordered at a time.
BLOCK = 1 << 14
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(words: list[bytes], size: int = CHECK_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    from xxhash import xxh3_64_intdigest

    found = set(shingles(words, size))
    return np.unique(np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found)))


def fingerprint(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """SimHash of the distinct words (64 bits) and of the shingles (128 bits), as three numbers; zeros without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(3, np.uint64)
    distinct = set(words)
    main = majority(np.fromiter((xxh64_intdigest(w, 42) for w in distinct), np.uint64, len(distinct)), 64)
    more = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return np.concatenate((main, majority(np.stack((hashes, more ^ (more >> np.uint64(32))), axis=1), 128)))


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b hashes, both of them shared, are similar enough."""
    return MIN_SIMILARITY[1] * both >= MIN_SIMILARITY[0] * (a + b - both)


def sizes_allow(a: Column, b: Column) -> Column:
    """Whether sets of such sizes can be similar enough: at best the smaller lies in the larger."""
    return similar(F.least(a, b), a, b)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set: BANDS numbers, none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), BLOCK):
        x = (hashes[None, k : k + BLOCK] ^ SEEDS) * MIX
        x = (x ^ (x >> np.uint64(32))) * MIX
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * MIX
        keys = keys ^ (keys >> np.uint64(32))
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, node, n_hashes, keys, fp, c0, c1): tie is a digest of the text, node one of its set."""

    def sketch(text: str | None) -> tuple:
        from xxhash import xxh3_128_digest

        words = tokens(text)
        hashes = shingle_set(words)
        return xxh3_128_digest(hashes.tobytes()), len(hashes), band_keys(hashes), fingerprint(words, hashes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [sketch(t) for t in rows["text"]]
            out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "tie": rows["tie"]})
            out["node"] = [x[0] for x in found]
            out["n_hashes"] = np.array([x[1] for x in found], np.int32)
            out["keys"] = [x[2].view(np.int64) for x in found]
            out[["fp", "c0", "c1"]] = np.array([x[3] for x in found], np.uint64).reshape(-1, 3).view(np.int64)
            yield out

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    return rows.mapInPandas(run, "doc_id long, tie long, node binary, n_hashes int, keys array<long>, fp long, c0 long, c1 long")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) for nodes (node, tie), from one text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"node": rows["node"], "hashes": [shingle_set(tokens(t)).view(np.int64) for t in rows["text"]]})

    texts = docs.select(F.xxhash64(text_or_empty()).alias("_tie"), "text")
    rows = texts.join(nodes.withColumnRenamed("tie", "tie_"), F.col("_tie") == F.col("tie_")).groupBy("node").agg(F.first("text").alias("text"))
    return rows.mapInPandas(run, "node binary, hashes array<long>")


def reached(nodes: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links of similar sets that span what a search from set to set reaches."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out, rest = [], np.ones(len(sets), bool)
    open_: list[int] = []
    while rest.any():
        if not open_:
            open_ = [int(rest.argmax())]
            rest[open_[0]] = False
        at = open_.pop()
        keep = rest[owner]
        if not keep.all():
            flat, owner = flat[keep], owner[keep]
        both = np.bincount(owner[np.isin(flat, sets[at])], minlength=len(sets))
        new = np.flatnonzero(rest & similar(both, sizes[at], sizes))
        out += [(nodes[at], nodes[k]) for k in new]
        rest[new] = False
        open_ += new.tolist()
    return out


def close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b), structs of node and n_hashes: candidates by fingerprints, a before b.

    Nodes of one fingerprint are paired with its first one; this one stands for them in the search.
    """
    rows = nodes.select("fp", "c0", "c1", F.struct("node", "n_hashes").alias("x"))
    first = settle(rows.groupBy("fp", "c0", "c1").agg(F.min("x").alias("x")), "near-firsts")
    n, together = bit_statistics(first)
    found = links(first.select("fp", "c0", "c1"), search_plan(n, together, NEAR_DISTANCE), NEAR_DISTANCE, CHECK)
    # Links come as the bytes of the three numbers.
    named = first.select(F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("fp", "c0", "c1"))).alias("print"), "x")
    side = lambda c: named.select(F.col("print").alias(c), F.col("x").alias(f"x{c}"))
    pairs = found.join(side("a"), "a").join(side("b"), "b").select("xa", "xb")
    same = rows.alias("r").join(first.alias("f"), ["fp", "c0", "c1"]).select(F.col("f.x").alias("xa"), F.col("r.x").alias("xb")).filter("xa <> xb")
    return pairs.unionByName(same).select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"))


def exact_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all nodes that meet by fingerprints or at a key and are similar."""
    keys = settle(nodes.select("node", "n_hashes", F.explode("keys").alias("key")), "near-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = settle(keys.join(sizes, "key"), "near-met")
    few = met.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n_hashes"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("_at", "a"))
    pairs = few.select("a", F.explode(F.slice("all", F.col("_at") + 2, SMALL)).alias("b")).unionByName(close_prints(nodes))
    pairs = pairs.filter(sizes_allow(F.col("a.n_hashes"), F.col("b.n_hashes"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    pairs = settle(pairs.distinct(), "near-pairs")
    many = met.filter(F.col("n") > SMALL).select("key", "node")
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    some = some.join(nodes.select(F.col("node").alias("_n"), "tie"), F.col("node") == F.col("_n")).select("node", "tie")
    sets = settle(sets_of(docs, some), "near-sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))
    both = F.size(F.array_intersect("ha", "hb"))
    tested = pairs.join(side("a"), "a").join(side("b"), "b")
    linked = tested.filter(similar(both, F.size("ha"), F.size("hb"))).select("a", "b")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        found = reached([bytes(x) for x in rows["node"]], [np.asarray(s, np.int64) for s in rows["hashes"]])
        return pd.DataFrame(found, columns=["a", "b"])

    return linked.unionByName(many.join(sets, "node").groupBy("key").applyInPandas(search, "a binary, b binary"))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, root, component_id), one row per document; root is the same in a group, tie a digest of the text."""
    prints = settle(sketches(docs), "near-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("tie").alias("tie"), *(F.first(c).alias(c) for c in SKETCH))
    nodes = settle(nodes, "near-nodes")
    roots = components(exact_links(docs, nodes)).withColumnRenamed("node", "_node")
    rooted = nodes.select("node", "first_id").join(roots, F.col("node") == F.col("_node"), "left")
    rooted = settle(rooted.select("node", "first_id", F.coalesce("root", "node").alias("root")), "near-rooted")
    least = settle(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "near-components")
    named = rooted.join(least, "root").select(F.col("node").alias("_node"), "root", "component_id")
    return prints.join(named, F.col("node") == F.col("_node")).select("doc_id", "tie", "root", "component_id")
