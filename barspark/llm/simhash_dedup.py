"""Near-duplicate documents by SimHash, searched with a generalised pigeonhole.

A text's fingerprint has a bit for each bit of its shingles' hashes: 1 if more than half of them set it.
Equal fingerprints are one node. Pairs of nodes within a Hamming distance are found as follows:

* Bits that agree with each other are grouped: the bit statistics of all fingerprints (a 64 x 64 table) are
  summed in Spark, and bits are put with those they correlate with.
* The groups get thresholds with sum distance - groups + 1 (a group may get -1: it is not searched); within
  the distance some group must then be within its threshold. A dynamic programme picks the thresholds, and
  the number of groups, with the least estimated probes and candidates, so more nodes mean wider groups.
* A group's threshold is split between both sides: nodes write their group's bits, and those with up to so
  many flipped, as keys; nodes that meet at a key are compared in full.
* What meets at a key is linked by a spanning forest, never listed as pairs; large meetings are cut again
  by the other bits, so no pair is lost.

Links are joined to components by contraction (components.py). The nearness of stages is a second, 128-bit
fingerprint of five-word shingles that a link must agree in as well.

Defined results: a null text is an empty one, fingerprint zero, linked like any other; component_id is the
smallest doc_id of the component (null if it has none); repeated rows are judged each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty
from barspark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = 64
SHINGLE, DISTANCE = 3, 2
#: For the pipeline: fingerprints of the distinct words find candidates within NEAR_DISTANCE bits; five-word shingles
#: decide. At a Jaccard similarity of 0.8 their 128-bit fingerprints differ in 19.5 bits on average, 4.1 bits about that.
NEAR_DISTANCE, CHECK_SHINGLE, CHECK_DISTANCE = 10, 5, 24
#: A key that is written, moved and sorted costs about as much as so many comparisons of rows that meet.
KEY_COST = 64
#: Keys a node may write for one group of bits.
MOST_KEYS = 8192
#: Hashes counted at a time; rows at a key that are compared by offsets, and by direct search before they are cut again.
BLOCK, SMALL, LARGE = 1 << 16, 32, 8192

Print = Callable[[str], tuple[int, int, int]]


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of words joined by a blank; the whole sequence if it is shorter; none without words."""
    joined = b" ".join(words)
    if len(words) <= size:
        if words:
            yield joined
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True):
        yield joined[a:b]


def majority(hashes: list[bytes] | np.ndarray, width: int) -> np.ndarray:
    """Bits (as width / 64 unsigned numbers) that more than half of the hashes set."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, width // 8) if isinstance(hashes, bytes) else hashes.view(np.uint8).reshape(-1, width // 8)
    ones = np.zeros(width, np.int64)
    for k in range(0, len(raw), BLOCK):
        ones += np.unpackbits(raw[k : k + BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw), bitorder="little").view(np.uint64)


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def word_run_print(size: int) -> Print:
    """Fingerprint of all shingles, repeats included; nothing further to agree in."""

    def one(text: str | None) -> tuple[int, int, int]:
        from xxhash import xxh64_intdigest

        found = [xxh64_intdigest(s, 42) for s in shingles(tokens(text), size)]
        return (int(majority(np.array(found, np.uint64), 64)[0]) if found else 0), 0, 0

    return one


def near_copy_print(size: int = CHECK_SHINGLE) -> Print:
    """Fingerprint of the distinct words, and a 128-bit one of the distinct shingles to agree in."""

    def one(text: str | None) -> tuple[int, int, int]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        words = tokens(text)
        if not words:
            return 0, 0, 0
        main = majority(np.array([xxh64_intdigest(w, 42) for w in set(words)], np.uint64), 64)
        check = majority(b"".join(map(xxh3_128_digest, set(shingles(words, size)))), 128)
        return int(main[0]), int(check[0]), int(check[1])

    return one


def fingerprints(docs: DataFrame, make: Print) -> DataFrame:
    """(doc_id, tie, fp, c0, c1, node): tie is a digest of the text, fp the searched fingerprint, node all three as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = np.array([make(t) for t in rows["text"]], np.uint64).reshape(-1, 3)
            out = pd.DataFrame(got.view(np.int64), columns=["fp", "c0", "c1"])
            out.insert(0, "doc_id", rows["doc_id"].astype("Int64"))
            out.insert(1, "tie", rows["tie"])
            out["node"] = [r.tobytes() for r in got.astype(">u8")]
            yield out

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    return rows.mapInPandas(run, "doc_id long, tie long, fp long, c0 long, c1 long, node binary")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and how often each pair of bits is set together (64 x 64), over all nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, table_ = 0, np.zeros((BITS, BITS), np.int64)
        for rows in batches:
            bits = np.unpackbits(rows["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, table_ = n + len(rows), table_ + (bits.T @ bits).astype(np.int64)
        yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(table_.ravel(), n)})

    sums = nodes.select("fp").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in sums:  # 4,097 rows whatever the corpus
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, each with those it correlates with most."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        bits = [max(sorted(left), key=lambda b: like[b, sorted(left)].sum())]
        left.remove(bits[0])
        while len(bits) < size:
            bits.append(max(sorted(left), key=lambda b: like[b, bits].sum()))
            left.remove(bits[-1])
        out.append(sorted(bits))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def thresholds(n: int, together: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The thresholds with sum distance - groups + 1 of least estimated cost, and that cost."""
    p = np.diag(together) / max(n, 1)
    cost = []
    for bits in groups:
        at = np.array([1.0])  # how likely a pair differs in 0, 1, ... of these bits
        for q in 2 * p[bits] * (1 - p[bits]):
            at = np.append(at, 0) * (1 - q) + np.append(0, at) * q
        within = np.cumsum(at)
        allowed = [t for t in range(min(distance, len(bits) - 1) + 1) if ball(len(bits), (t + 1) // 2) <= MOST_KEYS]
        cost.append([0.0] + [KEY_COST * max(n, 1) * ball(len(bits), (t + 1) // 2) + n * n / 2 * within[t] for t in allowed])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                if (k := total + t) not in step or c + extra < step[k][0]:
                    step[k] = (c + extra, [*chosen, t])
        best = step
    return best.get(distance - len(groups) + 1, (math.inf, []))


def search_plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to search."""
    plans = []
    for m in range(1, min(distance + 1, 8) + 1):
        groups = group_bits(n, together, m)
        cost, chosen = thresholds(n, together, groups, distance)
        plans.append((cost, m, groups, chosen))
    _, _, groups, chosen = min(plans, key=lambda x: x[:2])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keys(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, home, fp, c0, c1): home rows flip up to half of the threshold, the others up to the rest."""
    parts = []
    for part, (bits, t) in enumerate(plan):
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in c) for k in range((t + 1) // 2 + 1) for c in combinations(bits, k)]
        at_home = ball(len(bits), t // 2)
        every = F.array(*(F.lit(signed(x)).cast("long") for x in flips))
        rows = nodes.select(F.lit(part).alias("part"), F.posexplode(every).alias("_at", "_flip"), "fp", "c0", "c1")
        key = F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).bitwiseXOR(F.col("_flip"))
        parts.append(rows.select("part", key.alias("key"), (F.col("_at") < at_home).alias("home"), "fp", "c0", "c1"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def forest(rows: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], distance: int) -> list[np.ndarray]:
    """Links that span what a search from row to row reaches (rows: fp, c0, c1)."""
    if len(rows) > LARGE:
        out, width = [], BITS // (distance + 1)
        for k in range(distance + 1):  # within the distance, some stretch of bits agrees
            part = (rows[:, 0] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    out += search(rows[group], near)
        return out
    return search(rows, near)


def search(rows: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    out, rest = [], rows
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            hit = near(at[None, :], rest)
            new = rest[hit]
            if len(new):
                out.append(np.hstack((np.broadcast_to(at, new.shape), new)))
                reached += list(new)
                rest = rest[~hit]
    return out


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], distance: int, check: int) -> DataFrame:
    """(a, b): links that join all nodes within the distances, as node bytes."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(a[:, 0] ^ b[:, 0]) <= distance
        if check:
            hit = hit & (np.bitwise_count(a[:, 1] ^ b[:, 1]).astype(np.int16) + np.bitwise_count(a[:, 2] ^ b[:, 2]) <= check)
        return hit

    def meet(found: np.ndarray, home: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Links among rows sorted by key; begin: where each key's rows begin, and the end of all."""
        sizes = np.diff(begin)
        upto = np.repeat(begin[1:], sizes)
        out = []
        at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        for step in range(1, SMALL):
            at = at[at + step < upto[at]]
            if not len(at):
                break
            pair = at[(home[at] | home[at + step]) & near(found[at], found[at + step])]
            out.append(np.hstack((found[pair], found[pair + step])))
        for k in np.flatnonzero(sizes > SMALL):
            out += forest(np.unique(found[begin[k] : begin[k + 1]], axis=0), near, distance)
        got = np.concatenate(out) if out else np.empty((0, 6), np.uint64)
        got = got[(got[:, :3] != got[:, 3:]).any(axis=1)]
        return np.unique(got, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def linked(rows: pd.DataFrame) -> pd.DataFrame:
            key = rows[["part", "key"]].to_numpy()
            begin = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(rows)]))
            found = rows[["fp", "c0", "c1"]].to_numpy(np.int64).view(np.uint64)
            got = meet(found, rows["home"].to_numpy(bool), begin).astype(">u8")
            raw = lambda side: [r.tobytes() for r in np.ascontiguousarray(side)]
            return pd.DataFrame({"a": raw(got[:, :3]), "b": raw(got[:, 3:])})

        for rows in batches:
            if not len(rows):
                continue
            last = rows["part"].iloc[-1], rows["key"].iloc[-1]
            open_ = ((rows["part"] == last[0]) & (rows["key"] == last[1])).to_numpy()
            if open_.all() and held and (held[-1]["part"].iloc[-1], held[-1]["key"].iloc[-1]) == last:
                held.append(rows)  # one key goes on over this batch
                continue
            done = pd.concat([*held, rows[~open_]], ignore_index=True)
            held = [rows[open_]]
            if len(done):
                yield linked(done)
        if held:
            yield linked(pd.concat(held, ignore_index=True))

    sorted_keys = keys(nodes, plan).repartition("part", "key").sortWithinPartitions("part", "key")
    return sorted_keys.mapInPandas(run, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, make: Print, distance: int, check: int = 0) -> DataFrame:
    """(doc_id, tie, fp, root, component_id), one row per document; root is the same in a group, tie a digest of the text."""
    prints = settle(fingerprints(docs, make), "prints")
    nodes = settle(prints.groupBy("node", "fp", "c0", "c1").agg(F.min("doc_id").alias("first_id")), "nodes")
    n, together = bit_statistics(nodes)
    roots = components(links(nodes, search_plan(n, together, distance), distance, check))
    rooted = nodes.select("node", "first_id").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    rooted = settle(rooted.select("node", "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    # Written, so the join on a large component's root is one that adaptive execution may split.
    least = settle(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = rooted.join(least, "root").select(F.col("node").alias("_node"), "root", "component_id")
    return prints.join(named, F.col("node") == F.col("_node")).select("doc_id", "tie", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The document of smallest doc_id (null first) of each group, in one row; equal ids go by a digest of the text."""
    chosen = groups.groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("c")).select(F.col("c.doc_id").alias("_doc"), F.col("c.tie").alias("_tie"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("tie"))
    rows = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left_semi")
    return rows.groupBy("_id", "tie").agg(F.min("row").alias("row")).select("row.*")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), word_run_print(SHINGLE), DISTANCE)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
