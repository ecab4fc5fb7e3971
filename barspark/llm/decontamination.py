"""Find benchmark items in documents, word for word or with edits, by CGK embedding and bit sampling.

The CGK embedding walks over a word sequence and writes down the word it stands on; a random bit of word and
step says whether it goes on. Sequences at a small edit distance give walks that mostly agree, so edit
distance becomes Hamming distance. A repeat samples SAMPLES steps of a walk as its key; repeats with keys of
their own reach the target recall. Walks drift apart with the number of edits, so items of 2 * PIECE words and
more are cut into pieces, one of which must be within its share of the edits. Windows of the size of a piece
start at every word; pieces are put in length classes, and a class uses walks of its own length and number.

A window can only hold a piece within the allowed edits if enough word triples of the pieces are left in it,
so windows are first counted against a bit table of all their triples. Keys are then looked up in a bit table
of the items' keys, joined to the items, and every item met is verified by exact edit distance over the words
around. Both tables have a fixed size, whatever the benchmark's; a fuller table costs time, not matches.

Words are letters and digits, lower-cased; a letter of a script without blanks is a word. Items of under
MIN_WORDS words are found word for word only, by the hash of their words. Defined results: null texts hold
nothing, items without a word are nowhere; repeated rows and items give one row per doc_id, text and item;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Letters of scripts without blanks: Thai, Lao, Tibetan, Myanmar, Khmer, Kana, Bopomofo, Han.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
#: Edits allowed per word of an item, and words an item must have for any.
MAX_EDITS, MIN_WORDS = 0.2, 8
#: Words a piece has at least where an item is cut.
PIECE = 12
#: Steps sampled from each walk, and length classes per doubling.
SAMPLES, CLASSES = 3, 4
#: Walks per window, by the edits allowed in a class's longest piece. Simulated recall of one piece with all its edits
#: deletions, the worst kind: 0.9999 for 2 edits, 0.999 for 3 (of 15 words) and 0.9992 for 4 (of 20).
REPEATS = {0: 64, 4: 96}
#: Bits of the two tables (1 MB each).
TABLE_BITS = 1 << 23
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Which bytes stand in words, and factors by the place in a word (again from the first after so many).
IN_WORD = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Windows walked over at a time, so that their walks stay in a core's cache.
WALKED = 1 << 9


def lowered(text: str | None) -> bytes:
    """The text in lower case, letters of scripts without blanks set apart."""
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass")


def words_in(text: str | None) -> list[bytes]:
    return WORD.findall(lowered(text))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a prepared text, never 0: sums of bytes times the factors of their places in the word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    sizes = edges[1::2] - edges[::2]
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    sums = np.add.reduceat(FACTORS[place % len(FACTORS)] * raw[inside[1:-1]], first)
    return mixed(mixed(sums + sizes.astype(np.uint64))) | np.uint64(1)  # 0 stands for no word


def triples(h: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed(h[:-2]) ^ h[1:-1]) ^ h[2:]) if len(h) > 2 else np.empty(0, np.uint64)


def edits(words: int) -> int:
    return int(MAX_EDITS * words)


def allowed(words: int) -> int:
    """Edits an item may have; short ones none."""
    return edits(words) if words >= MIN_WORDS else 0


def pieces(words: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts that an item is searched by."""
    n = max(1, words // PIECE)
    return [(k * words // n, (k + 1) * words // n) for k in range(n)]


def class_of(words: int) -> int:
    return int(CLASSES * np.log2(words) + 1e-9)


@lru_cache(maxsize=256)
def class_shape(c: int) -> tuple[int, int, int]:
    """Least and most words of a class's items, and the triples a window must have left."""
    sizes = [n for n in range(int(2 ** (c / CLASSES)), int(2 ** ((c + 1) / CLASSES)) + 2) if class_of(n) == c]
    return sizes[0], sizes[-1], max(1, min(n - 2 - 3 * edits(n) for n in sizes))


@lru_cache(maxsize=256)
def walks(c: int) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers (repeats x steps) and sampled steps (repeats x samples) of a class."""
    least, most, _ = class_shape(c)
    steps, repeats = max(SAMPLES, 3 * least // 2), max((e, n) for e, n in REPEATS.items() if e <= edits(most))[1]
    rng = np.random.default_rng(1000 + c)
    seeds = rng.integers(0, 1 << 63, (repeats, steps), dtype=np.uint64)
    return seeds, np.sort(np.argsort(rng.random((repeats, steps)), axis=1)[:, :SAMPLES], axis=1)


def walk_keys(h: np.ndarray, starts: np.ndarray, c: int) -> np.ndarray:
    """Keys (starts x repeats) of the windows of one class; h ends with enough zeros to walk over."""
    seeds, sampled = walks(c)
    at = np.repeat(starts[None, :], len(seeds), axis=0)
    keys = np.repeat((np.arange(len(seeds), dtype=np.uint64) + np.uint64(1 + (c << 16)))[:, None], len(starts), axis=1)
    for step in range(seeds.shape[1]):
        word = h[at]
        take = (sampled == step).any(axis=1)
        keys[take] = mixed(keys[take] ^ word[take])
        word ^= seeds[:, step : step + 1]
        word *= MIX
        at += word.view(np.int64) < 0  # the highest bit says whether the walk goes on
    return mixed(keys).T


def run_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n words."""
    keys = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        keys = mixed(keys ^ h[k : k + len(keys)])
    return keys


def bit_table(items: DataFrame, col: str) -> np.ndarray:
    """Which bits the hashes in an array column set: at most TABLE_BITS / 64 rows come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit(TABLE_BITS - 1))
    parts = items.select(F.explode(col).alias("h")).groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    out = np.zeros(TABLE_BITS // 64, np.int64)
    for r in parts.collect():
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


def in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(TABLE_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def prepared(items: DataFrame) -> DataFrame:
    """Searchable items: item_id, n_words, words, their pieces (class, or minus the words of a short item, and the words
    a match may have before and after where a piece begins), hashes of the pieces' word triples, and keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for item, text in zip(rows["item_id"], rows["text"], strict=True):
                data = lowered(text)
                words, h = WORD.findall(data), word_hashes(data)
                n = len(words)
                if not words:
                    continue
                if n < MIN_WORDS:
                    parts, threes, keys = [(-n, 0, n)], [], [run_keys(h, n)]
                else:
                    parts, threes, keys = [], [], []
                    for lo, hi in pieces(n):
                        c = class_of(hi - lo)
                        padded = np.concatenate((h[lo:hi], np.zeros(len(walks(c)[0][0]) + 1, np.uint64)))
                        parts.append((c, lo + edits(n), n - lo + edits(n)))
                        threes.append(triples(h[lo:hi]))
                        keys.append(walk_keys(padded, np.zeros(1, np.int64), c)[0])
                parts = [dict(zip(("class", "before", "after"), x, strict=True)) for x in parts]
                threes = np.concatenate(threes) if threes else np.empty(0, np.uint64)
                out.append((item, n, b" ".join(words).decode("utf-8", "surrogatepass"), parts, threes.view(np.int64), np.concatenate(keys).view(np.int64)))
            frame = pd.DataFrame(out, columns=["item_id", "n_words", "words", "pieces", "triples", "keys"])
            frame["item_id"] = frame["item_id"].astype("Int64")
            yield frame

    schema = "item_id long, n_words int, words string, pieces array<struct<class:int,before:int,after:int>>, triples array<long>, keys array<long>"
    return items.select("item_id", "text").distinct().mapInPandas(run, schema)


def suspects(docs: DataFrame, reach: dict[int, tuple[int, int]], triple_bits: np.ndarray, key_bits: np.ndarray) -> DataFrame:
    """(doc_id, tie, at, words, keys): stretches of documents with windows whose keys some item may have.

    reach: by class of pieces (or minus the words of short items) the most words before and after a window's begin.
    """
    short = sorted(-c for c in reach if c < 0)
    shapes = {c: class_shape(c) for c in sorted(reach) if c >= 0}
    spans = {c: most + edits(most) for c, (_, most, _) in shapes.items()}
    pad = max([len(walks(c)[0][0]) for c in shapes], default=0) + max(spans.values(), default=0) + 1
    least = min([need for _, _, need in shapes.values()], default=0)

    def stretches(rows: list[tuple], texts: list[bytes], h: list[np.ndarray], hit: list[np.ndarray]) -> Iterator[tuple]:
        begin = np.cumsum([0] + [len(x) + pad for x in h])
        flat = np.concatenate([np.concatenate((x, np.zeros(pad, np.uint64))) for x in h])
        seen = np.zeros(len(flat) + 1, np.int64)
        for b, x in zip(begin, hit, strict=False):
            seen[b + 1 : b + 1 + len(x)] = x
        seen = np.cumsum(seen)
        found = []
        for n in short:
            keys = run_keys(flat, n)
            at = np.flatnonzero(in_table(key_bits, keys))
            found.append(np.stack((at, at, at + n, keys[at].view(np.int64))))
        for c, (_, _, need) in shapes.items():
            upto = np.minimum(np.arange(len(flat)) + spans[c] - 2, len(flat))
            starts = np.flatnonzero(seen[np.maximum(upto, np.arange(len(flat)))] - seen[:-1] >= need)
            for k in range(0, len(starts), WALKED):
                part = starts[k : k + WALKED]
                keys = walk_keys(flat, part, c)
                at, rep = np.nonzero(in_table(key_bits, keys))
                found.append(np.stack((part[at], part[at] - reach[c][0], part[at] + reach[c][1], keys[at, rep].view(np.int64))))
        at = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
        if not at.shape[1]:
            return
        doc = np.searchsorted(begin, at[0], side="right") - 1
        at[1], at[2] = np.maximum(at[1], begin[doc]), np.minimum(at[2], begin[doc + 1])
        order = np.lexsort((at[1], doc))
        at, doc = at[:, order], doc[order]
        upto = np.maximum.accumulate(at[2])  # documents follow each other
        cut = np.concatenate(([0], np.flatnonzero((at[1][1:] > upto[:-1]) | (doc[1:] != doc[:-1])) + 1, [at.shape[1]]))
        last, words = -1, []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            d = int(doc[a])
            if d != last:
                last, words = d, WORD.findall(texts[d])
            lo, hi = int(at[1][a] - begin[d]), int(upto[b - 1] - begin[d])
            yield (*rows[d], lo, b" ".join(words[lo:hi]).decode("utf-8", "surrogatepass"), np.unique(at[3][a:b]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def framed(kept: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(list(stretches(*map(list, zip(*kept, strict=True)))) if kept else [], columns=["doc_id", "tie", "at", "words", "keys"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in batches:
            kept, size = [], 0
            for i, tie, text in zip(batch["doc_id"], batch["tie"].tolist(), batch["text"], strict=True):
                data = lowered(text)
                h = word_hashes(data)
                hit = in_table(triple_bits, triples(h))
                if len(h) and (short or (shapes and hit.sum() >= least)):
                    kept.append(((None if pd.isna(i) else int(i), tie), data, h, hit))
                    size += len(h)
                if size > 1 << 20:
                    yield framed(kept)
                    kept, size = [], 0
            yield framed(kept)

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    return rows.mapInPandas(run, "doc_id long, tie long, at long, words string, keys array<long>")


def best_place(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least edits between an item and a part of a text, and where that part ends (bit-parallel, one step per word)."""
    masks: dict[str, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for k, w in enumerate(text, start=1):
        eq = masks.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(across | up)), up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~((eq | down) | rise)), rise & (eq | down)
        if score < best:
            best, end = score, k
    return best, end


def may_hold(item: list[str], text: list[str]) -> bool:
    """Whether enough words of an item stand somewhere in a text; each that does not costs an edit."""
    there = set(text)
    return sum(w not in there for w in item) <= allowed(len(item))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tie, item_id, edits, n_words, first_word): the best match of each item in each document that holds it.

    tie is a digest of the text; first_word is about where the match begins, in words of the document.
    """
    items = settle(prepared(benchmark), "items")
    parts = items.select(F.explode("pieces").alias("p")).groupBy("p.class").agg(F.max("p.before").alias("before"), F.max("p.after").alias("after"))
    reach = {r["class"]: (r["before"], r["after"]) for r in parts.collect()}  # a few classes of pieces and of short items
    found = settle(suspects(docs, reach, bit_table(items, "triples"), bit_table(items, "keys")), "suspects")
    keys = items.select("item_id", F.explode("keys").alias("key"))
    met = found.select("doc_id", "tie", "at", F.explode("keys").alias("key")).join(keys, "key").select("doc_id", "tie", "at", "item_id").distinct()
    where = found.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("at").alias("_at"), F.col("words").alias("text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")) & (F.col("at") == F.col("_at"))
    item_words = items.select(F.col("item_id").alias("_item"), "n_words", "words").distinct()
    pairs = met.join(where, same).join(item_words, F.col("item_id").eqNullSafe(F.col("_item")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            both = [(i.split(" "), t.split(" ")) for i, t in zip(rows["words"], rows["text"], strict=True)]
            may = np.array([may_hold(i, t) for i, t in both], bool)
            got = [best_place(*x) for x, m in zip(both, may, strict=True) if m]
            rows = rows[may]
            out = rows[["doc_id", "tie", "item_id", "n_words"]].copy()
            out["edits"] = [g[0] for g in got]
            out["first_word"] = [a + max(0, g[1] - n) for g, a, n in zip(got, rows["at"], rows["n_words"], strict=True)]
            out = out.astype({"doc_id": "Int64", "item_id": "Int64"})
            yield out[out["edits"] <= [allowed(n) for n in out["n_words"]]]

    cols = pairs.select("doc_id", "tie", "at", "item_id", "n_words", "words", "text")
    held = cols.mapInPandas(verify, "doc_id long, tie long, item_id long, n_words long, edits long, first_word long")
    best = held.groupBy("doc_id", "tie", "item_id").agg(F.min(F.struct("edits", "first_word", "n_words")).alias("b"))
    return best.select("doc_id", "tie", "item_id", "b.edits", "b.n_words", "b.first_word")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item found in it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")
