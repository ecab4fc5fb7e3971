"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and everything but letters becomes one blank. Its features are all runs of 1 to SIZES
characters that hold no blank inside (one may stand at either end), hashed to a table of buckets. Every task
counts the n-grams of its labelled texts per language and sends bounded slices of these counts, which are
added up bucket by bucket. The logarithms of the shares (with SMOOTHING added to each count) form one matrix
of at most CELLS numbers, whatever the corpus: with very many languages there are fewer buckets. It goes to
all tasks, and a batch of texts is scored as a sparse matrix of n-grams times this one.

All labelled texts are counted, none is sampled. Texts whose crc32(doc_id as text) modulo 4 is HELD_OUT are
never learned from, and only the text is used to predict.

Defined results: a text that is null or has no letter, or any text where nothing could be learned, gets
``und`` with score 0; the score is the posterior of the predicted language; equal scores go to the language
that sorts first; a null doc_id is not held out and not learned from; a text is read whole, in stretches of
STRETCH characters cut at a separator where there is one; repeated rows are judged each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty

SIZES = 4
#: Of the four remainders of crc32(doc_id as text), the one kept for evaluation.
PARTS, HELD_OUT = 4, 2
UNKNOWN = "und"
SMOOTHING = 0.1
#: Most numbers in the matrix, most buckets (as a power of two), buckets in one slice of counts.
CELLS, BITS, SLICE = 1 << 23, 16, 1 << 12
#: Characters read at a time, and languages scored at a time.
STRETCH, WIDTH = 1 << 18, 16


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str) -> Iterator[str]:
    """A text in stretches, cut at a blank where one is near."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + STRETCH // 2, at + STRETCH)
        cut = at + STRETCH if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def stretches(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts gathered to about STRETCH characters, with the place of their text in the list."""
    owners, held, size = [], [], 0
    for k, text in enumerate(texts):
        for part in pieces(text):
            owners.append(k)
            held.append(part.lower())
            size += len(part)
            if size >= STRETCH:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def n_grams(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each size, the bucket of the n-gram at every place (the one past the last where it would hold a blank
    inside); which texts have a letter, and the place where each of these begins."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])  # the blank before each text
    letter = np.take(letters(), codes)
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # of several separators only the first stays
    place = np.cumsum(kept)[begin] - 1  # of the blank before each text, which may be the one that ends the text above
    codes, letter = (codes * letter)[kept], letter[kept]
    full = np.flatnonzero(np.append(place[1:], len(codes) - 1) > place)
    found, whole, past = [], letter, np.uint32(1 << bits)
    code = np.zeros(len(codes), np.uint32)
    for n in range(1, SIZES + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) + codes[n - 1 :]
        if n == 3:
            whole = letter[1 : m + 1]
        elif n > 3:
            whole = whole[:m] & letter[n - 2 : n - 2 + m]
        mixed = (code + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        mixed >>= np.uint32(32 - bits)
        found.append(mixed if n == 2 else np.where(whole, mixed, past))
    return found, full, place[full]


def counts_of(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, slice, counts): n-grams of the labelled texts, summed over all tasks. Slice -1 holds the number of texts."""
    size = 1 << bits

    def rows(lang: str, n: int, counts: np.ndarray) -> Iterator[dict]:
        yield {"lang": lang, "slice": -1, "counts": np.array([n], np.int64).tobytes()}
        for k in range(0, size, SLICE):
            if counts[k : k + SLICE].any():
                yield {"lang": lang, "slice": k // SLICE, "counts": counts[k : k + SLICE].tobytes()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                n_and_counts = held.setdefault(lang, [0, np.zeros(size, np.int64)])
                n_and_counts[0] += len(texts)
                for _, part in stretches(texts.tolist()):
                    for bucket in n_grams(part, bits)[0]:
                        n_and_counts[1] += np.bincount(bucket, minlength=size + 1)[:size]
        for lang, (n, counts) in held.items():
            yield pd.DataFrame(list(rows(lang, n, counts)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            for lang, k, counts in zip(batch["lang"], batch["slice"].tolist(), batch["counts"], strict=True):
                if at != (lang, k):
                    if at is not None:
                        yield pd.DataFrame([{"lang": at[0], "slice": at[1], "counts": total.tobytes()}])
                    at, total = (lang, k), 0
                total = total + np.frombuffer(counts, np.int64)
        if at is not None:
            yield pd.DataFrame([{"lang": at[0], "slice": at[1], "counts": total.tobytes()}])

    schema = "lang string, slice int, counts binary"
    parts = docs.mapInPandas(count, schema).repartition("lang", "slice").sortWithinPartitions("lang", "slice")
    return settle(parts.mapInPandas(add, schema), "language-counts")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    bits: int
    prior: np.ndarray
    logs: np.ndarray  # buckets and one of zeros, by languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for owners, part in stretches(texts):
            grams, full, place = n_grams(part, self.bits)
            at = np.asarray(owners)[full]
            seen[at] = True
            for a in range(0, len(self.langs) if len(full) else 0, WIDTH):
                logs = self.logs[:, a : a + WIDTH]
                each = np.take(logs, grams[0], axis=0)
                for bucket in grams[1:]:
                    each[: len(bucket)] += np.take(logs, bucket, axis=0)
                np.add.at(total[:, a : a + WIDTH], at, np.add.reduceat(each, place, axis=0))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total += self.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if s else UNKNOWN for k, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, score, 0.0)


def learnable(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD_OUT
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def train(docs: DataFrame, bits: int = BITS) -> Model:
    """The model of all labelled texts that are not held out."""
    docs = learnable(docs)
    n = docs.select("lang").distinct().count()
    while bits > 8 and n << bits > CELLS:
        bits -= 1
    rows = counts_of(docs, bits).collect()  # at most CELLS counts
    langs = sorted({r["lang"] for r in rows})
    counts, texts = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    for r in rows:
        k, part = langs.index(r["lang"]), np.frombuffer(r["counts"], np.int64)
        if r["slice"] < 0:
            texts[k] = part[0]
        else:
            counts[k, r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    counts += SMOOTHING
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return Model(langs, bits, np.log(texts / max(texts.sum(), 1)), np.vstack((logs.T, np.zeros((1, len(langs))))))


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = shared.value.predict(batch["text"].tolist())
            ids = batch["id"].astype("Int64").mask(batch["no_id"])
            yield pd.DataFrame({"doc_id": ids, "held_out": batch["held_out"], "lang_pred": langs, "score": scores})

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD_OUT, F.lit(False))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, train(docs))
