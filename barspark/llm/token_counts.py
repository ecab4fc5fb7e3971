"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A piece sequence is the byte-pair encoding of a text exactly if each neighbouring pair of pieces is its own
encoding, and the encoding of a prefix is found inside the encoding of the text. So the last piece of every
prefix follows from the last pieces of shorter prefixes: it is the piece that ends there and is compatible
with the last piece before it. One pass gives the count at every prefix; the count of the text, counts of
parts and the longest prefix within a budget are then lookups, with nothing encoded again.

No piece of the vocabulary goes on past a word into the next blank, so texts fall into short chunks (blanks
and a word) whose prefixes are counted once per worker and kept; the cache is emptied when it is full.

Defined results: a null text is an empty one and has no tokens; strings of special tokens are plain text;
repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barspark.llm.common import table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Chunks (and words, and pairs of pieces) kept per worker, and characters that are cut into chunks at a time.
CACHE = 500_000
STRETCH = 1 << 20

class PrefixCounter:
    """Token counts at the prefixes of texts for one sentencepiece model of the BPE kind."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        # Ends of pieces (a longer string that is none ends no piece), and neighbours inside pieces (others never merge).
        self.whole = {p[k:]: False for p in self.score for k in range(len(p))}
        self.joins = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.whole |= {p: self.merged(p) == [p] for p in self.score}
        if any(re.search(r"[^ ] ", p) for p in self.score):
            raise ValueError("pieces that go on past a word are not supported")
        self.apart = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.score))
        self.chunks = re.compile(f" *[^ {self.apart}]+| +|[{self.apart}]" if self.apart else r" *[^ ]+| +")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string: the best neighbouring pair is merged, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            found = [s for s in scores if s is not None]
            if not found:
                return parts
            k = scores.index(max(found))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether a piece may follow another."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        got = self.pairs[before, piece] = not before or self.merged(before + piece) == [before, piece]
        return got

    def prefixes(self, chunk: str) -> list[int]:
        """Token counts of all prefixes of a chunk, the empty one first."""
        counts, last, whole, pairs = [0], [""], self.whole, self.pairs
        for end in range(1, len(chunk) + 1):
            for start in range(end - 1, -1, -1):
                piece = chunk[start:end]
                kind = whole.get(piece)
                if kind or (kind is None and start == end - 1):
                    pair = last[start], piece
                    if pairs[pair] if pair in pairs else self.fits(*pair):
                        counts.append(counts[start] + (len(piece.encode("utf-8", "surrogatepass")) if kind is None else 1))
                        last.append(piece)
                        break
                elif kind is None:
                    raise AssertionError(f"no piece ends at {end} of {chunk!r}")
        return counts

    def total(self, chunk: str) -> int:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = start = 0
            for k in range(1, len(chunk)):
                if chunk[k - 1 : k + 1] not in self.joins:
                    got, start = got + self.word(chunk[start:k]), k
            got = self.known[chunk] = got + self.word(chunk[start:])
        return got

    def word(self, part: str) -> int:
        got = self.words.get(part)
        if got is None:
            if len(self.words) > CACHE:
                self.words.clear()
            got = self.words[part] = self.prefixes(part)[-1]
        return got

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, a stretch at a time; the library puts a blank in front."""
        text = " " + text.replace("▁", " ") if text else ""
        start = 0
        while start < len(text):
            end = text.find(" ", start + STRETCH)
            while 0 < end < len(text) and text[end - 1] == " ":
                end -= 1
            end = end if end > start else len(text)
            yield self.chunks.findall(text[start:end])
            start = end

    def count(self, text: str) -> int:
        known = self.known
        return sum(known[c] if c in known else self.total(c) for part in self.parts(text) for c in part)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most so many tokens."""
        done = tokens = best = 0
        for part in self.parts(text):
            for chunk in part:
                if tokens >= budget:
                    return max(0, best - 1)
                best = done + max(k for k, n in enumerate(self.prefixes(chunk)) if tokens + n <= budget)
                done, tokens = done + len(chunk), tokens + self.total(chunk)
        return max(0, best - 1)


@lru_cache(maxsize=4)
def counter(model: str) -> PrefixCounter:
    """The counter of a model file, or of a name among the installed public tokenizers; one per worker."""
    if not os.path.isabs(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit, and fit_chars, the characters that fit the limit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(model)
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            tokens = [c.count(t) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                    "fit_chars": [len(t) if n <= limit else c.longest_prefix(t, limit) for t, n in zip(texts, tokens, strict=True)],
                }
            ).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
