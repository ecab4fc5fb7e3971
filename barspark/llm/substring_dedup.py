"""Remove passages that stand earlier in the corpus, found by super-k-mers.

A window is WINDOW consecutive words; its minimiser is the smallest hash of MER consecutive words in it.
Consecutive windows with one minimiser are a super-k-mer: their words travel as one string to the bucket of
the minimiser, so equal windows meet in one bucket and a word is moved about three times, not twenty. What a
task sends to a bucket is one compressed block. In the bucket, windows are sorted by hash, and runs of equal
hashes are told apart by their words; all but the first place of a window are reported.

A first pass over the whole corpus counts bucket sizes and which minimisers came more than once. Where a
minimiser came once nothing equal can stand, so its super-k-mer is not sent. This is read off a bit table of a
fixed size (1 << SLOT_BITS): two minimisers may share a bit, which only sends more, and so it spares less the
larger the corpus is. In the same way a bit table of DOC_SLOTS bits tells most documents that keep all their words,
so that the last join shuffles the others only. A bucket that holds far more than the rest has a minimiser that very
many documents share; its windows go one by one, by 128-bit hashes, to an ordinary aggregate and join, which
partial sums and adaptive execution keep even. So no bucket outgrows a task.

Defined results: a null text is an empty one; order is by doc_id (null first), then by a digest of the text,
then by place; rows equal in doc_id and text are one document and get the same answer; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import WORD, settle, table, text_or_empty

WINDOW, MER = 20, 5
#: Characters of packed words a bucket should hold; one with HOT times the mean windows is spread by window.
BUCKET_CHARS, HOT = 1_000_000, 4
#: Characters a word is moved, on average, per character of text.
SPREAD = 3
#: Packed characters a task holds before it sends them; word hashes (and counts) kept.
HELD, CACHE = 24_000_000, 500_000
#: Super-k-mers counted at a time.
HELD_MINIMISERS = 4_000_000
NO_ID = -(1 << 63)
#: Bits of the table of minimisers, of one slice of it, and of the tables of documents that lose words and of hot buckets.
SLOT_BITS, SLICE_BITS, DOC_SLOTS, HOT_SLOTS = 27, 20, 1 << 22, 1 << 20
#: Bytes hashed at a time.
STRETCH = 1 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
WEIGHTS = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """64-bit hashes of words, kept until there are too many."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text joined by one blank, where each begins and ends, and a hash of each for the minimisers."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first separator after a word stays, as a blank
    joined = np.where(gap, np.uint8(32), raw)[keep]
    if len(joined) and joined[-1] == 32:
        joined = joined[:-1]
    ends = np.append(np.flatnonzero(joined == 32), len(joined))[: len(joined)]
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    hashes, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH)))
        begin = starts[a:b] - starts[a]
        part = joined[starts[a] : ends[b - 1]]
        inside = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
        terms = np.where(part == 32, np.uint64(0), (part.astype(np.uint64) + np.uint64(1)) * WEIGHTS[inside % len(WEIGHTS)])
        hashes[a:b] = np.add.reduceat(terms, begin)
        a = b
    return joined.tobytes(), starts, ends, (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MULTIPLIERS[1])


def minimisers(hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first MER words, and minimiser, of each window."""
    mers = np.zeros(len(hashes) - mer + 1, np.uint64)
    for k in range(mer):
        mers = (mers ^ hashes[k : len(hashes) - mer + 1 + k]) * np.uint64(MULTIPLIERS[0])
        mers ^= mers >> np.uint64(29)
    # Minima of 2, 4, 8, ... neighbours, then of two stretches that cover the window.
    width, span, least = window - mer + 1, 1, mers
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return mers[: len(least)], least


def super_kmers(hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a document with a window.

    It also ends where a window begins with its minimiser, so no window is twice in it.
    """
    head, least = minimisers(hashes, window, mer)
    first = np.concatenate(([0], np.flatnonzero((least[1:] != least[:-1]) | (head[:-1] == least[:-1])) + 1))
    return first, np.diff(np.append(first, len(least))), least[first]


def rolling(hashes: np.ndarray, window: int, multiplier: int) -> np.ndarray:
    """Polynomial hashes of all windows, modulo 2 ** 64."""
    n = len(hashes)
    up, down = np.full(n, multiplier, np.uint64), np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    terms = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * np.multiply.accumulate(up))))
    got = (terms[window:] - terms[:-window]) * np.multiply.accumulate(down)[: n - window + 1]
    return got ^ (got >> np.uint64(31))


def pack(head: np.ndarray, texts: list[bytes]) -> bytes:
    """One block of super-k-mers: rows of minimiser, doc_id, text digest and first window, then their words by lines."""
    import zstandard

    raw = np.array([len(texts)], np.int64).tobytes() + head.tobytes() + b"\n".join(texts)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(block: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n), raw[8 + 32 * n :].split(b"\n")


def later_windows(head: np.ndarray, texts: list[bytes], window: int) -> np.ndarray:
    """Rows of doc_id, digest, first window and number: runs of windows in a bucket that also start earlier."""
    _, code, often = np.unique(head[0], return_inverse=True, return_counts=True)
    met = np.flatnonzero(often[code] > 1)  # a minimiser that came once has met nothing
    # In order of places, so that sorting windows by hash alone leaves equal ones in it.
    met = met[np.lexsort((head[3][met], head[2][met], head[1][met]))]
    found = [texts[k] for k in met.tolist()]
    sizes = np.array([t.count(b" ") + 1 for t in found], np.int64)
    # Words are numbered, so windows are equal exactly if their numbers are.
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    flat = np.fromiter((numbers[x] for t in found for x in t.split(b" ")), np.int64, int(sizes.sum()))
    if not len(flat):
        return np.empty((0, 4), np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside <= np.repeat(sizes - window, sizes))  # where a window starts
    spread = (flat.view(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[2])
    code = rolling(spread ^ (spread >> np.uint64(32)), window, MULTIPLIERS[1])[at]
    order = np.argsort(code, kind="stable")
    twice = code[order][1:] == code[order][:-1]
    order = order[np.append(twice, False) | np.append(False, twice)]  # windows whose hash came once have met nothing
    if not len(order):
        return np.empty((0, 4), np.int64)
    code, at = code[order], at[order]
    owner = np.repeat(met, sizes)[at]
    where = np.stack((head[1][owner], head[2][owner], head[3][owner] + inside[at]), axis=1)
    again = np.flatnonzero(code[1:] == code[:-1]) + 1  # same hash as the one before
    same = np.ones(len(again), bool)
    for k in range(window):
        same &= flat[at[again] + k] == flat[at[again - 1] + k]
    run = np.cumsum(np.append(True, code[1:] != code[:-1])) - 1
    lead = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[run]
    odd = np.unique(run[again[~same]])  # different windows of one hash: told apart one by one
    late = again[(where[again] != where[lead[again]]).any(axis=1) & ~np.isin(run[again], odd)].tolist()
    for k in odd.tolist():
        first: dict[bytes, bytes] = {}
        for j in range(*np.searchsorted(run, [k, k + 1]).tolist()):
            if first.setdefault(flat[at[j] : at[j] + window].tobytes(), where[j].tobytes()) != where[j].tobytes():
                late.append(j)
    late = np.unique(where[late], axis=0) if late else np.empty((0, 3), np.int64)
    new = np.append(True, (late[1:, :2] != late[:-1, :2]).any(axis=1) | (late[1:, 2] != late[:-1, 2] + 1))[: len(late)]
    begin = np.flatnonzero(new)
    return np.hstack((late[begin], np.diff(np.append(begin, len(late)))[:, None]))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id (a fixed number for null), digest and text."""
    text = text_or_empty()
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def slot_of(mini: np.ndarray) -> np.ndarray:
    return ((mini * np.uint64(MULTIPLIERS[2])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bit_rows(slots: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, compressed bits): minimisers that came once in some slots, then those that came more often."""
    import zstandard

    slots, often = np.unique(slots, return_counts=True)
    cuts = np.flatnonzero(np.diff(slots >> SLICE_BITS)) + 1
    for own, n in zip(np.split(slots, cuts), np.split(often, cuts), strict=True):
        if len(own):
            bits = np.zeros((2, 1 << SLICE_BITS), np.uint8)
            bits[(n > 1).astype(np.int64), own & ((1 << SLICE_BITS) - 1)] = 1
            yield int(own[0] >> SLICE_BITS), zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, axis=1).tobytes())


def met_again(bits: DataFrame) -> np.ndarray:
    """The table of minimisers that came more than once, as packed bits."""
    import zstandard

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            for part, raw in zip(batch["part"].tolist(), batch["bits"], strict=True):
                new = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, -1)
                if part != at:
                    if at is not None:
                        yield pd.DataFrame({"part": [at], "bits": [total[1].tobytes()]})
                    at, total = part, new.copy()
                else:
                    total[1] |= new[1] | (total[0] & new[0])
                    total[0] |= new[0]
        if at is not None:
            yield pd.DataFrame({"part": [at], "bits": [total[1].tobytes()]})

    table = np.zeros((1 << (SLOT_BITS - SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
    for r in bits.repartition("part").sortWithinPartitions("part").mapInPandas(add, "part long, bits binary").toLocalIterator():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) == 1


def repeated_windows(rows: DataFrame, window: int, mer: int, bucket_chars: int, hot_factor: int) -> DataFrame:
    """(id, tie, first, number): runs of windows that also start earlier."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, SPREAD * chars // bucket_chars)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def summed() -> pd.DataFrame:
            mini, number = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            at, code = np.unique(mini % np.uint64(buckets), return_inverse=True)
            sizes = pd.DataFrame({"bucket": at.astype(np.int64), "n": np.bincount(code, weights=number, minlength=len(at)).astype(np.int64)})
            both = pd.concat((sizes, pd.DataFrame(bit_rows(slot_of(mini)), columns=["part", "bits"])))[["bucket", "n", "part", "bits"]]
            return both.astype({"bucket": "Int64", "n": "Int64", "part": "Int64"})

        for batch in batches:
            for text in batch["text"]:
                hashes = split_words(text)[3]
                if len(hashes) >= window:
                    _, number, mini = super_kmers(hashes, window, mer)
                    held.append((mini, number))
                    size += len(mini)
                    if size > HELD_MINIMISERS:
                        yield summed()
                        held.clear()
                        size = 0
        yield summed()

    counted = settle(rows.select("text").mapInPandas(count, "bucket long, n long, part long, bits binary"), "minimisers")
    sizes = settle(counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-sizes")
    again = rows.sparkSession.sparkContext.broadcast(met_again(counted.filter("part is not null").select("part", "bits")))
    mean = (sizes.agg(F.sum("n")).first()[0] or 0) / buckets
    hot = sizes.filter(F.col("n") > hot_factor * max(mean, 1)).select((F.col("bucket") % HOT_SLOTS).alias("slot")).distinct()
    # At most HOT_SLOTS; of more buckets than that, those that share a slot with a hot one are spread as well.
    hot_slots = np.array(sorted(r["slot"] for r in hot.collect()), np.uint64)

    def is_hot(mini: np.ndarray) -> np.ndarray:
        return np.isin(mini % np.uint64(buckets) % np.uint64(HOT_SLOTS), hot_slots)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, texts, size = [], [], 0

        def full() -> pd.DataFrame:
            head = np.concatenate(heads, axis=1) if heads else np.empty((4, 0), np.int64)
            to = head[0].view(np.uint64) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            groups = [g for g in np.split(order, cuts) if len(g)]
            return pd.DataFrame({"bucket": [int(to[g[0]]) for g in groups], "block": [pack(head[:, g], [texts[k] for k in g.tolist()]) for g in groups]})

        for batch in batches:
            for i, tie, text in zip(batch["id"].tolist(), batch["tie"].tolist(), batch["text"], strict=True):
                joined, starts, ends, hashes = split_words(text)
                if len(starts) < window:
                    continue
                first, number, mini = super_kmers(hashes, window, mer)
                sent = has_bit(again.value, slot_of(mini)) & ~is_hot(mini)
                first, number, mini = first[sent], number[sent], mini[sent]
                begin, end = starts[first].tolist(), ends[first + number + window - 2].tolist()
                texts += [joined[a:b] for a, b in zip(begin, end, strict=True)]
                heads.append(np.stack((mini.view(np.int64), np.full(len(first), i), np.full(len(first), tie), first)))
                size += sum(end) - sum(begin)
                if size > HELD:
                    yield full()
                    heads.clear()
                    texts.clear()
                    size = 0
        yield full()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def found() -> pd.DataFrame:
            heads, texts = zip(*map(unpack, held), strict=True)
            got = later_windows(np.concatenate(heads, axis=1), [t for part in texts for t in part], window)
            return pd.DataFrame(got, columns=["id", "tie", "first", "number"])

        for batch in batches:
            for bucket, block in zip(batch["bucket"].tolist(), batch["block"], strict=True):
                if held and bucket != at:
                    yield found()
                    held.clear()
                at = bucket
                held.append(block)
        if held:
            yield found()

    runs = "id long, tie long, first long, number long"
    blocks = rows.mapInPandas(send, "bucket long, block binary").repartition("bucket").sortWithinPartitions("bucket")
    later = blocks.mapInPandas(meet, runs)
    if not len(hot_slots):
        return later

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for batch in batches:
            out = []
            for i, tie, text in zip(batch["id"].tolist(), batch["tie"].tolist(), batch["text"], strict=True):
                words = WORD.findall(text)
                if len(words) < window:
                    continue
                at = np.flatnonzero(is_hot(minimisers(split_words(text)[3], window, mer)[1]))
                if len(at):
                    h = hashes.of(words)
                    codes = [rolling(h, window, m)[at].view(np.int64) for m in MULTIPLIERS[1:]]
                    out.append(pd.DataFrame({"h1": codes[0], "h2": codes[1], "id": i, "tie": tie, "first": at}))
            if out:
                yield pd.concat(out)

    alone = settle(rows.mapInPandas(spread, "h1 long, h2 long, id long, tie long, first long"), "hot-windows")
    where = F.struct("id", "tie", "first")
    firsts = alone.groupBy("h1", "h2").agg(F.min(where).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    more = alone.join(firsts, ["h1", "h2"]).filter(where != F.col("least")).select("id", "tie", "first", F.lit(1).cast("long").alias("number"))
    return later.unionByName(more)


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, mer: int = MER, bucket_chars: int = BUCKET_CHARS, hot_factor: int = HOT
) -> DataFrame:
    """One row per document: n_words, n_removed, and the kept words joined by one blank."""
    rows = numbered(docs)
    later = settle(repeated_windows(rows, window, mer, bucket_chars, hot_factor), "later-windows")
    later = later.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(
        F.collect_list("first").alias("first"), F.collect_list(F.col("number")).alias("number")
    )
    later = settle(later, "later-runs")
    slots = later.select(F.pmod(F.xxhash64("_id", "_tie"), F.lit(DOC_SLOTS)).alias("slot"))
    # At most DOC_SLOTS / 64 words of bits.
    words = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    losing = np.zeros(DOC_SLOTS // 64, np.int64)
    for r in words.collect():
        losing[r["at"]] = r["bits"]
    losing = rows.sparkSession.sparkContext.broadcast(losing)
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", "tie"), F.lit(DOC_SLOTS)))

    def loses(batch: pd.DataFrame) -> np.ndarray:
        at = batch["slot"].to_numpy(np.int64)
        return (losing.value[at >> 6] >> (at & 63)) & 1 == 1

    def answer(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])
        frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == NO_ID)
        return frame

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[~loses(batch)]
            words = [WORD.findall(text) for text in batch["text"]]
            yield answer([(i, len(w), 0, " ".join(w)) for i, w in zip(batch["id"].tolist(), words, strict=True)])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[loses(batch)][["id", "tie", "text"]]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, first, number in zip(batch["id"].tolist(), batch["text"], batch["first"], batch["number"], strict=True):
                words = WORD.findall(text)
                step = np.zeros(len(words) + 1, np.int64)
                if first is not None:  # else only another document's bit is set
                    np.add.at(step, first, 1)
                    np.add.at(step, np.asarray(first) + np.asarray(number) + window - 1, -1)
                keep = np.cumsum(step[:-1]) == 0
                out.append((i, len(words), int(len(words) - keep.sum()), " ".join(compress(words, keep))))
            yield answer(out)

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    met = rows.mapInPandas(rest, "id long, tie long, text string")
    met = met.join(later, (F.col("id") == F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").select("id", "text", "first", "number")
    return rows.select("id", "text", "slot").mapInPandas(whole, schema).unionByName(met.mapInPandas(cut, schema))


def digest(out: DataFrame) -> DataFrame:
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(substring_dedup(table(spark, sf_dir, "documents")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20) s),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM k) s WHERE n > 1),
m AS (SELECT p.doc_id, p.i, p.x,
             max(CASE WHEN l.i IS NOT NULL THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS near
      FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.i = p.i)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(near)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(x, ' ' ORDER BY m.i) FILTER (WHERE near IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
