"""Small frames with every odd case, and plain answers to compare the operators with."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, row long, size long, id long, _key string, bucket long"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int) -> str:
    vocab = ["the", "of", "and", "in", "to"]
    out = [rng.choice(vocab) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(out)).strip()


def odd_rows() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, copies, a shared passage."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(15, 160)) for _ in range(24)]
    passage = prose(rng, 60)
    rows = [(k, t, "en", f"src{k % 5}") for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 3], "en", "src0") for k in range(7)]  # copies
    rows += [(200 + k, f"{prose(rng, 12)} {passage} {prose(rng, 12)}", "fr", "src1") for k in range(5)]
    edited = base[4].split(" ")
    edited[3] = "changed"
    rows += [(300, " ".join(edited), "en", "src2"), (301, base[5] + " tail", None, None)]
    rows += [(400, None, None, None), (401, "", "en", "src1"), (402, " \t\n ", "en", None), (None, base[6], "en", "src3"), (None, None, None, None)]
    rows += [(403, "one two", "en", "src1"), (403, "one two", "en", "src1"), (404, base[7], "en", "src1"), (404, base[8], "en", "src4")]
    rows += [(405, "ha " * 400, "en", "src1"), (406, prose(rng, 30_000), "de", "src1"), (407, "x" * 100_000, "en", "src2")]
    rows += [(408, "Some # * $ % & | < > signs\n\nSome # * $ % & | < > signs\n", "en", "src2"), (409, "日本語 テキスト 😀 " * 9, "ja", "src2")]
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents with further columns whose names operators may use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "w", 1, 2, 3, "u", 4) for i, t, lang, s in rows], SCHEMA)


def covered(starts: set[int], length: int) -> set[int]:
    return {s + k for s in starts for k in range(length)}


def rule_counts(text: str | None) -> tuple:
    w = words(text)
    seen: dict[tuple, list[int]] = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeat = len(covered({s for v in seen.values() if len(v) > 1 for s in v}, 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def without_repeats(rows: list[tuple], window: int) -> dict[tuple, tuple[int, str]]:
    """(doc_id, text) to number of removed words and kept text. Equal rows are one document."""
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    first: dict[tuple, tuple] = {}
    gone: dict[tuple, set[int]] = {}
    for n, r in enumerate(order):
        w = words(r[1])
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (n, k)) != (n, k):
                gone.setdefault(r, set()).update(range(k, k + window))
    return {r: (len(gone.get(r, ())), " ".join(w for k, w in enumerate(words(r[1])) if k not in gone.get(r, ()))) for r in order}


def tie(text: str | None) -> int:
    """Spark's xxhash64 of a text."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def classes(n: int, linked) -> list[int]:
    """Smallest index that links lead to, for items 0 to n - 1."""
    up = list(range(n))

    def top(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(k) for k in range(n)]
