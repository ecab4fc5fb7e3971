"""Language identification against a plain naive Bayes, and on held-out rows of a given table."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barspark.llm import language_id as li
from tests.llm.texts import frame, odd_rows, prose

SF = "/root/testdata/sf0.01"


def plain_grams(text: str, bits: int) -> list[int]:
    """Every run of 1 to SIZES characters without a blank inside, one by one."""
    clean, last = " ", " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            clean += c
        last = c
    clean = clean if clean.endswith(" ") else clean + " "
    out = []
    for n in range(1, li.SIZES + 1):
        for k in range(len(clean) - n + 1):
            run = clean[k : k + n]
            if " " in run[1:-1] or run == " " or run == "  ":
                continue
            code = 0
            for c in run:
                code = (code * 0x01000193 + (ord(c) if c != " " else 0)) & 0xFFFFFFFF
            code = ((code + (n * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
            code ^= code >> 15
            out.append((code * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits))
    return out


def plain_model(rows: list[tuple], bits: int):
    counts: dict[str, Counter] = {}
    texts: Counter = Counter()
    for i, text, lang in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        texts[lang] += 1
        counts.setdefault(lang, Counter()).update(plain_grams(text, bits))
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + li.SMOOTHING * (1 << bits)
        logs[lang] = (math.log(texts[lang] / sum(texts.values())), c, total)
    return logs


def plain_predict(text: str | None, model, bits: int) -> tuple[str, float]:
    if not model or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = {}
    for lang, (prior, c, n) in model.items():
        total[lang] = prior + sum(math.log((c[g] + li.SMOOTHING) / n) for g in plain_grams(text, bits))
    best = min(total, key=lambda k: (-total[k], k))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def corpus() -> list[tuple]:
    rng = random.Random(5)
    rows = odd_rows() + [(700 + k, prose(rng, 30).replace("the", "der").replace("an", "ung"), "de", "s") for k in range(12)]
    rows += [(800, "½ 1 _ 2!", "en", "s"), (801, "É", "fr", "s"), (802, "x" * 270_000 + " y z", "en", "s"), (803, "日本語 の文", "ja", "s"), (804, "İstanbul DŽ ß", None, "s")]
    return rows + [rows[0]]


@pytest.mark.parametrize("bits", [8, 12])
def test_against_plain_naive_bayes(spark, bits):
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    got = li.language_id(docs, li.train(docs, bits)).collect()
    model = plain_model([r[:3] for r in rows], bits)
    assert len(got) == len(rows)
    want = Counter()
    for i, text, _, _ in rows:
        lang, score = plain_predict(text, model, bits)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, lang, round(score, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in got) == want


def test_grams_of_many_texts_at_once():
    texts = ["", "a", " b c", "1", "", "De  Fg.", "!", "ǅx"]
    low = [t.lower() for t in texts]
    grams, full, place = li.n_grams(low, 10)
    assert [texts[k] for k in full] == ["a", " b c", "De  Fg.", "ǅx"]
    ends = np.append(place[1:], 1 << 30)
    for k, a, b in zip(full.tolist(), place.tolist(), ends.tolist(), strict=True):
        mine = sorted(int(x) for g in grams for x in g[a:b] if x < 1 << 10)
        assert mine == sorted(plain_grams(texts[k], 10))


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "some text", None, "s"), (None, "other", "en", "s"), (2, None, "en", "s")])
    got = li.language_id(docs, li.train(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 3
    assert li.language_id(frame(spark, []), li.train(frame(spark, []))).count() == 0


def test_fewer_buckets_for_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "CELLS", 40 << 10)
    rng = random.Random(8)
    docs = frame(spark, [(k, f"{chr(97 + k % 26)}{chr(97 + k % 7)} " * 20 + prose(rng, 5), f"l{k % 60:02d}", "s") for k in range(400)])
    model = li.train(docs)
    assert len(model.langs) == 60 and len(model.langs) << model.bits <= 40 << 10


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = li.op12_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() >= 0.98
    held = li.learnable(docs).count() + out.shape[0]
    assert held == docs.filter("lang is not null and text is not null").count()
