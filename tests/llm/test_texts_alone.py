"""Operators that judge a text by itself: licences, tokens, main text of pages, benchmark items."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barspark.llm import decontamination as dc
from barspark.llm import html_extract as hx
from barspark.llm.html_tree import Page, block_features
from barspark.llm.license_scan import evaluate, license_scan, postfix, scan
from barspark.llm.token_counts import counter, token_counts
from tests.llm.texts import frame, lower, odd_rows, prose

PAGES = "page_id long, url string, html string, text string"


def test_licence_places_against_plain_search(spark):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    extra = ["CC-BY cc by", "x General  Public\nLicense cc", "All Rights Reserved. all rights reserved", "ccby cc, by.", "généralpublic license", "cc by" * 3]
    rows = odd_rows() + [(600 + k, t, "en", "s") for k, t in enumerate(extra)]
    want = []
    for i, t, _, _ in rows:
        w, places, labels = word.findall(lower(t or "")), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((-1 if i is None else i, len(w), len(places), min(places, default=-1), max(places, default=-1), ",".join(sorted(labels))))
    got = license_scan(frame(spark, rows)).fillna(-1).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert license_scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "rpn", "score", "names"),
    [
        ("mit or gpl-2.0-only", ["mit", "gpl-2.0-only", "or"], 0.9, ["mit", "gpl-2.0-only"]),
        ("mit and gpl-2.0-only", ["mit", "gpl-2.0-only", "and"], 0.4, ["mit", "gpl-2.0-only"]),
        ("mit or isc and agpl-3.0", ["mit", "isc", "agpl-3.0", "and", "or"], 0.9, ["mit", "isc", "agpl-3.0"]),
        ("(mit or isc) and agpl-3.0", ["mit", "isc", "or", "agpl-3.0", "and"], 0.3, ["mit", "isc", "agpl-3.0"]),
        ("gpl-2.0 with classpath-exception-2.0 */", ["gpl-2.0", "classpath-exception-2.0", "with"], 0.7, ["gpl-2.0"]),
        ("mit and", ["mit"], 0.9, ["mit"]),
        ("mit isc", ["mit"], 0.9, ["mit"]),
    ],
)
def test_expressions(text, rpn, score, names):
    assert postfix(text) == rpn
    got = evaluate(rpn)
    assert abs(got[0] - score) < 1e-12 and got[1] == names


def test_tags_and_bad_expressions():
    assert postfix("") == [] == postfix("((mit)") == postfix("or mit")
    assert scan("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode")[5:] == ("spdx,spdx:apache-2.0,spdx:mit", 0.9)
    assert scan("SPDX License Identifier") == (3, 0, None, None, "", "spdx", 0.5)
    assert scan(None) == (0, 0, None, None, "", "", 0.5)


def test_tokens_at_every_prefix(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = odd_rows() + [(700, "<s> a\x00b ▁▁ x  \r\n ﬁ é́ </s><unk> 00 -- ..", "en", "s"), (701, " lead and trail  ", "en", "s")]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(frame(spark, rows), limit=100).collect()}
    assert got == {(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, _, _ in rows}
    assert token_counts(frame(spark, [])).count() == 0
    c, rng = counter("piece_bpe_32k.model"), random.Random(4)
    signs = list("aàbcdetion  \n\tEZ漢字😀é<s>/▁\x00'\"--==##09")
    for _ in range(60):
        text = "".join(rng.choice(signs) for _ in range(40))
        at = [len(sp.encode(text[:k])) for k in range(len(text) + 1)]
        assert c.count(text) == at[-1]
        for budget in (1, 5, 12, 99):
            assert c.longest_prefix(text, budget) == max(k for k, n in enumerate(at) if n <= budget)


def test_benchmark_items_with_edits_are_found(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(9, 70))) for k in range(60)] + [(90, "too short"), (91, None), (92, "")]
    rows, want = [], {}
    for n in range(240):
        item, rate = rng.randrange(60), rng.choice((0, 0.1, 0.2))
        w = items[item][1].split()
        for _ in range(int(rate * len(w))):
            k, kind = rng.randrange(len(w)), rng.random()
            w[k : k + 1] = ["edited"] if kind < 0.4 else [] if kind < 0.7 else [w[k], "added"]
        text = f"{prose(rng, rng.randint(0, 60))} {' '.join(w).upper()}, {prose(rng, rng.randint(0, 60))}"
        rows.append((n, text, "en", "s"))
        want[n] = item
    rows += [(1000 + k, prose(rng, 200), "en", "s") for k in range(40)] + [r for r in odd_rows() if r[0] is None or r[0] >= 400]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_leaks(frame(spark, rows), benchmark).collect()
    words = {k: [w.decode() for w in dc.words_in(t)] for k, t in items}
    texts = {r[0]: [w.decode() for w in dc.words_in(r[1])] for r in rows if r[0] is not None and r[0] < 2000}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    exact = {(d, i): e for d in texts for i in range(60) if (e := dc.best_place(words[i], texts[d])[0]) <= dc.edits(len(words[i]))}
    assert set(got) <= set(exact) and all(got[k] == exact[k] for k in got)
    assert len(got) >= 0.97 * len(exact) and len(exact) >= len(want)
    assert {d for d, _ in got if d is not None and d >= 1000} == {d for d, _ in exact if d >= 1000}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(frame(spark, rows), empty).count() == 0 and dc.find_leaks(frame(spark, []), benchmark).count() == 0


def test_best_place_against_the_full_table():
    rng = random.Random(2)
    for _ in range(200):
        item, text = [rng.choice("abc") for _ in range(rng.randint(1, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 15))]
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            new = [0]
            for k, x in enumerate(item, start=1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != w)))
            row, best = new, min(best, new[-1])
        assert dc.best_place(item, text)[0] == best


@pytest.fixture(scope="module")
def judged(spark):
    """Trees trained on half of the given pages, and the other half."""
    import hashlib

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    order = sorted(pages.collect(), key=lambda r: hashlib.md5(str(r["page_id"]).encode()).hexdigest())
    n = len(order) // 2
    return hx.train(pages, n), order[n:]


def test_held_out_pages_in_other_layouts(judged):
    trees, rest = judged
    scores = []
    for r in rest[:60]:
        for html in hx.layouts(r["html"], 5000 + r["page_id"]):
            page = Page(html)
            x, size = block_features(page)
            got = Counter(hx.main_text(page, hx.log_odds(trees, x), size).split())
            want = Counter(w for b, parts in page.segments if page.truth[b] for w in "".join(parts).split())
            scores.append(2 * (got & want).total() / (got.total() + want.total()))
    assert sum(scores) / len(scores) >= 0.95


def test_odd_pages(spark, judged):
    trees, rest = judged
    main = "<p>One &amp; two,\n three&nbsp;<b>bo</b>ld words of the story.<p>The next<br>line &lt;of&gt; it, with some more words."
    odd = [(1, "u", f"<html><body><nav><a href=x>menu</a></nav><article>{main}</article><script>var t='</p>'</script></body>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<p", "t"), (4, "u", "<style>x</style><!-- c -->", "t")]
    out = {r["page_id"]: r for r in hx.extract_text(spark.createDataFrame(odd + odd[:1], PAGES), trees).collect()}
    assert out[1]["text"] == "One & two, three bold words of the story. The next line <of> it, with some more words."
    assert out[1]["n_chars"] == len(out[1]["text"]) and all(out[k]["text"] == "" for k in (2, 3, 4, None))
    none = spark.createDataFrame([], PAGES)
    assert hx.extract_text(none, hx.train(none)).count() == 0
    pages = spark.createDataFrame([(r["page_id"], r["url"], r["html"], "t") for r in rest], PAGES)
    assert hx.extract_text(pages, trees).agg(F.countDistinct("page_id")).first()[0] == len(rest)
