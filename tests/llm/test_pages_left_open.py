"""Pages with end tags left out, tables that mark no main part, and the decoding against all choices."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import html_extract as hx
from barspark.llm.html_tree import Page, block_features

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return hx.train(pages)


@pytest.mark.parametrize("tag", ["head", "body", "p", "li"])
def test_end_tag_left_out(pages, trees, tag):
    plain = {r["page_id"]: r["text"] for r in hx.extract_text(pages, trees).collect()}
    assert sum(map(len, plain.values())) > 1000
    for r in hx.extract_text(pages.withColumn("html", F.replace("html", F.lit(f"</{tag}>"), F.lit(""))), trees).collect():
        assert r["text"] == plain[r["page_id"]]


def test_head_ends_where_browsers_end_it():
    texts = lambda html: [" ".join("".join(p).split()) for _, p in Page(html).segments]
    assert texts("<head><title>t</title><p>a") == ["a"]
    assert texts("<head><meta x><style>b{}</style>word<div>c</div>") == ["word", "c"]
    assert texts("<html><head><script>var p = '<p>no</p>';</script><body>d") == ["d"]
    assert texts("<head></head><template>no</template>e") == ["e"]
    assert texts("<head><br>f") == ["f"]


def test_table_without_marked_pages(pages):
    plain = pages.withColumn("html", F.regexp_replace("html", r"(?i)<(/?)(article|main)\b", "<$1div"))
    marked = {r["page_id"]: hx.MARKED.search(r["html"] or "") for r in pages.collect()}
    trees, score = hx.train(plain), []
    for r in hx.extract_text(plain, trees).collect():
        if marked[r["page_id"]]:
            want = Counter(re.sub(r"<[^>]*>", " ", marked[r["page_id"]].group(2)).split())
            got = Counter(r["text"].split())
            score.append(2 * (want & got).total() / max(1, want.total() + got.total()))
    assert trees and np.mean(score) > 0.8
    assert hx.train(plain.limit(0))


def test_sample_takes_marked_pages_only(spark, pages):
    """Many unmarked pages with smaller digests do not use up the bound."""
    more = spark.range(10_000, 11_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<div><p>no mark, but a paragraph that is long enough</p></div>").alias("html"))
    a, b = hx.train(pages, 50), hx.train(pages.select("page_id", "url", "html").unionByName(more), 50)
    assert len(a) == len(b) and all((x == y).all() for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True))


def test_decoding_against_all_choices():
    rng = random.Random(6)
    for _ in range(300):
        html, depth = "", 0
        for _ in range(rng.randint(1, 9)):
            while depth and rng.random() < 0.4:
                html, depth = html + "</div>", depth - 1
            html, depth = html + f"<div>{'x' * rng.randint(0, 5)}", depth + 1
        page = Page(html)
        n, size = len(page.tags), block_features(page)[1]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        gain = [0.0]
        for k in range(1, n):
            up = page.parents[k]
            gain.append((odds[k] if page.tags[up] == "html" else (1 - hx.FROM_ABOVE) * odds[k] + hx.FROM_ABOVE * odds[up]) * size[k])
        best = max(
            sum(gain[k] for k in range(1, n) if kept[k - 1])
            for kept in itertools.product([False, True], repeat=n - 1)
            if all(not kept[k - 1] or page.parents[k] == 0 or kept[page.parents[k] - 1] for k in range(1, n))
        )
        keep = hx.decode(page, odds, size)
        assert all(not keep[k] or keep[page.parents[k]] for k in range(1, n))
        assert abs(sum(gain[k] for k in range(1, n) if keep[k]) - best) < 1e-9


def test_very_long_page(trees):
    html = "<head><title>x</title><body><article>" + "".join(f"<p>sentence number {k} of a long article, with words." for k in range(20_000))
    page = Page(html)
    x, size = block_features(page)
    assert hx.main_text(page, hx.log_odds(trees, x), size).count("sentence number") > 19_000
