"""Main text of web pages: boosted trees judge each block, and a decoding over the tree makes the choices agree.

A page is a tree of block elements. Spark's gradient-boosted trees judge a block from its tag, its attribute
words and those above it, the text, link and tag density of its subtree, its depth, and its siblings.
Decoding then keeps or drops whole subtrees: dropping a block drops all below it, keeping one requires all
above it, and of all such choices the one with the largest total of log odds times text is taken.

The trees are trained on TRAIN_PAGES of the pages that mark their main part (article or main) and have a
paragraph, those with the smallest digest of page_id. Each is trained on as it is and rebuilt in LAYOUTS other
layouts with plain elements, menus, notices, adverts, forms, related links and reader comments around and
inside its text, so that blocks are not told by one element's name. A table without such a page is judged by
trees trained on BUNDLED pages made by rule, in the same layouts.

Defined results: a null html is empty, with empty text; a head, paragraph, list item or table cell whose end
tag is left out ends where browsers end it, other unclosed elements with the page, and stray end tags are
ignored; pages are read whole, however long; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table
from barspark.llm.html_tree import Page, block_features

#: Bound of the training sample, layouts each page is rebuilt in, and the size of the model.
TRAIN_PAGES, BUNDLED, LAYOUTS, TREES, DEPTH = 400, 120, 4, 40, 5
#: No block's judgement counts more than this (log odds); this share of it is the judgement on the block above.
MOST, FROM_ABOVE = 4.0, 0.35

MARKED = re.compile(r"<(article|main)\b[^>]*>(.*?)(?=</\1>|<footer|</body|$)", re.S | re.I)
PARAGRAPH = re.compile(r"<p>([^<>]{20,})")
Trees = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def layouts(html: str, seed: int) -> list[str]:
    """A marked page and the same text in other layouts, with data-main on what is main text and what is not."""
    found = MARKED.search(html)
    if not found:
        return []
    body, rng = found.group(2), random.Random(seed)
    sentences = [s.strip() for p in PARAGRAPH.findall(body) for s in p.split(".") if 10 < len(s.strip()) < 400] or ["More text"]
    words = " ".join(sentences).split()
    pick = lambda *options: rng.choice(options)
    some = lambda least, most: ". ".join(rng.choice(sentences) for _ in range(rng.randint(least, most))) + "."
    few = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    items = lambda k: "".join(f'<li><a href="/{i}">{few()}</a></li>' for i in range(k))

    def element(tag: str, attr: str, inner: str) -> str:
        return f'<{tag}{attr} data-main="0">{inner}</{tag}>'

    def boxed(names: str, tag: str, inner: str) -> str:
        """A part that is not main text: a telling element, or a plain one with a telling class or id."""
        if tag != "div" and rng.random() < 0.4:
            return element(tag, "", inner)
        return element(pick("div", "section", tag), f' {pick("class", "id")}="{pick(*names.split())}"', inner)

    def inside(text: str) -> str:
        parts = re.split(r"(?=<p>)", text)
        if len(parts) > 2 and rng.random() < 0.6:
            extra = pick(
                boxed("ad ads advert sponsored promo", "div", some(1, 2)), boxed("share social", "div", f"<ul>{items(3)}</ul>"),
                boxed("related recommended", "aside", f"<h3>{few()}</h3><ul>{items(4)}</ul>"), boxed("newsletter subscribe", "form", f"<p>{some(1, 1)}</p><label>{few()}</label>"),
            )
            parts.insert(rng.randrange(1, len(parts)), extra)
        return "".join(parts)

    def around() -> tuple[str, str]:
        top = [boxed("nav navbar menu navigation", "nav", f"<ul>{items(rng.randint(3, 9))}</ul>")]
        if rng.random() < 0.7:
            top.append(boxed("header masthead banner", "header", f"<div>{few()}</div><p>{some(1, 1)}</p>"))
        if rng.random() < 0.6:
            top.append(boxed("cookie consent notice alert", "div", f"<p>{some(1, 2)}</p>"))
        if rng.random() < 0.6:
            top.append(boxed("ad ads advert banner sponsored", "div", some(1, 2)))
        end = []
        if rng.random() < 0.7:
            posts = "".join(element(pick("div", "li", "article"), ' class="comment"', f"<p>{some(1, 4)}</p>") for _ in range(rng.randint(1, 6)))
            end.append(boxed("comments discussion replies", "section", f"<h3>{few()}</h3>{posts}"))
        if rng.random() < 0.6:
            end.append(boxed("sidebar related popular widget", "aside", f"<h4>{few()}</h4><ul>{items(5)}</ul><p>{some(1, 2)}</p>"))
        if rng.random() < 0.5:
            end.append(boxed("login search signup", "form", f"<p>{few()}</p><label>{few()}</label>"))
        end.append(boxed("footer copyright legal", "footer", f"<p>{some(1, 1)}</p><ul>{items(3)}</ul>"))
        return "".join(top), "".join(end)

    out = [html[: found.start()] + f'<{found.group(1)} data-main="1">{body}</{found.group(1)}>' + html[found.end() :]]
    for _ in range(LAYOUTS):
        top, end = around()
        tag, attr = pick(("article", ""), ("main", ""), ("div", ' class="post-content"'), ("div", ' id="content"'), ("section", ' class="entry"'), ("div", ' class="story"'), ("div", ""))
        main = f'<{tag}{attr} data-main="1">{inside(body)}</{tag}>'
        if rng.random() < 0.5:
            main = f'<div class="{pick("wrapper", "container", "page", "row")}">{main}{end}</div>'
            end = ""
        out.append(f"<html><head><title>{few()}</title></head><body>{top}{main}{end}</body></html>")
    return out


def bundled_pages(n: int = BUNDLED) -> list[tuple[str, int]]:
    """(html, seed) of marked pages of made-up words, for tables that mark none."""
    out = []
    for seed in range(n):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))  # noqa: E731, B023
        sentence = lambda: f"{' '.join(word() for _ in range(rng.randint(5, 16)))}.".capitalize()  # noqa: E731, B023
        prose = lambda most: " ".join(sentence() for _ in range(rng.randint(1, most)))  # noqa: E731, B023
        text = ""
        for _ in range(int(2 ** rng.uniform(1, 6))):
            kind = rng.random()
            if kind < 0.7:
                text += f"<p>{prose(6)}</p>"
            elif kind < 0.8:
                text += f"<h2>{word()} {word()}</h2><p>{prose(3)}"
            elif kind < 0.9:
                text += f"<p><b>{sentence()}</b><br>{prose(2)}</p>"
            else:
                text += rng.choice((f"<blockquote>{prose(2)}</blockquote>", f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>", f"<div><p>{prose(2)}</p></div>"))
        menu = "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(5))
        out.append((f"<html><head><title>{word()}</title></head><body><nav><ul>{menu}</ul></nav><article><h1>{sentence()}</h1>{text}</article><footer><p>{sentence()}</p></footer></body></html>", seed))
    return out


def training_rows(pages: DataFrame) -> DataFrame:
    """(features, label) of the blocks of the sample; blocks that hold both kinds are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for html, seed in zip(rows["html"], rows["seed"], strict=True):
                for k, text in enumerate(layouts(html or "", int(seed) + 1)):
                    page = Page(text)
                    x, size = block_features(page)
                    mixed = set()
                    for i, truth in enumerate(page.truth):
                        if truth is not None and (p := page.parents[i]) >= 0 and page.truth[p] != truth:
                            while p >= 0 and p not in mixed:
                                mixed.add(p)
                                p = page.parents[p]
                    out += [(x[i].tolist(), float(bool(t))) for i, t in enumerate(page.truth) if i and size[i] and i not in mixed]
            yield pd.DataFrame(out, columns=["features", "label"])

    return pages.mapInPandas(run, "features array<double>, label double")


def train(pages: DataFrame, n: int = TRAIN_PAGES) -> Trees:
    """The boosted trees as arrays: feature, threshold, left and right child, value (weight included)."""
    order = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    marked = F.col("html").rlike(r"(?i)<(article|main)\b") & F.col("html").rlike(PARAGRAPH.pattern)
    sample = pages.filter(marked).select("html", order.alias("o"), F.crc32(order).alias("seed")).orderBy("o", "html").limit(n)
    rows = settle(training_rows(sample), "html-train")
    if {r["label"] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        rows = settle(training_rows(pages.sparkSession.createDataFrame(bundled_pages(), "html string, seed long")), "html-train")
    vectors = rows.coalesce(1).select(array_to_vector("features").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64).fit(vectors)
    return [flat(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]


def flat(root, weight: float) -> tuple[np.ndarray, ...]:
    """A tree of Spark's as arrays; a leaf is its own child."""
    feature, threshold, left, right, value = [], [], [], [], []

    def visit(node) -> int:
        k = len(feature)
        leaf = node.subtreeDepth() == 0
        for values, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, weight * node.prediction())):
            values.append(v)
        if not leaf:
            feature[k], threshold[k] = node.split().featureIndex(), node.split().threshold()
            left[k], right[k] = visit(node.leftChild()), visit(node.rightChild())
        return k

    visit(root)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log odds of main text per row of features."""
    total, each = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = np.where(x[each, feature[at]] <= threshold[at], left[at], right[at])
        total += value[at]
    return 2 * total


def decode(page: Page, odds: np.ndarray, size: np.ndarray) -> list[bool]:
    """Blocks kept by the best choice in which all blocks above a kept one are kept."""
    n = len(page.tags)
    odds, root = np.clip(odds, -MOST, MOST), np.array([t in ("html", "body") for t in page.tags])
    above = np.maximum(page.parents, 0)
    gain = np.where(root[above], odds, (1 - FROM_ABOVE) * odds + FROM_ABOVE * odds[above]) * np.where(root, 0, size)
    best = gain.tolist()
    for k in range(n - 1, 0, -1):
        if best[k] > 0:
            best[page.parents[k]] += best[k]
    keep = [True] * n
    for k in range(1, n):
        keep[k] = keep[page.parents[k]] and best[k] > 0
    return keep


def main_text(page: Page, odds: np.ndarray, size: np.ndarray) -> str:
    """Text of the blocks that decoding keeps, in page order."""
    keep = decode(page, odds, size)
    return " ".join(" ".join("".join(parts).split()) for block, parts in page.segments if keep[block]).strip()


def extract_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            read = [Page(h or "") for h in rows["html"]]
            known = [block_features(p) for p in read]
            odds = log_odds(trees, np.concatenate([x for x, _ in known])) if known else np.empty(0)
            cuts = np.cumsum([len(x) for x, _ in known])[:-1]
            texts = [main_text(p, o, s) for p, o, (_, s) in zip(read, np.split(odds, cuts), known, strict=True)] if known else []
            out = pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})
            yield out.astype({"page_id": "Int64", "n_chars": "int64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train(pages))
