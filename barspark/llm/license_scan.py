"""Find licence notices and identifier tags in texts, and evaluate licence expressions.

One Aho-Corasick automaton finds all notice phrases and the identifier tag in a single pass over the words of
a text. Behind a tag, a shunting-yard parser reads the licence expression (identifiers joined by AND, OR and
WITH, with brackets) and evaluates how free it is: OR takes the freer side, AND the stricter one, WITH lifts
a copyleft licence by its exception. The phrases and tables are fixed, so the automaton is built per worker.

Defined results: a null text is an empty one: no words, no labels, score 0.5 (nothing known). Words are cut
at every ASCII sign that is no letter or digit. A tag without a readable expression gives the label tag only.
Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barspark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "boost software license": "boost",
}
TAG = "spdx license identifier"
#: How free a text under a label or identifier is to use, from 0 to 1; identifiers by their first part.
FREEDOM = {
    "reserved": 0.0, "proprietary": 0.0, "agpl": 0.3, "gpl": 0.4, "lgpl": 0.6, "mpl": 0.7, "epl": 0.7, "cc-by": 0.8, "cc": 0.8,
    "creative-commons": 0.7, "apache": 0.9, "bsd": 0.9, "mit": 0.9, "isc": 0.9, "boost": 0.9, "bsl": 0.9, "zlib": 0.9,
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0,
}
UNKNOWN = 0.5
WITH_LIFT = 0.3
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def freedom(name: str) -> float:
    parts = name.split("-")
    for n in range(min(2, len(parts)), 0, -1):
        if (found := FREEDOM.get("-".join(parts[:n]))) is not None:
            return found
    return UNKNOWN


def postfix(text: str) -> list[str]:
    """The longest licence expression at the start of a lower-case line, in postfix order (shunting yard); empty if none."""
    out: list[str] = []
    held: list[str] = []
    best: list[str] = []
    operand, end = True, 0
    for m in TOKEN.finditer(text):
        token = m.group()
        if text[end : m.start()].strip(" \t"):
            break
        end = m.end()
        if token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in RANK:
            if operand:
                break
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
        if not operand and "(" not in held:
            best = out + held[::-1]
    return best


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """Freedom of an expression in postfix order, and its licence identifiers."""
    stack: list[tuple[float, list[str]]] = []
    for token in rpn:
        if token in RANK:
            b, a = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, a[0] + WITH_LIFT) if a[0] < 0.9 else a[0], a[1]))
            else:
                stack.append(((max if token == "or" else min)(a[0], b[0]), a[1] + b[1]))
        else:
            stack.append((freedom(token), [token]))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase), label, True))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase), label, False))
    found.add_word(f" {TAG} ", (len(TAG), "spdx", False))
    found.make_automaton()
    return found


#: A tag as the words see it, and the rest of its line.
TAGGED = re.compile(r"(?<![a-z0-9\x80-\U0010ffff])spdx[\x00-\x2F\x3A-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x60\x7B-\x7F]+identifier(?![a-z0-9\x80-\U0010ffff])[ \t:=]*([^\n]*)")


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words = WORD.findall(low)
    joined = f" {' '.join(words)} "
    starts: list[int] = []
    base, labels, scores = set(), set(), []
    for end, (length, label, is_base) in automaton().iter(joined):
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(end - length)
        if label != "spdx":
            scores.append(freedom(label))
    starts.sort()
    # Blanks before a place are words before it; counted from place to place, so each character is passed once.
    at = list(accumulate((joined.count(" ", a, b) for a, b in zip([1, *starts], starts, strict=False)), initial=0))[1:]
    if "spdx" in labels:
        for m in TAGGED.finditer(low):
            if rpn := postfix(m.group(1)):
                score, names = evaluate(rpn)
                scores.append(score)
                labels.update(f"spdx:{n}" for n in names)
    return (
        len(words), len(starts), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=UNKNOWN),
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document with its licence evidence; each text is read once, with no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame([scan(t) for t in rows["text"]], columns=SCHEMA.replace(",", "").split()[2::2])
            whole = dict.fromkeys(("doc_id", "n_words", "n_base", "first_word", "last_word"), "Int64")
            yield pd.concat([rows[["doc_id"]].reset_index(drop=True), found], axis=1).astype(whole)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
