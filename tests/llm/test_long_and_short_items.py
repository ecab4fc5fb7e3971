from __future__ import annotations

import random

from barspark.llm import decontamination as dc
from tests.llm.texts import frame, prose


def test_long_items_with_all_their_edits_are_found(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, (20, 58, 120, 250)[k % 4])) for k in range(24)]
    rows, want = [], set()
    for n in range(144):
        k, kind = n % 24, ("deleted", "mixed", "changed")[n % 3]
        w = items[k][1].split()
        for _ in range(dc.edits(len(w))):
            at, do = rng.randrange(len(w)), rng.randrange(3) if kind == "mixed" else 0 if kind == "deleted" else 1
            w[at : at + 1] = [[], ["edited"], [w[at], "added"]][do]
        rows.append((n, f"{prose(rng, 40)} {' '.join(w)} {prose(rng, 40)}", "en", "s"))
        want.add((n, k))
    found = dc.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(want & got) >= 0.99 * len(want)
    assert all(r["edits"] <= dc.edits(r["n_words"]) for r in found)


def test_pieces_cover_items_and_share_the_edits():
    for n in range(dc.MIN_WORDS, 400):
        cut = dc.pieces(n)
        assert [a for a, _ in cut] + [n] == [0] + [b for _, b in cut]
        assert min(b - a for a, b in cut) >= min(n, dc.PIECE) and max(b - a for a, b in cut) < 2 * dc.PIECE
        assert sum(dc.edits(b - a) + 1 for a, b in cut) > dc.edits(n)  # if all had more than their share, so had the item


def test_short_items_and_scripts_without_blanks(spark):
    han = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    items = [(1, "What is seven times eight?"), (2, "Quokka"), (3, han), (4, "鳥が鳴く"), (5, "?!"), (6, "nowhere at all")]
    texts = ["so, what is SEVEN times eight", "what is seven plus eight", "a quokka", "quokkas", f"前の文。{han}後の文。", f"前の文{han[:9]}変{han[10:]}後", "今日も鳥が鳴く声", "鳥は鳴く", "", "at all nowhere"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    found = dc.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == [(0, 1, 0), (2, 2, 0), (4, 3, 0), (5, 3, 1), (6, 4, 0)]


def test_word_hashes_follow_the_words():
    """One hash a word, the same wherever the word stands, none for a text without words."""
    rng = random.Random(4)
    texts = ["", " -- ", None, "a", "A b a", "x" * 9000 + " " + "x" * 9001, "naïve Ünit 漢字かな ไทย mixed漢end", "\ud800 lone"]
    texts += [" ".join(rng.choice(["ab", "ba", "a", "b0", "0b", "é", "漢", "...", "ab,ba"]) for _ in range(60)) for _ in range(40)]
    seen = {}
    for text in texts:
        words, hashes = dc.words_in(text), dc.word_hashes(dc.lowered(text)).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert h and seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 15


def test_only_places_with_enough_words_are_compared_in_full():
    """A stretch that lacks too many of an item's words is left out, and none that holds it."""
    rng = random.Random(5)
    pool, left_out = [f"w{k}" for k in range(40)], 0
    for _ in range(600):
        item = [rng.choice(pool) for _ in range(rng.choice([3, 7, 8, 15, 40]))]
        part = [w for w in item if rng.random() > 0.1]
        text = [rng.choice(pool) for _ in range(20)] + rng.choice([part, part[: len(part) // 2], []]) + [rng.choice(pool) for _ in range(5)]
        held = dc.best_place(item, text)[0] <= dc.allowed(len(item))
        assert dc.may_hold(item, text) or not held
        left_out += not dc.may_hold(item, text)
    assert left_out > 100
