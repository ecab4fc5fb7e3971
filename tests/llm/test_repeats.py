from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from barspark.llm.line_dedup import line_dedup
from barspark.llm.substring_dedup import digest, substring_dedup
from tests.llm.texts import frame, odd_rows, words, without_repeats


@pytest.mark.parametrize(("chars", "hot"), [(2_000_000, 8), (400, 8), (400, 0)])
def test_substrings_against_plain_search(spark, chars, hot):
    """With the usual buckets, with many small ones, and with every bucket spread by window."""
    rows = odd_rows()
    got = substring_dedup(frame(spark, rows), bucket_chars=chars, hot_factor=hot).collect()
    want = without_repeats(rows, 20)
    view = lambda i, n, gone, text: (-1 if i is None else i, n, gone, text)
    assert sorted(view(*r) for r in got) == sorted(view(i, len(words(t)), *want[i, t]) for i, t, _, _ in rows)


def test_substring_digest_and_empty_table(spark):
    out = digest(substring_dedup(frame(spark, [(1, None, None, None), (2, "a  b", "en", "s")]))).orderBy("doc_id").collect()
    assert [r["kept_sha256"] for r in out] == [hashlib.sha256(x).hexdigest() for x in (b"", b"a b")]
    assert substring_dedup(frame(spark, [])).count() == 0


def lines_kept(rows, length=3, enough=50):
    """Plain answer for doc_ids that differ: lines removed, and the text left."""
    first, out = {}, {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at)):
            for size in range(1, min(length, len(at) - k) + 1):
                run = tuple(lines[p] for p in at[k : k + size])
                if size == length or sum(len(words(x)) for x in run) >= enough:
                    if first.setdefault(run, (i, k)) != (i, k):
                        gone.update(range(k, k + size))
        if len(at) < length and first.setdefault(("whole", *(lines[p] for p in at)), i) != i:
            gone.update(range(len(at)))
        drop = {at[k] for k in gone} | {p for k in gone if k + 1 in gone for p in range(at[k], at[k + 1])}
        out[i] = (len(at), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in drop))
    return out


def test_lines_against_plain_search(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] not in (400, 403, 404)]
    rows += [(500, "a b\nc\nd\ne\n\nf\ng\nx", None, None), (501, "q\nc\nd\n\ne\nf\ny\nf\n\ng\nx", None, None), (502, "z\n" * 9, None, None), (503, "a b\nc\nq", None, None)]
    long, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "uv")
    rows += [(510, long, None, None), (511, long, None, None), (512, f"x\n{long}\ny", None, None), (513, f"{other}\nz z\n{long}", None, None), (514, f"q\n{other}\nz z", None, None)]
    rows += [(520, "short", None, None), (521, "short", None, None), (522, "short\nother", None, None), (523, "short\n\nother\n", None, None), (524, f"a b\n{long[:90]}\nw", None, None)]
    rows += [(530, "\n".join(f"l{k}" for k in range(3000)), None, None), (531, "\n".join(f"l{k}" if k % 1000 else "m" for k in range(-5, 3000)), None, None)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in line_dedup(frame(spark, rows)).collect()}
    assert got == lines_kept(rows)
    assert got[511] == (1, 1, "") and got[512][1] == 1 and got[521] == (1, 1, "") and got[522][1] == 0 and got[523][1] == 2


def test_lines_of_odd_rows(spark):
    rows = odd_rows()
    got = line_dedup(frame(spark, rows))
    assert got.count() == len(rows)
    assert got.filter("doc_id = 400").select("n_lines", "n_removed", "kept_text").first() == (0, 0, "")
    text = "a\nb\nc\nd"
    twice = line_dedup(frame(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (1, "x\n" + text, "en", "s")])).orderBy(F.desc("n_lines")).collect()
    assert len({r["n_removed"] for r in twice if r["n_lines"] == 4}) == 1 and sum(r["n_removed"] > 0 for r in twice) in (1, 2)
    assert line_dedup(frame(spark, [])).count() == 0
