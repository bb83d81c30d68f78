import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm.grouping import suffix_array
from lectern.llm.suffixes import deduplicate, find_ranges, find_runs, stretched_ranges, stretched_runs


def test_suffix_array_by_brute_force():
    random.seed(3)
    for _ in range(800):
        n, k = random.randrange(0, 40), random.choice([1, 2, 3, 26])
        s = [random.randrange(k) for _ in range(n)]
        if random.random() < 0.3:
            s = (s[: max(1, n // 4)] * 8)[:n]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, window=400):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghé") for _ in range(random.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, shared = prose(150), prose(90)
    rows = [(i, prose(random.randrange(1, 300))) for i in range(25)]
    rows += [(100 + i, prose(40) + passage[i % 3 : len(passage) - i % 5] + prose(30)) for i in range(30)]
    base = prose(260)
    for i in range(40):  # near copies
        words = base.split()
        for _ in range(i % 7):
            words[random.randrange(len(words))] = word()
        rows.append((200 + i, " ".join(words)))
    rows += [(300, shared + " " + shared), (301, "x" * 1500), (302, "ab" * 700), (303, shared[:399]), (304, shared[:400]), (305, None), (306, ""), (307, "short"), (308, "short")]
    rows += [(309, "y" * 400), (310, "y" * 400), (311, "z" * 401), (312, prose(60) + "z" * 405), (313, rows[3][1]), (3, rows[3][1]), (None, passage), (314, "é" * 300 + prose(80))]
    return rows


@pytest.mark.parametrize("hot", [4096, 1])
def test_removal_by_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id long, text string, kh string, n_bytes int").repartition(5)
    got = deduplicate(docs.drop("kh"), hot=hot)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert deduplicate(docs).columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert deduplicate(docs).count() == 0


def test_stretches_give_the_same_runs_and_ranges():
    rng = np.random.default_rng(5)
    for alphabet, n in ((2, 9000), (200, 9000), (1, 3000)):
        raw = rng.integers(0, alphabet, n).astype(np.uint8)
        raw[4000:4600] = raw[1000:1600] if n > 4600 else raw[:1][0]
        want = find_runs(raw, np.array([0, n]))
        got = stretched_runs(raw, np.array([0, n]), stretch=700)
        assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
        _, f, _, lo, hi, at = want
        one = find_ranges(raw, f, lo, hi, at)
        parts = list(stretched_ranges(raw, f, lo, hi, at, stretch=700))
        key = lambda k1, k2, core, left, edges: sorted(zip(k1.tolist(), k2.tolist(), core.tolist(), left.tolist(), edges, strict=True))
        assert sorted(x for p in parts for x in key(*p)) == key(*one)


def test_clashing_columns_and_a_very_long_text(spark):
    random.seed(2)
    long = "".join(random.choice("abcdefghij ") for _ in range(1_300_000))
    rows = [(1, long + "Q" + long[600_000:600_500]), (2, "short " + long[1_200_000:1_200_450]), (3, None)]
    docs = spark.createDataFrame([(d, t, 7, 8, 9) for d, t in rows], "doc_id long, text string, kd int, kh int, intervals int")
    got = {r.doc_id: r for r in deduplicate(docs).collect()}
    assert [(r.kd, r.kh, r.intervals) for r in got.values()] == [(7, 8, 9)] * 3
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[2].n_spans) == (500 + 450 + 500, 3, 450, 1)
    assert got[1].kept_text == (long[:600_000] + long[600_500:1_200_000] + long[1_200_450:] + "Q") and got[2].kept_text == "short " and got[3].kept_text is None
