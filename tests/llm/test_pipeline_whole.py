import random
import re
from collections import Counter

import test_minhash
from test_pipeline import COLUMNS, corpus

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)


def test_near_copies_link_from_80_percent(spark):
    """Another word among n words changes 5 of n - 4 shingles: 45 of 55 are alike with n = 54, 40 of 50 with 49, 39 of 49 with 48."""
    rows = []
    for i, n in ((0, 54), (10, 49), (20, 48)):
        base = [f"w{i}x{k}" for k in range(n)]
        rows += [(i, " ".join(base)), (i + 1, " ".join([*base[:20], "other", *base[21:]]))]
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect())
    want = {percent: [d for d, _, _, kept in test_minhash.brute(rows, percent) if kept] for percent in (80, 85)}
    assert got == want[80] == [0, 10, 20, 21] and want[85] == [0, 1, 10, 11, 20, 21]


def plain_cut(texts):
    """The texts without repeated strings of 400 bytes, and of 51 words with the blanks behind them, by brute force."""
    data = [t.encode() for t in texts]
    places = [[*(m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)), len(d)] for d in data]
    words = [d.split() for d in data]
    by_bytes = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    by_words = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    out = []
    for d, at, w in zip(data, places, words, strict=True):
        spans = [(i, i + 400) for i in range(len(d) - 399) if by_bytes[d[i : i + 400]] > 1]
        spans += [(at[i], at[i + 51]) for i in range(len(w) - 50) if by_words[tuple(w[i : i + 51])] > 1]
        gone = bytearray(len(d))
        for a, b in spans:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_passages_of_51_words_go(spark):
    random.seed(4)
    prose = lambda n, k: " ".join("".join(random.choice("abcdefgé") for _ in range(random.randrange(1, k))) for _ in range(n))
    planted, shorter, again = prose(51, 5), prose(50, 5), prose(70, 4)
    unspaced = "".join(random.choice("日本語文字列") for _ in range(150))
    rows = [(i, f"{prose(20, 9)} {planted} {prose(9, 9)}") for i in range(3)]
    rows += [(10 + i, f"{prose(20, 9)} {shorter} {prose(9, 9)}") for i in range(3)]
    rows += [(20 + i, f"{prose(5, 9)}\n{' '.join(again.split()[i:])}\t{prose(5, 9)}") for i in range(25)]
    rows += [(50, f"{prose(5, 9)} {planted.replace(' ', '  ')}"), (51, "x " * 200), (52, planted), (60, "a " + unspaced), (61, "b " + unspaced), (62, "")]
    assert len(planted.encode()) < 400 and len(unspaced.encode()) > 400
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, documents(spark, rows).repartition(3), "").collect()}
    want = {d: t for (d, _), t in zip(rows, plain_cut([t for _, t in rows]), strict=True) if t.split()}
    assert got == want
    assert all(planted not in t for t in got.values()) and all(shorter in got[d] for d in (10, 11, 12))


def test_first_three_stages_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    alive = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = {d for d, _, _, k in test_minhash.brute([(r[0], r[1]) for r in alive], 80) if k}
    alive = [r for r in alive if r[0] in kept]
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(alive, plain_cut([r[1] for r in alive]), strict=True) if t.split()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert docs.columns == COLUMNS and sorted(map(tuple, docs.collect())) == sorted(want)
