import math
import zlib

import numpy as np

from lectern.llm.langid import LONGEST_PIECE, expected, UNSEEN, default_vocabulary, forward, identify, train, vocabulary


def test_forward_sums_all_segmentations():
    pieces = vocabulary(default_vocabulary())
    rng = np.random.default_rng(2)
    probs = rng.uniform(0.01, 0.3, (len(pieces.pieces) + 1, 3))
    place = {p: i for i, p in enumerate(pieces.pieces)}

    def brute(word):
        total = np.zeros((len(word) + 1, 3))
        total[0] = 1
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 16) + 1):
                if word[i:j] in place:
                    total[j] += total[i] * probs[place[word[i:j]]]
                elif j == i + 1:
                    total[j] += total[i] * probs[-1]
        return np.log(total[-1])

    words = ["▁a", "▁the", "▁trains", "▁ärger", "▁中文字", "▁" + "international" * 3, "▁x"]
    assert np.allclose(forward(words, probs, pieces), [brute(w) for w in words])
    long = forward(["▁" + "ab" * 3000], probs, pieces)
    assert np.isfinite(long).all() and UNSEEN > 0


def sample(lang, i):
    base = {"en": "the house of the people was in that water and they were going there", "fr": "les enfants sont dans la maison avec leur père et une grande fenêtre", "de": "der hund und die katze sind nicht in dem haus aber auf der straße"}[lang].split()
    return " ".join(base[(i * 7 + k * k) % len(base)] for k in range(20))


def test_held_out_accuracy_and_edge_cases(spark):
    langs = ["en", "fr", "de"]
    rows = [(i, sample(langs[i % 3], i), langs[i % 3], "s", 7) for i in range(240)]
    rows += [(1000, None, "en", None, 0), (1001, "", "fr", None, 0), (1002, "12 !! 34", "de", "s", 0), (None, "the water", None, "s", 0), (1003, "THE water " * 3000, None, None, 0), (1003, "THE water " * 3000, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    model = train(docs)
    assert model[0] == ["de", "en", "fr"]
    got = identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in found}
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == by[1003].lang_pred == "en" and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in found)


def test_learns_nothing_from_held_out_or_unlabelled(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "the house", "en") for i in held] + [(1, "the house", None), (None, "the house", "fr")], "doc_id long, text string, lang string")
    model = train(docs)
    assert model[0] == []
    assert {r.lang_pred for r in identify(docs, model).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_long_words_and_expected_counts_by_brute_force():
    """Words of any length are summed whole; the counts of one round are those over all listed segmentations."""
    pieces = vocabulary(default_vocabulary())
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(len(pieces.pieces) + 1) * 0.1, 2).T + 1e-9
    words = ["▁" + "abcdefghij" * 3, "▁" + "zusammen" * 20, "▁" + "été" * 700]
    assert np.allclose(forward(words, probs, pieces, wide=10_000), forward(words, probs, pieces, wide=4))
    place = {p: i for i, p in enumerate(pieces.pieces)}

    def listed(word, done=()):
        if not word:
            yield done
        for j in range(1, min(len(word), LONGEST_PIECE) + 1):
            if word[:j] in place or j == 1:
                yield from listed(word[j:], (*done, place.get(word[:j], len(place))))

    words, weight = ["▁abc", "▁the", "▁中a", "▁x"], np.array([[1, 0], [2, 3], [1, 1], [0, 5]], float)
    want = np.zeros_like(probs)
    for w, many in zip(words, weight, strict=True):
        ways = list(listed(w))
        each = np.array([np.prod(probs[list(v)], axis=0) for v in ways])
        for v, share in zip(ways, each / each.sum(0), strict=True):
            np.add.at(want, list(v), share * many)
    assert np.allclose(expected(words, weight, probs, pieces), want)
    # a word too long for plain doubles: its pieces make up all its letters
    got, sizes = expected(["▁" + "abc" * 400], np.ones((1, 2)), probs, pieces), np.array([*map(len, pieces.pieces), 1])
    assert np.allclose((got * sizes[:, None]).sum(0), 1201)
