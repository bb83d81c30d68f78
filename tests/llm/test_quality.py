import random
import re
from collections import Counter

from lectern.llm.quality import MEASURES, apply_rules, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    marked = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_measures():
    random.seed(2)
    for t in [None, "", " \n ", "a b c a b c", "a b c d", "a a a a", "é\u00a0b\x1cc\x85d", "x#y\n\nx#y\r\nx#y", "\u2003\n\u2003"] + ["".join(random.choice("ab #|\n\t é") for _ in range(random.randrange(400))) for _ in range(300)]:
        assert measure(t) == plain(t), t


def test_line_frequency(spark):
    random.seed(6)
    prose = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    banner, footer = "Visit our shop 24 hours", prose(30)
    rows = [(i, prose(60) + "\n" + banner.replace("24", str(i)), "a") for i in range(40)]  # banner above the limit
    rows += [(100 + i, prose(60) + "\n" + banner, "b") for i in range(9)]  # below it on another host
    rows += [(200 + i, "\n".join([footer] * 4) + "\n" + prose(20), "a") for i in range(40)]  # mostly a frequent line: depleted
    copy = prose(80)
    rows += [(300 + i, copy, "a") for i in range(50)]  # copies count as one document
    rows += [(400, None, "a"), (401, "", None), (402, prose(70), None), (None, prose(70), "a"), (402, rows[0][1], "a"), rows[0], (500, footer + "\n" + prose(2000), "a")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, n_words int, host string").repartition(4)
    got = apply_rules(docs, share=0.2).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, *(r[m] for m in MEASURES)) for r in got), key=str) == sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id is not None and r.doc_id < 40:
            assert r.kept and r.kept_words == r.n_words - 5
        elif r.doc_id is not None and (100 <= r.doc_id < 110 or 300 <= r.doc_id < 350):
            assert r.kept and r.kept_words == r.n_words
        elif r.doc_id is not None and 200 <= r.doc_id < 240:
            assert not r.kept
    by = {r.doc_id: r for r in got}
    assert by[500].kept and by[500].kept_words == 2000 and by[None].kept and not by[400].kept and not by[401].kept
    assert apply_rules(docs.limit(0)).count() == 0


def test_rules_judge_what_is_left(spark):
    """Symbols, word length and repeated lines reject a document, unless they lie in lines that go."""
    random.seed(8)
    prose = lambda n, k=5: " ".join("".join(random.choice("abcdefgh") for _ in range(k)) for _ in range(n))
    menu = "home | shop | news | help | cart"
    rows = [(i, prose(60) + "\n" + menu, "a", True) for i in range(30)]  # the menu is frequent there and goes
    rows += [
        (100, "\n".join([prose(8), menu] * 2 + [prose(36)]), "b", False),  # too few documents hold it
        (101, "### ".join(prose(80).split()), "b", False),
        (102, prose(60, 2), "b", False),
        (103, prose(60, 11), "b", False),
        (104, prose(60, 3), "b", True),
        (105, prose(60, 10), "b", True),
        (106, "\n".join([prose(60), "x", "x", "x"]), "b", False),  # 2 of 4 lines
        (107, "\n".join([prose(60), "x", "x", "  x"]), "b", True),  # 1 of 4
        (108, prose(60) + " |" * 6, "b", True),  # 6 symbols, 66 words
        (109, prose(60) + " |" * 7, "b", False),  # 7 symbols, 67 words
        (110, None, "b", False),
    ]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string").repartition(3)
    assert {r.doc_id: r.kept for r in apply_rules(docs).collect()} == {i: kept for i, _, _, kept in rows}
