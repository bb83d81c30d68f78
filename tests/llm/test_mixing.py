import random
import re

import pytest

from lectern.llm.mixing import apportion, mix, targets


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = sum(sizes.values()) * share, {}
    while True:
        left = [s for s in names if s not in capped]
        rest, total = budget - sum(capped.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return capped | {s: rest * weight[s] / total for s in left}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    random.seed(seed)
    sizes = {f"s{i:02}": random.choice([0, 5, 100, 10_000]) for i in range(9)} | {None: 50, "é": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_apportionment_by_highest_quotients(spark):
    random.seed(3)
    rows = []
    for g in range(40):
        total = random.choice([0, 1, 7, 100, 1000])
        rows += [(g, u, float(random.choice([0, 1, 3, 50, random.random() * 100])), total) for u in range(random.randrange(1, 12))]
    got = {(r.g, r.u): r.seats for r in apportion(spark.createDataFrame(rows, "g int, u int, share double, total long"), ["g"], "u", "share", "seats", "total").collect()}
    for g in range(40):
        mine = [r for r in rows if r[0] == g]
        seats = {r[1]: 0 for r in mine}
        for _ in range(mine[0][3] if any(r[2] for r in mine) else 0):
            best = max((r for r in mine if r[2]), key=lambda r: (r[2] / (2 * seats[r[1]] + 1), -r[1]))
            seats[best[1]] += 1
        assert {u: got[g, u] for u in seats} == seats


def test_mix(spark):
    random.seed(4)
    rows = [(i, " ".join("w" * random.randrange(1, 5) for _ in range(random.randrange(0, 400))), random.choice(["a", "a", "a", "b", "c", "dé", None])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", None), (702, "x\u00a0y\x0bz\x1cq", "b"), (None, "one two", "b"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, text string, source string, size int, target string").repartition(6)
    got = mix(docs, shard_words=2000).select("doc_id", "source", "size", "source_size", "target", "taken", "text").collect()
    assert len(got) == len(rows)
    assert all(r.size == words_of(r.text) and 0 <= r.taken <= 2 * r.size for r in got)
    sizes = {s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}}
    want = plain_targets(sizes)
    for s in sizes:
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 0.02 * want[s] + 32
    again = mix(docs.repartition(3), shard_words=2000).select("doc_id", "text", "taken").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.taken) for r in got))) == sorted(map(str, map(tuple, again)))
    assert mix(docs.limit(0)).count() == 0
