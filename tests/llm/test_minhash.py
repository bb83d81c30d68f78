import random
from itertools import combinations

from lectern.llm.minhash import near_duplicates


def brute(rows, percent=85):
    sets = {}
    n_of = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        s = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.setdefault(doc, []).append(s)
        n_of.append((doc, len(s)))
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((d, n, find(d), find(d) == d) for d, n in n_of)


def corpus():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 7)))
    rows = []
    for f in range(12):  # families whose members are more or less alike, chains among them
        base = [word() for _ in range(random.choice([6, 40, 150, 300]))]
        for i in range(12):
            words = base[:]
            for _ in range(random.randrange(0, 1 + len(base) // 40)):
                words[random.randrange(len(words))] = word()
            if i % 4 == 3:
                base = words
            rows.append((1000 * (12 - f) + i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE  two"), (6, "one two"), (7, "É é"), (8, "é é"), (9, "w " * 900), (10, "w " * 400)]
    rows += [(4000 + i, rows[30][1].upper()) for i in range(20)]
    rows.append(rows[-1])
    return rows


def test_components_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, n long, h1 string").repartition(4)
    got = sorted(map(tuple, near_duplicates(docs).collect()))
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c, _ in want}) < len(want) - 30


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
