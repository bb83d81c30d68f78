import math
import random
from collections import Counter

from lectern.llm.urls import judge

LABELS = "doc_id long, quality int, toxic int"


def test_rules_hosts_and_paths(spark):
    urls = [
        ("http://A.b.NET/x?y", "a.b.net", "/x", "net/", "block"),
        ("https://example.net/en/1#t", "example.net", "/en/1", "example.net/en/", "allow"),
        ("x://www.example.net/en", "www.example.net", "/en", "net/", "block"),
        ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://org/fr/a", "org", "/fr/a", "org/fr/", "allow"),
        ("http://b.net", "b.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://ÄB.x/p://q/r", "Äb.x", "/p://q/r", None, "allow"),
        ("a://b?c://d/e", "b", "", None, "allow"),
        ("http://internet/x", "internet", "/x", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)] + [(0, urls[0][0], "h")], "page_id long, url string, host string")
    got = judge(pages, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(urls) + 1
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id)[:] == sorted((i, *u[1:]) for i, u in enumerate(urls) if i)
    assert judge(pages.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_templates_merge_and_rejection(spark):
    rows, labels = [], []
    for i in range(300):
        rows.append((i, f"http://h.x/bad/{i}.html"))
        labels.append((i, 0 if i % 10 else 1, None))
    for i in range(300, 900):
        kind = ("news", "blog")[i % 2]
        rows.append((i, f"http://h.x/{kind}/{i}/deep/er/still"))
        labels.append((i, 0 if i % 100 == 0 else 1, 0))
    rows += [(5000 + i, f"http://h.x/bad/new-{i}") for i in range(20)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS)).collect()}
    assert {got[i].template for i in range(300)} == {"/bad/*"} and {got[i].template for i in range(300, 900)} == {"/news/*/deep/er/still", "/blog/*/deep/er/still"}
    assert {got[i].verdict for i in [*range(300), 5003]} == {"block"}  # unlabelled pages of the template too
    assert {got[i].verdict for i in range(300, 900)} == {"allow"}
    assert abs(got[400].purity - got[401].purity) < 0.1


def plain(rows, marks, least=20, share=0.02, z=2.58, least_seen=10, prior=20.0):
    """page_id to (template, purity), by recursion over one host's pages at a time."""
    from urllib.parse import urlsplit

    seen = [m for i, _ in rows for m in ([marks[i]] if i in marks else [])]
    base, out = sum(seen) / max(len(seen), 1), {}
    hosts = {}
    for i, u in rows:
        hosts.setdefault(urlsplit(u).netloc, []).append((i, [x for x in urlsplit(u).path.split("/") if x]))

    def grow(pages, path):
        """The leaves below a node, as a tree: (name, pages, children)."""
        here = [(i, s) for i, s in pages if len(s) == len(path)]
        below = [(i, s) for i, s in pages if len(s) > len(path)]
        kids = [("?", here, None)] if here else []
        if len(below) < least:
            return kids + ([("#", below, None)] if below else [])
        count = Counter(s[len(path)] for _, s in below)
        name = lambda s: s if count[s] >= least and count[s] >= share * len(below) else "*"
        groups = {}
        for i, s in below:
            groups.setdefault(name(s[len(path)]), []).append((i, s))
        return kids + [(k, v, grow(v, [*path, k])) for k, v in groups.items()]

    def settle(kids, root):
        """Clusters of a node's branches, or the node as one branch: a list of page lists, or None where all are alike."""
        flat = []
        for k, pages, below in kids:
            if below is not None:
                parts = settle(below, False)
                if parts is not None:
                    final.extend(parts)
                    continue
            flat.append((k, pages))
        marked = lambda pages: [marks[i] for i, _ in pages if i in marks]
        rich = sorted(((sum(m) / len(m), k, len(m), p) for k, p in flat if len(m := marked(p)) >= least_seen), key=lambda r: r[:2])
        poor = [x for k, p in flat if len(marked(p)) < least_seen for x in p]
        clusters = []
        for n, (r, k, m, p) in enumerate(rich):
            if n:
                r0, _, m0, _ = rich[n - 1]
                pool = (r * m + r0 * m0) / (m + m0)
            if n and r - r0 <= z * math.sqrt(pool * (1 - pool) * (1 / m + 1 / m0)) + 1e-12:
                clusters[-1] += p
            else:
                clusters.append(list(p))
        if len(clusters) <= 1 and not root:
            return None
        return clusters + ([poor] if poor else [])

    def templates(kids, path):
        for k, pages, below in kids:
            if below is None:
                for i, _ in pages:
                    out[i] = ["".join(f"/{x}" for x in path) + "/**" * (k == "#"), None]
            else:
                templates(below, [*path, k])

    for pages in hosts.values():
        tree, final = grow(pages, []), []
        final.extend(settle(tree, True))
        templates(tree, [])
        for part in final:
            m = [marks[i] for i, _ in part if i in marks]
            for i, _ in part:
                out[i][1] = round((sum(m) + prior * base) / (len(m) + prior), 9)
    return {k: tuple(v) for k, v in out.items()}


def test_tree_by_plain_recursion(spark):
    rng = random.Random(6)
    rows, marks = [], {}
    for i in range(1500):
        host = rng.choice(["a.x", "a.x", "b.x"])
        segs = [rng.choice(["good", "bad", "odd", f"u{i}"])] + [rng.choice(["k", "l", f"v{rng.randrange(99)}"]) for _ in range(rng.randrange(4))]
        segs = segs[: rng.randrange(0, 5)]
        rows.append((i, f"http://{host}/" + "/".join(segs) + "/" * rng.randrange(2)))
        if rng.random() < 0.8:
            marks[i] = int(rng.random() < {"bad": 0.95, "good": 0.05}.get(segs[0] if segs else "", 0.4))
    rows += [(2000, "http://c.x/" + "/".join(["long"] * 3000)), (2001, "http://c.x//"), (2002, "http://c.x")]
    labels = spark.createDataFrame([(i, 1 - m, None, "u", 3) for i, m in marks.items()] + [(99999, 0, 1, "u", 3)], LABELS + ", url string, n int")
    got = judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3), labels).collect()
    want = plain(rows, marks)
    assert {r.page_id: (r.template, round(r.purity, 9)) for r in got} == want
    assert {r.verdict for r in got} == {"allow", "block"} and len({v[1] for v in want.values()}) > 4
