from lectern.llm.quotes import link

ROWS = [
    (1, 0, "one\nTwo\n\n three\nfour"),
    (1, 1, "> two\n> three\nI see"),  # two of four lines, a blank one between
    (1, 2, "> one\n> three\nnot neighbours"),
    (1, 3, "> three\n> two\nnot in order"),
    (1, 4, "> four\n> five\nbeyond the end"),
    (1, 5, ">> two\n>> three\n>> four\n> i see\ndeeper"),
    (2, 0, "a\nb\na\nb\nc"),
    (2, 1, "> a\n> b\n> c\nx"),  # the second a begins it
    (2, 2, "a\nb\nc"),
    (2, 3, "> b\n> c\nthe latest"),
    (2, 4, "> a\n> b\n> c\nthe whole before the part"),
    (3, 0, "p\nq\nr"),
    (3, 0, "s\nt\nu"),
    (3, 1, "> q\n> r"),
    (3, 2, "> r\n> s\nof two messages of one turn"),
    (3, 3, "> w\n> x\nsaid later"),
    (3, 4, "v\nw\nx"),
    (4, 1, "> q\n> r\nof another conversation"),
]


def plain(rows):
    """Parents and linked passages by brute force, for passages of several lines without whole or single-line originals."""
    body = lambda x: " ".join(x.lstrip("> ").lower().split())
    own = [(c, t, [body(x) for x in text.split("\n") if not x.startswith(">") and x.strip()]) for c, t, text in rows]
    out = []
    for c, t, text in rows:
        quoted = {}
        for x in text.split("\n"):
            if x.startswith(">"):
                quoted.setdefault(len(x) - len(x.lstrip(">")), []).append(body(x))
        parent, linked = None, 0
        for level, p in quoted.items():
            met = [(o == p, t2) for c2, t2, o in own if c2 == c and t2 < t and any(o[i : i + len(p)] == p for i in range(len(o)))]
            linked += bool(met)
            if met and level == 1:
                parent = max(met)[1]
        out.append((c, t, parent, linked))
    return sorted(out, key=str)


def test_parts_of_longer_messages(spark):
    messages = spark.createDataFrame([(c, t, "u", x) for c, t, x in ROWS], "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(((r.conv_id, r.turn, r.parent_turn, r.n_linked) for r in link(messages).collect()), key=str)
    assert got == plain(ROWS)
    assert {r[:2]: r[2] for r in got if r[2] is not None} == {(1, 1): 0, (1, 5): 1, (2, 1): 0, (2, 3): 2, (2, 4): 2, (3, 1): 0}
