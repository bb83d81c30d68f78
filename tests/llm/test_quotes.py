import duckdb
import pandas as pd

from lectern.llm.quotes import ORACLE_SQL, link

ROWS = [
    (1, 0, "user", "Hello there\nsecond line"),
    (1, 1, "a", "> Hello there\n> second line\nI reply"),
    (1, 2, "user", ">> hello  there\n>> second line\n> i reply\nok\n> nothing known"),
    (1, 3, "a", "> second line\nx\n>ok"),
    (2, 0, "u", None),
    (2, 1, "u", ""),
    (2, 2, "u", ">\n> \n"),
    (None, None, "u", "> a"),
    (None, 3, "u", "a"),
    (3, None, "u", "a"),
    (3, 5, "u", "> a"),
    (1, 4, "user", "> >nope\n\n>OK"),
    (1, 4, "user", "> >nope\n\n>OK"),
    (4, 0, "u", "same"),
    (4, 1, "u", "same"),
    (4, 2, "u", "> same"),
    (4, 3, "u", "> later"),
    (4, 4, "u", "later"),
    (5, 0, "u", "word " * 20_000),
    (5, 1, "u", "> " + "word " * 20_000),
]


def test_links(spark):
    messages = spark.createDataFrame([(*r, 9, "x") for r in ROWS], "conv_id long, turn long, role string, text string, depth int, h string").repartition(3)
    got = sorted(map(tuple, link(messages).collect()), key=str)
    want = {(1, 1): (0, 1), (1, 2): (1, 2), (1, 3): (2, 3), (1, 4): (2, 3), (4, 2): (1, 1), (5, 1): (0, 1)}
    for conv, turn, _, parent, depth, *_ in got:
        assert (parent, depth) == want.get((conv, turn), (None, 0)), (conv, turn)
    frame = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    assert got == sorted(con.sql(ORACLE_SQL).fetchall(), key=str)
    assert link(messages.limit(0)).count() == 0
