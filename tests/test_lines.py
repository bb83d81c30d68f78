import pytest
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.functions.text import strip

NOISE = [
    ("page 3", 1, 1), ("Page 3 of 9", 1, 1), ("page three", 0, 0), ("42", 1, 1), ("42a", 0, 0), ("© 2020 x", 1, 1), ("(c) x", 1, 0), ("Copyright 2020", 1, 0),
    ("copyrighted", 0, 0), ("Collections", 0, 0), ("References", 1, 1), ("references to x", 0, 0), ("http://a.b", 1, 1), ("see http://a.b", 0, 0), ("[3] Knuth", 1, 1),
    ("![](_page_1_Picture_8.jpeg)", 1, 0), ("quiz: x", 1, 1), ("◮ Quiz: x", 0, 0), ("{2}", 1, 0), ("{2} x", 0, 0), ("input", 1, 0), ("Output replaced by y", 1, 0), ("inputs", 0, 0), ("", 0, 0),
]
CODE = [
    ("```java", 1, 1), ("for (int i = 0; i < n; i++) {", 1, 1), ("getKey is used", 1, 1), ("the getKey method is used here, often, indeed", 0, 1), ("initial_capacity", 1, 1),
    ("a == b", 1, 1), ("x->y", 0, 0), ("x = 1;", 1, 1), ("// note", 1, 1), ("--", 1, 1), ("# x", 1, 1), ("#x", 0, 0), ("* x", 1, 1), ("HashMap (a data structure)", 0, 0),
    ("call add(x)", 1, 1), ("1. Default constructor HashMap() creates an instance of it for the user", 0, 1), ("constructor foo (a)", 1, 1), ("__init__ (self)", 1, 1),
    ("scores.length", 1, 0), ("see scores.length of this", 0, 0), ("plain words", 0, 0), ("", 0, 0), ("élan vital", 0, 0),
]
OCR = [("abc", 1), ("abcd", 0), ("ab12x", 1), ("ab cd ef", 0), ("éééé ab", 1), ("12 34 56 a", 1), ("Größe", 1), ("good words here", 0)]
INLINE = [
    ("**bold** and __bold__", "bold and bold"), ("*i* _i_ `c`", "i i c"), ("~~gone~~ [t](u)", "gone t"), ("**_x_**", "x"), ("a_b_c", "abc"), ("  x ", "x"), ("**_**", "_"), ("plain", "plain"),
    ("[**a** b](http://x)", "a b"),
]


@pytest.mark.parametrize("profile,at", [("notebook", 1), ("backend", 2)])
def test_noise_and_code(spark, profile, at):
    for table, rule in ((NOISE, L.noise), (CODE, L.code)):
        df = spark.createDataFrame([(r[0], bool(r[at])) for r in table], "s string, want boolean").withColumn("got", rule(strip(F.col("s")), profile))
        assert [r.s for r in df.collect() if r.got != r.want] == []


def test_ocr_noise_and_inline(spark):
    df = spark.createDataFrame([(s, bool(w)) for s, w in OCR], "s string, want boolean").withColumn("got", L.ocr_noise(F.col("s")))
    assert [r.s for r in df.collect() if r.got != r.want] == []
    df = spark.createDataFrame(INLINE, "s string, want string").withColumn("once", L.strip_inline(F.col("s"))).withColumn("twice", L.strip_inline(F.col("once")))
    assert [(r.s, r.once) for r in df.collect() if not (r.once == r.want == r.twice)] == []


def test_rows_and_labels(spark):
    rows = [("|---|:--|", 1, 1), ("| Operation | Description |", 0, 1), ("| add(x) | appends |", 0, 0), ("| Row 1 | x |", 0, 0), ("| one two three four | x |", 0, 0), ("| |", 1, 0)]
    df = spark.createDataFrame([(a, bool(b), bool(c)) for a, b, c in rows], "s string, sep boolean, head boolean")
    df = df.withColumn("s2", L.separator_row(L.cells(F.col("s")))).withColumn("h2", L.header_row(L.cells(F.col("s"))))
    assert [r.s for r in df.collect() if r.sep != r.s2 or r.head != r.h2] == []
    labels = [("• construction", 1), ("- storing a value", 1), ("- f(x)", 0), ("•", 0), ("plain", 0), ("+ x", 1)]
    df = spark.createDataFrame([(s, bool(w)) for s, w in labels], "s string, w boolean").withColumn("g", L.prose_label(F.col("s")))
    assert [r.s for r in df.collect() if r.w != r.g] == []
