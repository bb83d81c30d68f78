import json

from pyspark.sql import functions as F

from lectern.operators import buckets as B
from lectern.operators import pages as PG
from lectern.settings import Settings

MD = """# Title **x**
> OCR: Java Collection framework
> a caption
- first bullet
* second_bullet here
◮ beamer one
+ plus is body
| Operation | Description |
|---|---|
| add(x) | appends 1 |
{2}
plain body text
```
• construction
int x = 1;
```
> OCR: #the head
> OCR: - item of list
> OCR: zz
---
"""


def slides(spark, *texts):
    return spark.createDataFrame([(f"slide_{i:03d}", i, t, "d") for i, t in enumerate(texts, 1)], "slide_id string, page_number int, raw_markdown string, doc_id string")


def test_routing_notebook(spark):
    s = slides(spark, MD, "", "```\nopen fence\n- x;")
    r = {x.page_number: x for x in B.assemble(B.collect(B.route_notebook(B.lines_of(s)), s)).collect()}
    one = r[1]
    assert one.headings == ["Title x", "the head"] and one.heading_phrases == one.headings
    assert one.captions == ["a caption"] and one.ocr_applied
    assert one.bullets == ["first bullet", "beamer one", "construction", "item of list"]
    assert one.table_cells == ["add(x)", "appends 1"]
    assert one.body_text == ["Java Collection framework", "+ plus is body", "plain body text"]
    assert one.code_lines == ["second_bullet here", "int x = 1;", "---"]
    assert r[2].clean_text == "" and r[2].headings == [] and not r[2].ocr_applied
    assert r[3].code_lines == ["open fence", "- x;"]


def test_routing_backend(spark):
    s = slides(spark, MD)
    one = B.assemble(B.collect(B.route_backend(B.lines_of(s)), s, "backend"), "backend").first()
    assert one.headings == ["Title x"] and "OCR: Java Collection framework" in one.captions
    assert one.bullets == ["first bullet", "second_bullet here"] and one.table_cells == ["Operation", "Description", "add(x)", "appends 1"]
    assert "{2}" in one.code_lines and "◮ beamer one" in one.body_text and "---" in one.body_text


def test_every_line_goes_somewhere(spark):
    s = slides(spark, MD)
    n = B.lines_of(s).count()
    assert B.route_notebook(B.lines_of(s)).count() == B.route_backend(B.lines_of(s)).count() == n


def test_repetition(spark):
    texts = [f"# Same\nfooter line\nown {i} text" + ("\nthrice" if i < 3 else "") + ("\nhalf" if i % 2 else "") for i in range(6)]
    s = slides(spark, *texts)
    got = B.bucketize(s).orderBy("page_number").collect()
    assert all(r.headings == [] and r.heading_phrases == ["Same"] for r in got)
    assert [r.body_text for r in got][:2] == [["own 0 text", "thrice"], ["own 1 text", "thrice", "half"]]  # half is 3 of 6: kept
    few = B.bucketize(slides(spark, *texts[:3])).collect()
    assert all(r.headings == ["Same"] for r in few)  # under five slides nothing goes
    old = B.bucketize(slides(spark, *texts[:3]), Settings.of("backend")).collect()
    assert all(r.headings == r.heading_phrases == [] for r in old)


def test_near_duplicates_are_greedy(spark):
    a = "one two three four five six"
    b = "one two three four seven eight"  # like a
    c = "one two seven eight nine ten"  # like b only
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate([a, b, c, "x y", a.upper(), "", a], 1)], "doc_id string, page_number int, raw_markdown string")
    got = sorted(r.page_number for r in PG.drop_near_duplicates(pages, Settings(near_dup_jaccard=0.5)).collect())
    assert got == [1, 3, 4, 5, 6]  # page 1 is out of 5's window of two kept pages; 7 meets 5


def test_page_rules(spark):
    df = spark.createDataFrame([("![x](y) {3} # -", True), ("short", True), ("long enough text", False), ("", True), ("{3}\n\n{4}", True)], "t string, want boolean").withColumn("got", PG.is_empty(F.col("t")))
    assert [r.t for r in df.collect() if r.got != r.want] == []
    conv = spark.createDataFrame([("d", "a" + PG.SEPARATOR + " b ", 3)], "doc_id string, markdown string, n_pages int")
    assert [(r.page_number, r.raw_markdown) for r in PG.split_pages(conv).collect()] == [(1, "a"), (2, "b"), (3, "")]
    assert spark.range(1).select(PG.ocr_prefixed(F.lit("a\n\n b "))).first()[0] == "> OCR: a\n> OCR: b"


def test_loader_repairs(spark):
    row = dict(slide_id="s", page_number=1, doc_id="x", headings=["LinkedList Class", "LinkedList"], body_text=["{1}", "linkedlist class", "LinkedList Class LinkedList class is a list", "x = 1;", "LinkedList\tb"], bullets=["◮ Quiz", " - ", "a"], table_cells=None, captions=[], heading_phrases=["h"])
    df = spark.read.schema("slide_id string, page_number int, doc_id string, headings array<string>, body_text array<string>, bullets array<string>, table_cells array<string>, captions array<string>, code_lines array<string>, heading_phrases array<string>").json(spark.sparkContext.parallelize([json.dumps(row)]))
    got = B.repair(df, "mine").first()
    assert got.body_text == ["LinkedList class is a list", "b"] and got.code_lines == ["x = 1;"] and got.bullets == ["Quiz", "a"]
    assert got.doc_id == "mine" and got.clean_text == "LinkedList Class LinkedList LinkedList class is a list b Quiz a" and got.table_cells == []
