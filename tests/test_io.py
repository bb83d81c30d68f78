import json

from pyspark.sql import functions as F

from lectern.operators import buckets as B
from lectern.settings import Settings
from lectern.sources import readers, writers
from lectern.streaming.pages import drop_near_duplicates_stream


def test_json_readers(spark, tmp_path):
    p = tmp_path / "deck one.json"
    p.write_text(json.dumps([{"slide_id": "slide_001", "page_number": 1, "raw_markdown": "# A\nb", "doc_id": "old", "more": 1}]))
    assert [tuple(r) for r in readers.parsed_json(spark, str(p), "new").collect()] == [("slide_001", 1, "# A\nb", "new")]
    q = tmp_path / "pre.json"
    q.write_text(json.dumps([{"slide_id": "slide_001", "page_number": 1, "doc_id": "old", "headings": ["A"], "body_text": ["{1}", "a", "b"], "bullets": ["◮ x"], "discarded": ["z"], "ocr_applied": True}]))
    r = readers.preprocessed_json(spark, str(q)).first()
    assert r.doc_id == "pre" and r.body_text == ["b"] and r.bullets == ["x"] and r.table_cells == [] and r.clean_text == "A b x"


def test_binary_reader_and_cache(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("one\n\n\n\ntwo\f\fthree")
    (tmp_path / "b.pdf").write_text("one\n\n\n\ntwo\f\fthree")
    got = readers.read_pdf(spark, str(tmp_path))
    want = [("slide_001", 1, "one\n\ntwo", "a"), ("slide_003", 3, "three", "a"), ("slide_001", 1, "one\n\ntwo", "b"), ("slide_003", 3, "three", "b")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    sha = spark.read.format("binaryFile").load(str(tmp_path)).select(F.sha2("content", 256)).first()[0]
    cache = spark.createDataFrame([(sha, 1, "cached")], "sha string, page_number int, raw_markdown string")
    assert sorted(map(tuple, readers.read_pdf(spark, str(tmp_path), cache=cache).collect())) == [("slide_001", 1, "cached", "a"), ("slide_001", 1, "cached", "b")]


def test_html(spark):
    html = '<html><style>p{x}</style><h1 class="a">T</h1><ul><li>x &amp; y</li></ul><p>para<br>two</p><script>var t="</p>";</script><footer>&copy; me</footer></html>'
    assert spark.range(1).select(readers.html_markdown(F.lit(html))).first()[0] == "# T\n- x & y\npara\ntwo\n> © me"


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("slide_001", 1, "# A\n- b c", "d"), ("slide_002", 2, "text", "d")], "slide_id string, page_number int, raw_markdown string, doc_id string")
    content = B.bucketize(s)
    writers.write_step(content, str(tmp_path / "s2"))
    assert spark.read.json(str(tmp_path / "s2")).count() == 2
    writers.write_markdown(s, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 3
    r = writers.step2_report(content).where("page_number = 1").first()
    assert (r.stats.n_headings, r.stats.n_bullets, r.stats.clean_text_len) == (1, 1, 5)
    phrases = spark.createDataFrame([("d", "slide_001", 1, 2, "q", 0.5, "body", "x"), ("d", "slide_001", 1, 1, "p", 0.9, "body", "x")], "doc_id string, slide_id string, page_number int, rank int, phrase string, score double, source_type string, appears_in string")
    assert [k["phrase"] for k in json.loads(writers.keyphrase_json(phrases).first().json)["slide_001"]] == ["p", "q"]


def test_settings(spark):
    spark.conf.set("lectern.keyphrase_max", "7")
    try:
        assert Settings.of("backend", spark).keyphrase_max == 7 and Settings.of("backend").evidence_cosine == 0.75
    finally:
        spark.conf.unset("lectern.keyphrase_max")


def test_stream(spark, tmp_path):
    a = "one two three four five six"
    rows = [("d", 1, a), ("d", 2, a + " seven"), ("d", 3, "other words that differ much here"), ("e", 1, a)]
    spark.createDataFrame(rows, "doc_id string, page_number int, raw_markdown string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, page_number int, raw_markdown string").parquet(str(tmp_path / "in"))
    q = drop_near_duplicates_stream(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.page_number) for r in spark.table("accepted").collect()) == [("d", 1), ("d", 3), ("e", 1)]
