import json

from pyspark.sql import functions as F

from lectern.functions import phrases as P
from lectern.operators import keyphrases as K
from lectern.operators import triples as TR
from lectern.settings import Settings
from lectern.sources import backends

KEYS = "doc_id string, slide_id string, page_number int"


def check(spark, rule, rows):
    df = spark.createDataFrame([(s, w) for s, w in rows], ["s", "want"]).withColumn("got", rule(F.col("s")))
    assert [(r.s, r.got) for r in df.collect() if r.got != r.want] == []


def test_phrase_rules(spark):
    check(spark, P.valid, [("hash map", True), ("ab", False), ("values", False), ("used to", False), ("to sort the list", False), ("to sort", True), ("this list", False), ("12, 3.4", False), ("their", False)])
    check(spark, P.structural_label, [("how to add values", True), ("how to add", False), ("storing a value", True), ("string list", False), ("array", False)])
    check(spark, P.clean, [("hashmap implementation 1/2 jvm", "hashmap implementation  jvm"), ("Summary hash-based collections", "hash-based collections"), ("```import x", ""), ("x {5}.", "x"), (" .,list;:-/\\", "list")])
    got = spark.range(1).select(P.anchors(F.lit("add(value)")).alias("a"), P.anchors(F.lit("clear()")).alias("b"), P.anchors(F.lit("x(y)")).alias("c")).first()
    assert set(got.a) == {"add(value)", "add"} and set(got.b) == {"clear()", "clear"} and set(got.c) == {"x(y)"}
    pairs = [("fifo", "first in, first out", True), ("array", "arraylist", False), ("ordered list", "ordered list of values", True), ("list", "ordered list", False), ("a b c d e f", "a b c d e f g", False), ("x", "x", True), ("api", "application programming interface", True)]
    df = spark.createDataFrame(pairs, ["a", "b", "want"])
    df = df.withColumn("got", P.synonyms(F.col("a"), F.col("b"))).withColumn("back", P.synonyms(F.col("b"), F.col("a")))
    assert [r for r in df.collect() if not r.got == r.back == r.want] == []


def slide(spark, **buckets):
    names = ["headings", "body_text", "bullets", "table_cells", "captions"]
    row = ("d", "s", buckets.get("page", 2), *[buckets.get(n, []) for n in names], buckets.get("clean_text", " ".join(x for n in names for x in buckets.get(n, []))))
    return spark.createDataFrame([row], KEYS + ", " + ", ".join(f"{n} array<string>" for n in names) + ", clean_text string")


def test_gate_and_text(spark):
    gate = lambda **b: slide(spark, **b).select(K.pedagogical()).first()[0]
    many = ["word " * 50]
    assert gate(body_text=many) and not gate(body_text=["few words"]) and not gate(body_text=["word " * 20], page=1)
    assert not gate(headings=["  Outline "], body_text=many) and not gate(bullets=["a b", "c d e", "f", "g h i"])
    assert gate(bullets=["one two three four five six seven"] * 3)
    text = lambda **b: slide(spark, **b).select(K.extraction_text()).first()[0]
    assert text(headings=["H"], body_text=["b <i>c</i>"], bullets=["d"]) == "H. b c d"
    assert text(table_cells=["add", "adds<br>one", "{3}", "noise", "odd"]) == "add: adds one. odd"
    assert text(table_cells=["one"]) == "one" and text(headings=["H"]) == "H" and text() == ""
    assert slide(spark, headings=["H"], body_text=["x = 1;", "prose"], table_cells=["t"]).select(K.extraction_text("backend")).first()[0] == "H. prose t"


def test_recognizer_scores_and_dedup(spark):
    s = slide(spark, headings=["Hash map"], body_text=["A hash map stores keys. Hash maps grow."], clean_text="Hash map A hash map stores keys. Hash maps grow.")
    lex = spark.createDataFrame([("hash map", "T", 0.9), ("keys", "T", 0.5), ("grow", "U", 0.2), ("stores keys", "U", 0.5)], "phrase string, label string, score double")
    got = {r.phrase: r for r in K.recognize(s.withColumn("text", K.extraction_text()), lex).groupBy("phrase").count().collect()}
    assert {p: r["count"] for p, r in got.items()} == {"hash map": 2, "keys": 1, "stores keys": 1}
    best = K.best_scores(K.recognize(s.withColumn("text", K.extraction_text()), lex)).join(s, ["doc_id", "slide_id", "page_number"])
    rows = {r.phrase: r for r in best.select("phrase", K.boosted(F.col("score"), K.source_type(F.col("phrase"))).alias("score"), K.source_type(F.col("phrase")).alias("t"), K.sentence_of(F.col("phrase"), F.col("clean_text")).alias("x")).collect()}
    assert rows["hash map"].t == "heading" and rows["hash map"].score == 1.0 and rows["keys"].t == "body" and rows["keys"].x == "Hash map A hash map stores keys."
    phrases = spark.createDataFrame([("d", "s", 1, p, sc, i) for i, (p, sc) in enumerate([("a", 0.9), ("b", 0.8), ("c", 0.7), ("n", 0.1)])], KEYS + ", phrase string, score double, ord int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.43]), ("c", [0.62, 0.78])], "phrase string, v array<double>")
    kept = sorted(r.phrase for r in K.dedup_phrases(phrases, vectors, Settings(phrase_dedup_cosine=0.85)).collect())
    assert kept == ["a", "c", "n"]  # a like b, b like c, a unlike c
    assert [r.phrase for r in K.limit(phrases, Settings(keyphrase_max=2)).orderBy("rank").collect()] == ["a", "b"]
    assert {r.phrase for r in K.top_candidates(phrases).collect()} == {"a", "b", "c"}
    offered = spark.createDataFrame([("d", "s", 1, "Fresh one", 0)], KEYS + ", phrase string, ord int")
    text = spark.createDataFrame([("d", "s", 1, "w " * 30)], KEYS + ", text string")
    assert [(r.phrase, r.score) for r in K.with_fallback(phrases.limit(0), text, offered).collect()] == [("fresh one", 0.4)]
    assert K.with_fallback(phrases, text, offered).count() == 4
    assert K.with_fallback(phrases.where("phrase = 'a'"), text, offered.limit(0)).count() == 0  # replaced by none


def test_triples(spark):
    replies = [
        [{"subject": " Add ", "relation": "isPartOf", "object": "list", "evidence": "e", "confidence": "0.9"}, {"subject": "list", "relation": "isPartOf", "object": "add", "evidence": "e", "confidence": None}, "junk", {"subject": None, "object": "list", "relation": "x", "confidence": "abc"}],
        {"note": "x", "triples": [{"subject": "a list", "relation": "knows", "object": "add", "evidence": "e", "confidence": 0.8}]},
    ]
    texts = [json.dumps(replies[0]).replace(', "junk"', ""), json.dumps(replies[1]), "oops", None, "[]", "{}"]
    responses = spark.createDataFrame([("d", f"s{i}", i, t) for i, t in enumerate(texts)], KEYS + ", response string")
    raw = TR.parsed(responses)
    n = {(r.slide_id, r.ord): r for r in TR.normalized(raw).collect()}
    assert len(n) == 4 and n["s0", 0].subject == "add" and n["s0", 0].confidence == 0.9 and n["s0", 1].confidence == 0.0
    assert n["s0", 2].subject == "none" and n["s0", 2].confidence == 0.0 and n["s1", 0].subject == "a list"
    phrases = spark.createDataFrame([("d", s, i, p, 0.4, r) for i, s in enumerate(["s0", "s1"]) for r, p in enumerate(["add(value)", "list", "a list"], 1)], KEYS + ", phrase string, score double, rank int")
    got = TR.validate(raw, phrases).collect()
    assert [(r.subject, r.object, r.confidence) for r in got] == [("add(value)", "list", 0.9)]
    sims = spark.createDataFrame([("d", "s0", 0, "e", 0.55)], KEYS + ", evidence string, similarity double")
    assert TR.validate(raw, phrases, sims).count() == 1  # all phrases at the fallback score: 0.50 is enough
    assert TR.validate(raw, phrases.withColumn("score", F.lit(0.8)), sims).count() == 0
    assert TR.validate(raw, phrases, sims.withColumn("similarity", F.lit(float("nan")))).count() == 0
    rows = [("d", "s", 1, 0, "fifo", "queue", 0.8), ("d", "s", 1, 1, "fifo", "queue", 0.9), ("d", "s", 1, 2, "queue", "first in first out", 0.85), ("d", "s", 1, 3, "array", "arraylist", 0.7), ("d", "s", 1, 4, "fifo", "queue", 0.9)]
    t = spark.createDataFrame(rows, KEYS + ", ord int, subject string, object string, confidence double")
    pairs = TR.dedup_pairs(t)
    assert sorted((r.subject, r.object, r.confidence, r.ord, r.place) for r in pairs.collect()) == [("array", "arraylist", 0.7, 3, 3), ("fifo", "queue", 0.9, 1, 0), ("queue", "first in first out", 0.85, 2, 2)]
    kept = TR.dedup_synonyms(pairs)
    assert sorted(r.subject for r in kept.collect()) == ["array", "fifo"]
    assert TR.dedup_synonyms(kept).count() == 2
    content = spark.createDataFrame([("d", "s0", 0, "text {x}"), ("d", "s9", 9, "none")], KEYS + ", clean_text string")
    assert [r.prompt for r in TR.prompts(phrases, content, "K {keyphrases} T {slide_text}").collect()] == ["K - add(value)\n- list\n- a list T text {x}"]


def test_seams(spark):
    words = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    got = {r.t: r.v for r in backends.embed(words, "t").collect()}
    assert got.keys() == {"a b", "c"} and got["a b"] == backends.hashed_bag(["a b"])[0]
    prompts = spark.createDataFrame([("d", "s", i, p) for i, p in enumerate(["ok", "limited", "both", "broken"])], KEYS + ", prompt string")

    def primary(p):
        if p in ("limited", "both"):
            raise RuntimeError("429 too many")
        if p == "broken":
            raise ValueError("bad key")
        return "1:" + p

    def secondary(p):
        if p == "both":
            raise RuntimeError("rate limit")
        return "2:" + p

    got = {r.page_number: r.response for r in backends.invoke(prompts, primary, secondary).collect()}
    assert got == {0: "1:ok", 1: "2:limited", 2: None, 3: None}
