import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import keyphrases as K
from lectern.operators import triples as TR
from lectern.plans import queries as Q
from lectern.plans.fold import greedy_runs
from lectern.plans.stage import Workspace
from lectern.sources import readers

KEYS = "doc_id string, slide_id string, page_number int"


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_fold_like_one_run(spark):
    """Chains of like rows across segment borders, a deck of one segment, and one whose rows are all alike."""
    rnd = random.Random(5)
    rows = [("chain", i, list(range(i, i + 6))) for i in range(1, 60)] + [("same", i, [1, 2, 3]) for i in range(1, 40)]
    rows += [("mixed", i, rnd.sample(range(12), 6)) for i in range(1, 90)] + [("short", 1, [1]), ("short", 2, None)]
    clash = lambda s, w: len(s & w) / max(len(s | w), 1) >= 0.5
    want = []
    for deck in ("chain", "same", "mixed", "short"):
        kept = []
        for _, i, w in [r for r in rows if r[0] == deck]:
            if not any(clash(s, set(w or [])) for _, s in kept[-2:]):
                kept.append((i, set(w or [])))
        want += [(deck, i) for i, _ in kept]
    df = spark.createDataFrame(rows, "d string, n int, w array<bigint>")
    for span in (4, 7, 1000):
        got = greedy_runs(df, "d", "n", "w", 2, clash, span)
        assert got.schema.simpleString() == "struct<d:string,n:int>"
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decks_are_numbered_by_ranges(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"t {i * 7 % 50}", "en" if i % 10 else "de", "s") for i in range(200)] + [(900, None, "en", "s"), (901, "x", None, "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").where("text is not null and lang is not null")
    n = F.row_number().over(Window.partitionBy("lang").orderBy("text", "doc_id"))
    want = sorted(map(tuple, d.select("lang", n, "text").collect()))
    with Workspace(spark) as space:
        got = Q.deck_pages(space, spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == want
        assert "WindowExec" not in shape(got) and "hashpartitioning(lang" not in shape(got)


def test_texts_are_not_shuffled_by_themselves(spark):
    """A slide's text meets its evidences and chunks by slide; each of them doesn't carry it."""
    content = spark.createDataFrame([("d", "s", 1, "a stack of lists")], KEYS + ", clean_text string")
    raw = spark.createDataFrame([("d", "s", 1, 0, "a", "r", "b", "a stack", "0.9")], KEYS + ", ord int, subject string, relation string, object string, evidence string, confidence string")
    sims = TR.similarities(raw, content)
    assert sims.count() == 1 and "hashpartitioning(clean_text" not in shape(sims)
    lists = "array<string>"
    slides = spark.createDataFrame([("d", "s", 1, ["Stack"], ["a stack of lists"], [], [], [], "Stack a stack of lists")], KEYS + f", headings {lists}, body_text {lists}, bullets {lists}, table_cells {lists}, captions {lists}, clean_text string")
    ranked = K.ranked_chunks(slides)
    assert ranked.count() > 0 and "hashpartitioning(text" not in shape(ranked)


def test_only_sizes_of_the_lexicon_are_made(spark):
    s = spark.createDataFrame([("d", "s", 1, "***  The (hash) map -- holds «keys», hash map!")], KEYS + ", text string")
    lexicon = lambda *names: spark.createDataFrame([(n, "T", 0.9) for n in names], "phrase string, label string, score double")
    found = lambda *names: sorted((r.ord, r.phrase) for r in K.recognize(s, lexicon(*names)).collect())
    # words: "", the, hash, map, "", holds, keys, hash, map
    assert found("hash", "keys") == [(9, "hash"), (25, "keys"), (29, "hash")]
    assert found("hash map", "keys") == [(10, "hash map"), (25, "keys"), (30, "hash map")]
    assert found("map  holds") == [(15, "map  holds")] and found("a b c d e") == []
    assert sorted(r.phrase for r in K.grams_of(s, "text", sizes=(2,)).where("phrase like '%hash%'").collect()) == ["hash map", "hash map", "keys hash", "the hash"]


def test_phrases_stay_within_a_block(spark):
    lists = "array<string>"
    text = "one two. Two\x00three four. Five"
    slides = spark.createDataFrame([("d", "s", 1, ["a", "b"], [], ["x two\x00three"], [], [], text)], KEYS + f", headings {lists}, body_text {lists}, bullets {lists}, table_cells {lists}, captions {lists}, clean_text string")
    phrases = spark.createDataFrame([("d", "s", 1, p, 0.5, i) for i, p in enumerate(["a\x00b", "two\x00three", "five", "none", "two"])], KEYS + ", phrase string, score double, ord int")
    got = {r.phrase: (r.source_type, r.appears_in) for r in K.place(phrases, slides).collect()}
    assert got == {"a\x00b": ("body", text), "two\x00three": ("bullet", "Two\x00three four."), "five": ("body", "Five"), "none": ("body", text), "two": ("bullet", "one two.")}


def test_pages_of_a_long_file_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(readers, "HELD", 1000)
    files = spark.createDataFrame([("a.pdf", bytearray("\f".join(f"page {i} " * 20 for i in range(50)), "utf-8")), ("b.pdf", bytearray(b"\f"))], "path string, content binary")
    got = sorted((r.doc_id, r.page_number) for r in readers.pdf_pages(files).collect())
    assert got == [("a", i) for i in range(1, 51)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
