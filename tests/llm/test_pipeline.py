import random

import test_minhash
import test_suffixes
from test_langid import sample
from test_mixing import plain_targets, words_of

import corpus_pipeline
from lectern.llm.bpe import ByteBPE, default_vocabulary
from lectern.llm.langid import train
from lectern.plans.stage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    random.seed(8)
    langs = ["en", "fr", "de"]
    rows = []
    for i in range(90):
        t = " ".join(sample(langs[i % 3], i * 31 + k) + f" {random.choice('abcdefgh') * random.randrange(2, 6)}{k}" for k in range(1 + i % 4))
        rows.append((i, t, langs[i % 3], f"s{i % 5}"))
    passage = " ".join("".join(random.choice("klmnop") for _ in range(5)) for _ in range(120))
    rows += [(100 + i, sample("en", i * 17) + f" u{i} " * 7 + passage + f" v{i} " * 9, "en", "s1") for i in range(4)]
    rows += [(200 + i, rows[20][1], "fr", "s2") for i in range(5)]
    rows += [(300, None, "en", "s0"), (301, "12 34", "en", "s0"), (302, "", None, None), (303, "passage " + passage, "en", None), (304, passage, "en", "s9")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def plain(rows):
    """Stages one to three by brute force."""
    from test_pipeline_whole import plain_cut

    alive = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = {d for d, _, c, k in test_minhash.brute([(r[0], r[1]) for r in alive], 80) if k}
    alive = [r for r in alive if r[0] in kept]
    cut = plain_cut([r[1] for r in alive])
    return sorted((r[0], t, r[2], r[3], len(t)) for r, t in zip(alive, cut, strict=True) if t.split())


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path)
    docs, by_stage = spark.read.parquet(path), []
    assert len(train(docs)[0]) == 3
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        by_stage.append(docs)
        assert name and (stage is corpus_pipeline.STAGES[-1][1] or docs.columns == COLUMNS)
    kept = plain(rows)
    assert len(kept) < len(rows) - 6 and sorted(map(tuple, by_stage[2].collect())) == kept
    sizes = {s: sum(words_of(r[1]) for r in kept if r[3] == s) for s in {r[3] for r in kept}}
    want, mixed = plain_targets(sizes), by_stage[3].collect()
    times = {}
    for r in mixed:
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) <= set(kept) and max(times.values()) <= 2
    for s in sizes:  # whole documents stand for the words taken of them
        got = sum(words_of(r.text) for r in mixed if r.source == s)
        assert want[s] - 40 <= got <= want[s] + max(words_of(r[1]) for r in kept if r[3] == s) + 40
    bpe = ByteBPE(default_vocabulary())
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in by_stage[4].collect()) == sorted((r.doc_id, tuple(bpe.encode(r.text))) for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, by_stage[4].collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_suffix_brute_is_shared():
    assert test_suffixes.brute([(1, "x" * 401)])[0][2] == 401
