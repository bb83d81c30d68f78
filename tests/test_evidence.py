import math
import os

import pytest

from lectern.operators import triples as TR
from lectern.plans import queries as Q
from lectern.sources.backends import hashed_bag

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "page_number", "ord", "subject", "relation", "object", "evidence"]


def plain_cosine(a, b):
    u, v = hashed_bag([a, b])
    norm = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
    return sum(x * y for x, y in zip(u, v, strict=True)) / norm if norm else None


def test_evidence_meets_the_slide_text(spark):
    text = "a stack is a list of things where the last one in is the first one out"
    said = [text, "a stack is a list of things", "unheard of whales swim by night", " "]
    sims = [plain_cosine(e.strip(), text) for e in said]
    assert sims[0] > 0.65 > sims[1] > 0.5 > sims[2] and sims[3] is None
    keys = [(d, "s", 1) for d in ("plain", "fallback")]
    raw = spark.createDataFrame([(*k, i, "stack", "isPartOf", "list", e, "0.9") for k in keys for i, e in enumerate(said)], "doc_id string, slide_id string, page_number int, ord int, subject string, relation string, object string, evidence string, confidence string")
    phrases = spark.createDataFrame([(*k, p, r, 0.4 if k[0] == "fallback" else 0.9) for k in keys for r, p in enumerate(("stack", "list"))], "doc_id string, slide_id string, page_number int, phrase string, rank int, score double")
    content = spark.createDataFrame([(*k, text) for k in keys], "doc_id string, slide_id string, page_number int, clean_text string")
    got = sorted((r.doc_id, r.ord) for r in TR.validate(raw, phrases, Q.similarities(raw, content)).collect())
    least = {"plain": 0.65, "fallback": 0.5}
    assert got == sorted((d, i) for d in least for i, c in enumerate(sims) if c is not None and c >= least[d])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_validated_by_brute_force(spark):
    raw, phrases = Q.raw_triples(spark, SF), Q.phrases(spark, SF)
    texts = {(r.doc_id, r.slide_id, r.page_number): r.clean_text for r in Q.content(spark, SF).collect()}
    scores = {}
    for r in phrases.collect():
        scores.setdefault((r.doc_id, r.slide_id, r.page_number), set()).add(r.score)
    others = TR.validate(raw, phrases).collect()  # the other layers
    want = []
    for r in others:
        key = (r.doc_id, r.slide_id, r.page_number)
        c = plain_cosine(r.evidence, texts[key])
        if c is not None and c >= (0.5 if scores[key] == {0.4} else 0.65):
            want.append(tuple(r[k] for k in COLUMNS))
    got = [tuple(r) for r in Q.queries()["tr_validate_all"](spark, SF).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(others)
