"""Triple operators: prompts, parsing, normalisation, anchors, resolution, validation, deduplication, statistics."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import phrases as P
from lectern.functions.text import strip
from lectern.functions.vectors import cosine
from lectern.operators.buckets import KEY
from lectern.plans.fold import greedy_keep
from lectern.plans.stage import Workspace
from lectern.schema import RAW_TRIPLE, RELATIONS
from lectern.settings import Settings
from lectern.sources.backends import embed, embed_texts, hashed_bag

RAW = f"array<{RAW_TRIPLE.simpleString()}>"


def prompts(phrases: DataFrame, content: DataFrame, template: str) -> DataFrame:
    """KEY, prompt: the slide's phrases as dashed lines and its text in a template with {keyphrases} and {slide_text}.

    Slides without phrases or text get none.
    """
    lists = phrases.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("ps"))
    named = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("- "), p["phrase"])), "\n")
    filled = F.replace(F.replace(F.lit(template), F.lit("{keyphrases}"), named), F.lit("{slide_text}"), F.col("clean_text"))
    return lists.join(content, list(KEY)).where(strip(F.col("clean_text")) != "").select(*KEY, filled.alias("prompt"))


def parse_response(c: Column) -> Column:
    """A list as it is; of an object, its first list; else nothing. Items that are no objects come as null triples."""
    t = strip(c)
    keys = F.json_object_keys(t)
    values = F.from_json(t, "map<string,string>")
    first = F.get(F.filter(keys, lambda k: F.try_element_at(values, k).rlike(r"^\s*\[")), F.lit(0))
    body = F.when(t.startswith("["), t).when(t.startswith("{"), F.try_element_at(values, first))
    return F.coalesce(F.from_json(body, RAW), F.array().cast(RAW))


def parsed(responses: DataFrame) -> DataFrame:
    """KEY, ord and the raw fields of each triple of the responses (KEY, response)."""
    out = responses.select(*KEY, F.posexplode(parse_response(F.col("response"))).alias("ord", "r")).where("r is not null")
    return out.select(*KEY, "ord", "r.subject", "r.relation", "r.object", "r.evidence", "r.confidence")


def normalized(raw: DataFrame) -> DataFrame:
    """Lower-case stripped ends, stripped relation and evidence, confidence as a number or 0. A null is the word none."""
    low = lambda c: strip(F.lower(F.coalesce(F.col(c), F.lit("None"))))
    keep = lambda c: strip(F.coalesce(F.col(c), F.lit("None")))
    number = F.coalesce(F.expr("try_cast(trim(confidence) as double)"), F.lit(0.0))
    return raw.withColumns({"subject": low("subject"), "object": low("object"), "relation": keep("relation"), "evidence": keep("evidence"), "confidence": number})


def anchor_set(phrases: DataFrame) -> DataFrame:
    """KEY, anchor: phrases and their forms without parentheses."""
    return phrases.select(*KEY, F.explode(P.anchors(F.lower("phrase"))).alias("anchor")).distinct()


def anchored(triples: DataFrame, phrases: DataFrame) -> DataFrame:
    """Layer 1: both ends among the slide's anchors and different, a known relation, no structural label."""
    ok = (F.col("subject") != F.col("object")) & F.col("relation").isin(*RELATIONS) & ~P.structural_label(F.col("subject")) & ~P.structural_label(F.col("object"))
    known = anchor_set(phrases)
    out = triples.where(ok)
    for end in ("subject", "object"):
        out = out.join(known.withColumnRenamed("anchor", end), [*KEY, end], "left_semi")
    return out


def resolved(triples: DataFrame, phrases: DataFrame) -> DataFrame:
    """Ends replaced by the keyphrase they stand for: itself, else the first whose stripped form it is; both must differ still."""
    p = F.lower("phrase")
    forms = phrases.select(*KEY, p.alias("canonical"), "rank", F.explode(F.array(F.struct(F.lit(0).alias("way"), p.alias("form")), F.struct(F.lit(1).alias("way"), P.without_parens(p).alias("form")), F.struct(F.lit(1).alias("way"), P.without_calls(p).alias("form")))).alias("f"))
    best = forms.groupBy(*KEY, F.col("f.form").alias("form")).agg(F.min_by("canonical", F.struct("f.way", "rank")).alias("canonical"))
    out = triples
    for end in ("subject", "object"):
        names = best.select(*KEY, F.col("form").alias(end), F.col("canonical").alias(f"{end}_c"))
        out = out.join(names, [*KEY, end], "left").withColumn(end, F.coalesce(f"{end}_c", end)).drop(f"{end}_c")
    return out.where("subject <> object")


def evidence_holds(similarity: Column, fallback: Column, settings: Settings = Settings()) -> Column:
    """Layer 2. An unknown or undefined similarity fails."""
    least = F.when(fallback, settings.evidence_cosine_fallback).otherwise(settings.evidence_cosine)
    return (F.col("evidence") != "") & F.coalesce(~F.isnan(similarity) & (similarity >= least), F.lit(False))


def fallback_slides(phrases: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """KEY, fallback: whether every phrase of the slide has exactly the fallback score."""
    return phrases.groupBy(*KEY).agg(F.every(F.col("score") == settings.fallback_score).alias("fallback"))


def confident(triples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Layer 3."""
    return triples.where(F.col("confidence") >= settings.confidence)


def similarities(raw: DataFrame, content: DataFrame, encode: Callable[[list[str]], list[list[float]]] = hashed_bag) -> DataFrame:
    """KEY, evidence, similarity: cosines of the raw triples' evidences and the texts of their slides. Each distinct
    string is embedded once; texts are met by slide, not carried along with each evidence."""
    said = normalized(raw).select(*KEY, "evidence").where("evidence <> ''").distinct()
    texts = content.select(*KEY, "clean_text").join(said.select(*KEY).distinct(), list(KEY), "left_semi")
    e = embed(said, "evidence", encode).withColumnRenamed("v", "ev")
    t = embed_texts(texts, KEY, "clean_text", encode).withColumnRenamed("v", "tv")
    return said.join(e, "evidence").join(t, list(KEY)).select(*KEY, "evidence", cosine(F.col("ev"), F.col("tv")).alias("similarity"))


def validate(raw: DataFrame, phrases: DataFrame, similarities: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """The layers in order of cost: confidence and anchors before similarities (KEY, evidence, similarity). Without
    similarities, what the other layers leave, of which layer 2 then only wants that there is evidence."""
    out = resolved(anchored(confident(normalized(raw), settings), phrases), phrases)
    return out.where("evidence <> ''") if similarities is None else evident(out, phrases, similarities, settings)


def evident(triples: DataFrame, phrases: DataFrame, similarities: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Layer 2 on what the other layers leave."""
    out = triples.join(similarities, [*KEY, "evidence"], "left").join(fallback_slides(phrases, settings), list(KEY), "left")
    return out.where(evidence_holds(F.col("similarity"), F.coalesce("fallback", F.lit(False)), settings)).drop("similarity", "fallback")


def dedup_pairs(triples: DataFrame) -> DataFrame:
    """Of each (subject, object) of a slide the most confident triple, the first of equals, at the pair's first place."""
    pair = Window.partitionBy(*KEY, "subject", "object")
    best = F.row_number().over(pair.orderBy(F.col("confidence").desc(), "ord"))
    return triples.withColumn("place", F.min("ord").over(pair)).withColumn("rank", best).where("rank = 1").drop("rank")


def dedup_synonyms(triples: DataFrame) -> DataFrame:
    """By falling confidence, triples whose ends are not synonymous with a kept one's, either way round."""
    # what phrases are compared by is made once a phrase, behind the fields that order
    made = triples.select(*KEY, F.struct((-F.col("confidence")).alias("neg"), "place", "subject", "object", P.forms(F.col("subject")).alias("s"), P.forms(F.col("object")).alias("o")).alias("x"))
    items = made.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("items"))

    def clash(k: Column, x: Column) -> Column:
        return (P.alike(x["s"], k["s"]) & P.alike(x["o"], k["o"])) | (P.alike(x["s"], k["o"]) & P.alike(x["o"], k["s"]))

    kept = greedy_keep(F.col("items"), f"struct<neg:double,place:int,subject:string,object:string,s:{P.FORMS},o:{P.FORMS}>", clash)
    kept = items.select(*KEY, F.inline(kept)).select(*KEY, "place", "subject", "object")
    return triples.join(kept, [*KEY, "place", "subject", "object"], "left_semi")


def relation_distribution(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation")


def triple_stats(content: DataFrame, raw: DataFrame, passed: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, n_slides, n_skipped (without raw triples), n_raw, n_passed, n_kept, pass_rate."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    busy = raw.select("doc_id", "slide_id").distinct()
    out = n(content, "n_slides").join(n(busy, "n_busy"), "doc_id", "left").join(n(raw, "n_raw"), "doc_id", "left").join(n(passed, "n_passed"), "doc_id", "left").join(n(kept, "n_kept"), "doc_id", "left").na.fill(0)
    rate = F.when(F.col("n_raw") > 0, F.bround(F.col("n_passed") / F.col("n_raw"), 4)).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_slides", (F.col("n_slides") - F.col("n_busy")).alias("n_skipped"), "n_raw", "n_passed", "n_kept", rate.alias("pass_rate"))


class Extracted(NamedTuple):
    raw: DataFrame
    passed: DataFrame
    kept: DataFrame


def extract(content: DataFrame, phrases: DataFrame, complete: Callable[[DataFrame], DataFrame], template: str, space: Workspace, settings: Settings = Settings(), encode: Callable[[list[str]], list[list[float]]] = hashed_bag) -> Extracted:
    """Step 4 whole: prompts, a model's answers, parsing, the three layers, and both deduplications.

    complete: the model, from (KEY, prompt) to (KEY, response). What several steps read is written to `space` once.
    """
    raw = space.table(parsed(complete(prompts(phrases, content, template))), "raw")
    # evidence is compared last and only of the triples that the other layers leave
    left = space.table(validate(raw, phrases, settings=settings), "left")
    passed = space.table(evident(left, phrases, similarities(left, content, encode), settings), "passed")
    return Extracted(raw, passed, dedup_synonyms(dedup_pairs(passed)))


def edges(triples: DataFrame) -> DataFrame:
    """The edge table; equal edges of different slides stay, each with its evidence."""
    return triples.select("subject", "relation", "object", "evidence", "confidence", "slide_id", "doc_id", F.lit("extraction").alias("source"))


def vertices(triples: DataFrame) -> DataFrame:
    ends = triples.select("doc_id", F.explode(F.array("subject", "object")).alias("name"))
    return ends.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("degree"))
