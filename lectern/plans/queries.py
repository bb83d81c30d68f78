"""Queries over the driver's tables: one for each operator, on whole tables.

Slides are documents: a deck is a source, a page its doc_id, and each line gets markup by its number, so that every
branch of the router is met. Decks of the page operators are languages in text order, where neighbours are alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions import lines as L
from lectern.functions import phrases as P
from lectern.functions.text import ascii_upper, strip
from lectern.functions.vectors import cosine
from lectern.operators import buckets as B
from lectern.operators import keyphrases as K
from lectern.operators import pages as PG
from lectern.operators import triples as TR
from lectern.plans.stage import Workspace
from lectern.sources import backends, readers, writers
from lectern.schema import BUCKETS
from lectern.settings import Settings

NB, BE = Settings.of("notebook"), Settings.of("backend")
#: Overrides under which the queries' results aren't empty on the driver's tables.
FILTER_NB = Settings(repetition_share=0.04)
FILTER_BE = Settings(profile="backend", repetition_share=0.04, repetition_min_slides=2)
NEAR = 0.30
#: What a JSON string must not hold as it is.
UNQUOTABLE = r'["\\\x00-\x1f]'
TEMPLATE = "Phrases:\n{keyphrases}\nText:\n{slide_text}"

#: Markup by line number; plain SQL that both engines read. {i}: the line's number, {l}: the line.
MARKUP = """case {i} % 15
 when 0 then concat('# ', {l}) when 1 then concat('- ', {l}) when 2 then concat('> ', {l}) when 3 then concat('> OCR: ', {l})
 when 4 then concat('| ', replace({l}, ' ', ' | '), ' | 7 |') when 5 then '```' when 6 then concat('• ', {l}) when 7 then concat({l}, ';')
 when 8 then '```' when 9 then concat('**', {l}, '** and `x_y` [link](u) ~~gone~~') when 10 then '{{3}}' when 11 then concat('• ', {l})
 when 12 then concat('> OCR: - ', {l}) when 13 then 'Page 3 of 9' else {l} end"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def slides(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    marked = F.expr(f"array_join(transform(split(text, '\\n', -1), (l, i) -> {MARKUP.format(l='l', i='i')}), '\\n')")
    page = F.col("doc_id").cast("int")
    return d.select(F.format_string("slide_%03d", page).alias("slide_id"), page.alias("page_number"), marked.alias("raw_markdown"), F.coalesce("source", F.lit("")).alias("doc_id"), "lang")


def deck_pages(space: Workspace, spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a deck, a language, ordered by text. Ranges of the order are tasks' own, whatever a deck's size: a page's
    number is its place in its range and the deck's pages in the ranges before."""
    d = table(spark, sf, "documents").where("text is not null and lang is not null").select("lang", "text", "doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.repartitionByRange(n, "lang", "text", "doc_id").sortWithinPartitions("lang", "text", "doc_id")
    dealt = space.table(dealt.select(F.col("lang").alias("doc_id"), F.col("text").alias("raw_markdown"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "dealt")
    sizes = dealt.groupBy("doc_id", "part").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("doc_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least") + 1).alias("shift"))
    return dealt.join(F.broadcast(sizes), ["doc_id", "part"]).select("doc_id", (F.col("id") + F.col("shift")).cast("int").alias("page_number"), "raw_markdown")


def deck_counts(st: Steps) -> DataFrame:
    pages = deck_pages(st.space, st.spark, st.sf)
    return PG.counts(pages, PG.drop_near_duplicates(pages))


def routed(spark: SparkSession, sf: str, profile: str = "notebook") -> DataFrame:
    lines = B.lines_of(slides(spark, sf))
    return B.route_notebook(lines) if profile == "notebook" else B.route_backend(lines)


def content(spark: SparkSession, sf: str, profile: str = "notebook") -> DataFrame:
    s = slides(spark, sf)
    return B.assemble(B.collect(routed(spark, sf, profile), s, profile), profile)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark, of five letters at least, with a label and a score by length."""
    w = F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1))
    n = F.length("phrase")
    return table(spark, sf, "benchmark").select(w.alias("phrase")).where(n >= 5).distinct().select("phrase", F.concat(F.lit("L"), (n % 3).cast("string")).alias("label"), ((30 + 7 * (n % 10)).cast("double") / 100).alias("score"))


class Steps:
    """Tables of the steps, each written once, on first use."""

    def __init__(self, space: Workspace, spark: SparkSession, sf: str):
        self.space, self.spark, self.sf = space, spark, sf

    @cached_property
    def content(self) -> DataFrame:
        return self.space.table(content(self.spark, self.sf), "content")

    @cached_property
    def backend(self) -> DataFrame:
        return self.space.table(content(self.spark, self.sf, "backend"), "content")

    @cached_property
    def phrases(self) -> DataFrame:
        return self.space.table(K.from_candidates(self.recognized, self.gated), "phrases")

    @cached_property
    def gated(self) -> DataFrame:
        return self.space.table(self.content.where(K.pedagogical()).select(*B.KEY, *BUCKETS, "clean_text", K.extraction_text().alias("text")), "gated")

    @cached_property
    def recognized(self) -> DataFrame:
        return self.space.table(K.recognize(self.gated, lexicon(self.spark, self.sf)), "recognized")

    @cached_property
    def chunks(self) -> DataFrame:
        return self.space.table(K.noun_chunks(self.gated), "chunks")

    @cached_property
    def raw(self) -> DataFrame:
        return self.space.table(TR.parsed(responses(self.phrases)), "raw")

    @cached_property
    def triples(self) -> TR.Extracted:
        return TR.extract(self.content, self.phrases, lambda p: backends.replay(p, responses(self.phrases)), TEMPLATE, self.space)

    @cached_property
    def strings(self) -> DataFrame:
        """p: the distinct phrases, chunks and triple ends of all slides, and grams."""
        ends = self.raw.select(F.explode(F.array("subject", "object")).alias("p"))
        found = self.recognized.select(F.col("phrase").alias("p")).unionByName(self.chunks.select(F.col("chunk").alias("p")))
        every = grams(self.spark, self.sf).unionByName(found).unionByName(ends).where("p is not null")
        return self.space.table(every.distinct(), "strings")


def held(f: Callable[[Steps], DataFrame]) -> Callable:
    """A query over the steps' tables. They go at its end; its result is a table that stays."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        with Workspace(spark) as space:
            return space.finish(f(Steps(space, spark, sf)), "result")

    return run


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    return K.keyphrases(content(spark, sf), lexicon(spark, sf))


def responses(phrases: DataFrame) -> DataFrame:
    """An answer a slide: neighbouring phrases as triples, some broken, in an object or a list by page. Every third
    triple's evidence is the sentence that holds its subject, as models quote; the others name the phrase alone."""
    w = Window.partitionBy(*B.KEY).orderBy("rank")
    p = phrases.withColumn("next", F.lead("phrase").over(w)).where("next is not null")
    names = F.array(*[F.lit(x) for x in (*TR.RELATIONS, "knows")])
    quoted = F.when(F.col("rank") % 3 == 1, F.regexp_replace("appears_in", UNQUOTABLE, " ")).otherwise(F.concat(F.lit("of "), F.col("phrase")))
    one = F.format_string('{"subject": "%s", "relation": "%s", "object": "%s", "evidence": "%s", "confidence": %s}', F.when(F.col("rank") % 4 == 0, F.concat(ascii_upper(F.col("phrase")), F.lit(" "))).otherwise(F.col("phrase")), F.get(names, F.col("rank") % 9), F.col("next"), quoted, F.when(F.col("rank") % 11 == 10, '"high"').otherwise(F.concat(F.lit("0."), (60 + F.col("rank") * 7 % 40).cast("string"))))
    body = p.select(*B.KEY, "rank", one.alias("t")).groupBy(*B.KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), ", ").alias("b"))
    t = F.when(F.col("page_number") % 5 == 0, F.concat(F.lit('{"note": "x", "triples": ['), "b", F.lit("]}"))).when(F.col("page_number") % 17 == 0, F.lit("oops")).otherwise(F.concat(F.lit("["), F.col("b"), F.lit("]")))
    return body.select(*B.KEY, t.alias("response"))


def raw_triples(spark: SparkSession, sf: str) -> DataFrame:
    return TR.parsed(responses(phrases(spark, sf)))


similarities = TR.similarities


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema.fields])


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, their lengths beside."""
    for n in names:
        df = df.withColumn(f"n_{n}", F.size(n)).withColumn(n, F.array_join(n, "|"))
    return df


def line_flags(flag) -> Callable:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = slides(spark, sf).select("lang", F.explode(F.split("raw_markdown", "\n", -1)).alias("line")).withColumn("s", strip(F.col("line"))).where("s <> ''")
        return s.withColumn("flag", flag(F.col("s"))).groupBy("lang").agg(F.count_if("flag").alias("flagged"), F.count(F.lit(1)).alias("n_lines"))

    return run


def items(kinds: tuple[str, ...], profile: str = "notebook") -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = routed(spark, sf, profile).where(F.col("kind").isin(*kinds))
        return r.select("doc_id", "page_number", "line_no", "bucket", F.array_join("items", "|").alias("items"), F.size("items").alias("n_items"))

    return run


def per_phrase(column: str, make) -> Callable:  # noqa: ANN001
    """A rule over the distinct phrases, chunks and triple ends of all slides, and grams."""
    return held(lambda st: st.strings.select("p", make(F.col("p")).alias(column)))


def grams(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct windows of one to five words of benchmark texts, with forms that rules look for."""
    w = F.split(F.lower("text"), " +", -1)
    t = table(spark, sf, "benchmark").select(w.alias("w"))
    at = t.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).select("w", "i", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    p = at.select(F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("p"), "i")
    marked = F.expr("""case i % 8 when 0 then concat('to ', p) when 1 then concat(p, '(', p, ')') when 2 then concat('summary ', p, ' 1/2') when 3 then concat(p, '{5}')
        when 4 then concat('this ', p) when 5 then concat(p, '()') when 6 then '12, 3.4' else p end""")
    return p.select(marked.alias("p")).distinct()


def pairs_of_phrases(strings: DataFrame) -> DataFrame:
    """Each string with its first word, its initials and itself."""
    g = strings.withColumn("p", strip(F.lower("p"))).where("p <> ''").distinct()
    initials = F.array_join(F.transform(F.filter(F.split(F.regexp_replace("p", "[^a-z ]", ""), " ", -1), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")
    firsts = F.array(F.col("p"), F.element_at(F.split("p", " ", -1), 1), initials, F.concat(F.lit("x"), F.col("p")))
    return g.select("p", F.posexplode(firsts).alias("way", "o"))


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))


def kept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """kp_dedup over stored vectors: a label is a slide, a vector a phrase, in order of vec_id."""
    v = labelled_vectors(spark, sf).select(F.col("label").cast("string").alias("doc_id"), F.lit("s").alias("slide_id"), F.lit(1).alias("page_number"), F.col("vec_id").cast("string").alias("phrase"), F.lit(1.0).alias("score"), F.col("vec_id").cast("int").alias("ord"), "v")
    kept = K.dedup_phrases(v.drop("v"), v.select("phrase", "v"), Settings(phrase_dedup_cosine=NEAR))
    return kept.select("doc_id", F.col("ord").alias("vec_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    t = table
    # pages
    q["pg_split"] = lambda s, d: PG.split_pages(t(s, d, "documents").where("text is not null").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), PG.SEPARATOR).alias("markdown")).withColumnRenamed("source", "doc_id"))
    q["src_pdf_dl"] = lambda s, d: PG.split_pages(t(s, d, "documents").where("text is not null").select(F.col("doc_id"), F.concat("text", F.lit(PG.SEPARATOR), "lang").alias("markdown"), (F.col("doc_id") % 4).alias("n_pages")))
    q["src_ocr"] = lambda s, d: t(s, d, "documents").select("doc_id", PG.ocr_prefixed(F.col("text")).alias("ocr"))
    q["pg_collapse_blank"] = lambda s, d: t(s, d, "documents").select("doc_id", PG.collapse_blank(F.replace("text", F.lit(". "), F.lit(".\n\n\n\n"))).alias("t"))
    q["pg_is_empty"] = lambda s, d: slides(s, d).select("doc_id", "page_number", F.explode(F.split("raw_markdown", "\n", -1)).alias("l")).groupBy("doc_id", "page_number").agg(F.count_if(PG.is_empty(F.col("l"))).alias("n_empty"), F.count(F.lit(1)).alias("n"))
    q["pg_word_set"] = lambda s, d: slides(s, d).select("doc_id", "page_number", F.size(PG.word_set(F.col("raw_markdown"))).alias("n"), F.array_join(F.array_sort(PG.word_set(F.col("raw_markdown"))), " ").alias("words"))
    q["pg_near_dup"] = held(lambda st: PG.drop_near_duplicates(deck_pages(st.space, st.spark, st.sf)).select("doc_id", "page_number"))
    q["pg_emit"] = lambda s, d: PG.emit(slides(s, d))
    q["pg_counts"] = held(deck_counts)
    # lines
    q["ln_noise_nb"] = line_flags(lambda c: L.noise(c))
    q["ln_noise_be"] = line_flags(lambda c: L.noise(c, "backend"))
    q["ln_code_nb"] = line_flags(lambda c: L.code(c))
    q["ln_code_be"] = line_flags(lambda c: L.code(c, "backend"))
    q["ln_ocr_noise"] = line_flags(L.ocr_noise)
    q["ln_prose_label"] = line_flags(L.prose_label)
    q["ln_bullet_re"] = line_flags(lambda c: c.rlike(L.BULLET))
    q["ln_header_row"] = line_flags(lambda c: L.header_row(L.cells(c)))
    q["ln_sep_row"] = line_flags(lambda c: L.separator_row(L.cells(c)))
    q["ln_strip_inline"] = lambda s, d: B.lines_of(slides(s, d)).select("doc_id", "page_number", "line_no", L.strip_inline(F.col("s")).alias("t"))
    # routing
    q["bk_lines"] = lambda s, d: B.lines_of(slides(s, d)).select("doc_id", "page_number", "line_no", "s")
    q["bk_fence"] = items(("fence", "fence_label", "fence_code"))
    q["bk_heading"] = items(("heading",))
    q["bk_blockquote"] = items(("caption", "ocr"))
    q["bk_ocr"] = items(("ocr",))
    q["bk_bullet"] = items(("bullet",))
    q["bk_beamer"] = items(("beamer",))
    q["bk_table"] = items(("table",))
    q["bk_body"] = items(("body",))
    q["bk_backend_order"] = items(("heading", "bullet", "marked", "table", "caption", "body"), "backend")
    q["bk_collect"] = lambda s, d: flat(content(s, d).drop("slide_id", "heading_phrases"), "headings", "body_text", "bullets", "table_cells", "captions", "code_lines")
    q["bucket_counts"] = lambda s, d: routed(s, d).groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("items")).alias("n_items"))
    # documents
    q["xs_filter_nb"] = held(lambda st: flat(B.cross_slide_filter(st.content, FILTER_NB).select("doc_id", "page_number", "headings", "body_text", "bullets", "table_cells", "captions"), "headings", "body_text", "bullets", "table_cells", "captions"))
    q["xs_filter_be"] = held(lambda st: flat(B.cross_slide_filter(st.backend, FILTER_BE).select("doc_id", "page_number", "headings", "body_text", "bullets", "table_cells", "captions", "code_lines"), "headings", "body_text", "bullets", "table_cells", "captions", "code_lines"))
    q["as_clean_text"] = lambda s, d: content(s, d).select("doc_id", "page_number", "clean_text")
    q["as_content"] = lambda s, d: content(s, d).where(B.has_content()).select("doc_id", "page_number")
    q["as_content_be"] = lambda s, d: content(s, d, "backend").where(B.has_content("backend")).select("doc_id", "page_number")
    q["as_stats"] = lambda s, d: B.stats(content(s, d))
    q["as_deck_stats"] = lambda s, d: B.deck_stats(content(s, d))
    q["ld_rebuild"] = lambda s, d: flat(B.repair(loaded(s, d)).select("doc_id", "page_number", "body_text", "bullets", "code_lines", "clean_text"), "body_text", "bullets", "code_lines")
    for name, part in (("ld_page_ref", "body_text"), ("ld_bullet_lead", "bullets"), ("ld_heading_dedup", "body_text"), ("ld_code_route", "code_lines")):
        q[name] = lambda s, d, part=part: flat(B.repair(loaded(s, d)).select("doc_id", "page_number", part), part)
    # keyphrases
    q["kp_pedagogical"] = lambda s, d: content(s, d).select("doc_id", "page_number", K.pedagogical().alias("ok"))
    q["kp_toc"] = lambda s, d: content(s, d).select("doc_id", "page_number", K.toc_slide().alias("toc"))
    q["kp_text_nb"] = lambda s, d: content(s, d).select("doc_id", "page_number", K.extraction_text().alias("t"))
    q["kp_text_be"] = lambda s, d: content(s, d, "backend").select("doc_id", "page_number", K.extraction_text("backend").alias("t"))
    q["kp_ner"] = held(lambda st: st.recognized.select("doc_id", "page_number", "ord", "phrase", "label", "score"))
    q["kp_max_score"] = held(lambda st: K.best_scores(st.recognized).select("doc_id", "page_number", "phrase", "score", "ord"))
    q["kp_label_dist"] = held(lambda st: K.label_distribution(st.recognized))
    q["kp_clean"] = per_phrase("cleaned", P.clean)
    q["kp_valid"] = per_phrase("ok", lambda c: P.valid(strip(F.lower(c))))
    q["kp_label"] = per_phrase("ok", lambda c: P.slide_label(strip(F.lower(c))))
    q["kp_linguistic"] = per_phrase("ok", K.linguistic)
    q["kp_noun_chunks"] = held(lambda st: st.chunks.select("doc_id", "page_number", "chunk", "ord"))
    q["kp_chunk_xval"] = held(lambda st: K.in_chunks(K.best_scores(st.recognized), st.chunks).select("doc_id", "page_number", "phrase"))
    q["kp_source_type"] = held(lambda st: st.phrases.select("doc_id", "page_number", "phrase", "source_type"))
    q["kp_boost"] = held(lambda st: st.phrases.select("doc_id", "page_number", "phrase", "score"))
    q["kp_sentence"] = held(lambda st: st.phrases.select("doc_id", "page_number", "phrase", "appears_in"))
    q["kp_limit"] = held(lambda st: K.limit(K.best_scores(st.recognized), Settings(keyphrase_max=3)).select("doc_id", "page_number", "phrase", "rank"))
    q["kp_topk"] = held(lambda st: K.top_candidates(K.best_scores(st.recognized), Settings(candidate_top=4, candidate_score=0.5)).select("doc_id", "page_number", "phrase", "score"))
    q["kp_stats"] = held(lambda st: K.phrase_stats(st.phrases, st.content))
    q["kp_top"] = held(lambda st: K.top_phrases(st.phrases, 5).select("doc_id", "page_number", "n_phrases", F.array_join(F.slice("top", 1, 3), ", ").alias("top3"), F.array_join("top", ", ").alias("top5")))
    q["kp_score_cos"] = scored_vectors
    q["kp_dedup"] = kept_vectors
    q["kp_fallback"] = held(lambda st: K.with_fallback(K.best_scores(st.recognized), st.gated, chunk_phrases(st.chunks), settings=Settings(fallback_max_phrases=3)).select("doc_id", "page_number", "phrase", "score"))
    q["kp_step3"] = held(whole_step3)
    q["kp_step3_be"] = held(lambda st: K.ranked_chunks(st.backend, space=st.space).select("doc_id", "page_number", "phrase", "score", "source_type", "rank"))
    # triples
    q["tr_prompt"] = held(lambda st: TR.prompts(st.phrases, st.content, TEMPLATE).select("doc_id", "page_number", "prompt"))
    q["tr_llm"] = held(lambda st: backends.replay(TR.prompts(st.phrases, st.content, TEMPLATE), responses(st.phrases)).select("doc_id", "page_number", "response"))
    q["tr_parse"] = held(lambda st: st.raw.select("doc_id", "page_number", "ord", "subject", "relation", "object", "evidence", "confidence"))
    q["tr_normalize"] = held(lambda st: TR.normalized(st.raw).select("doc_id", "page_number", "ord", "subject", "relation", "object", "evidence", "confidence"))
    q["tr_anchor_set"] = per_phrase("anchors", lambda c: F.array_join(F.array_sort(P.anchors(c)), "|"))
    q["tr_anchor"] = held(lambda st: TR.anchored(TR.normalized(st.raw), st.phrases).select("doc_id", "page_number", "ord", "subject", "object"))
    q["tr_label"] = per_phrase("ok", lambda c: P.structural_label(strip(F.lower(c))))
    q["tr_resolve"] = held(resolved_phrases)
    q["tr_evidence"] = evidence_rows
    q["tr_similarity"] = held(lambda st: TR.similarities(st.raw, st.content).select("doc_id", "page_number", "evidence", F.round("similarity", 9).alias("similarity")))
    q["tr_confidence"] = held(lambda st: TR.confident(TR.normalized(st.raw)).select("doc_id", "page_number", "ord", "confidence"))
    q["tr_validate_all"] = held(lambda st: st.triples.passed.select("doc_id", "page_number", "ord", "subject", "relation", "object", "evidence", "confidence"))
    q["tr_pair_dedup"] = held(lambda st: TR.dedup_pairs(paired(st)).select("doc_id", "page_number", "subject", "object", "confidence", "ord", "place"))
    q["tr_synonym"] = held(lambda st: pairs_of_phrases(st.strings).select("p", "way", "o", P.synonyms(F.col("p"), F.col("o")).alias("same")))
    q["tr_sem_dedup"] = held(lambda st: TR.dedup_synonyms(TR.dedup_pairs(paired(st))).select("doc_id", "page_number", "subject", "object", "confidence"))
    q["tr_rel_dist"] = held(lambda st: TR.relation_distribution(st.triples.passed))
    q["tr_stats"] = held(lambda st: TR.triple_stats(st.content, st.triples.raw, st.triples.passed, TR.dedup_pairs(st.triples.passed)))
    # sources and sinks
    q["src_settings"] = settings_rows
    q["src_pdf_text"] = lambda s, d: readers.pdf_pages(t(s, d, "documents").where("text is not null").select(F.concat(F.lit("decks/d"), "doc_id", F.lit(".pdf")).alias("path"), F.replace("text", F.lit(". "), F.lit(". \f")).cast("binary").alias("content")))
    q["src_parsed_json"] = json_round_trip(lambda st: slides(st.spark, st.sf).drop("lang"), lambda s, p: readers.parsed_json(s, p, "deck", lines=True), "slide_id", "page_number", "raw_markdown", "doc_id")
    q["src_preprocessed_json"] = json_round_trip(lambda st: loaded(st.spark, st.sf).drop("doc_id"), lambda s, p: flat(readers.preprocessed_json(s, p, "deck", lines=True), "body_text", "bullets", "code_lines"), "slide_id", "page_number", "doc_id", "body_text", "n_body_text", "bullets", "n_bullets", "code_lines", "n_code_lines", "clean_text")
    q["snk_step1"] = sunk(lambda st: slides(st.spark, st.sf).drop("lang"), "slide_id", "page_number", "raw_markdown")
    q["snk_step2"] = sunk(lambda st: writers.step2_report(st.content).select(*B.KEY, "clean_text", "bullets", "stats"), "page_number", "clean_text", "array_join(bullets, '|') as bullets", "stats.n_headings", "stats.clean_text_len")
    q["snk_step4"] = sunk(lambda st: writers.step4_report(st.content, st.phrases, st.triples.raw, st.triples.kept), "page_number", "raw_count", "validated_count", "case when raw_triples is null then 0 else size(raw_triples) end as n_raw", "array_join(transform(triples, x -> concat_ws('>', x.subject, x.relation, x.object)), '|') as triples")
    q["snk_md_files"] = held(markdown_files)
    q["src_cache"] = lambda s, d: t(s, d, "documents").where("text is not null").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).join(t(s, d, "documents").where("text is not null and lang = 'en'").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).distinct(), "sha", "left_anti").select("doc_id", "sha")
    q["src_upload"] = lambda s, d: t(s, d, "pages").select("page_id", readers.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))
    q["src_html"] = lambda s, d: t(s, d, "pages").select("page_id", readers.html_markdown(F.col("html")).alias("markdown"))
    q["snk_step2_stats"] = lambda s, d: writers.step2_report(content(s, d)).select("doc_id", "page_number", "stats.*")
    q["snk_step3"] = held(lambda st: writers.keyphrases_by_slide(st.phrases).select("doc_id", "page_number", F.array_join(F.transform("keyphrases", lambda p: p["phrase"]), "|").alias("phrases")))
    q["snk_step4_report"] = held(lambda st: writers.step4_report(st.content, st.phrases, st.triples.raw, st.triples.passed).select("doc_id", "page_number", F.array_join("keyphrases", "|").alias("keyphrases"), "raw_count", "validated_count"))
    q["edges"] = held(lambda st: TR.edges(st.triples.kept).select("doc_id", "slide_id", "subject", "relation", "object", "confidence", "source"))
    q["vertices"] = held(lambda st: TR.vertices(st.triples.passed))
    return {k: (lambda s, d, f=f: wide(f(s, d))) for k, f in q.items()}


def loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-bucketed slides with what the repairs look for: page tags, markers, headings in body, code."""
    d = table(spark, sf, "documents").where("text is not null")
    ls = F.split("text", "\n", -1)
    head = F.get(ls, F.lit(0))
    body = F.concat(F.array(F.lit("{4}"), head, F.concat(head, F.lit(" and more"))), F.transform(ls, lambda l, i: F.when(i % 3 == 1, F.concat(l, F.lit(";"))).otherwise(l)))
    bullets = F.transform(ls, lambda l, i: F.when(i % 2 == 0, F.concat(F.lit(" ◮ - "), l)).when(i % 5 == 1, F.lit("•  ")).otherwise(l))
    none = F.array().cast("array<string>")
    return d.select(F.coalesce("source", F.lit("")).alias("doc_id"), F.format_string("slide_%03d", F.col("doc_id").cast("int")).alias("slide_id"), F.col("doc_id").cast("int").alias("page_number"), F.array(head).alias("headings"), body.alias("body_text"), bullets.alias("bullets"), none.alias("table_cells"), none.alias("captions"), none.alias("code_lines"), F.array(head).alias("heading_phrases"))


def chunk_phrases(chunks: DataFrame) -> DataFrame:
    """The splitter's chunks in place of a model's phrases."""
    return chunks.select(*B.KEY, F.col("chunk").alias("phrase"), "ord")


def whole_step3(st: Steps) -> DataFrame:
    """Step 3 with its fallback on poor slides."""
    settings = Settings(fallback_max_phrases=3)
    found = K.from_candidates(st.recognized, st.gated, settings, offered=lambda poor: chunk_phrases(K.noun_chunks(poor)))
    return found.select("doc_id", "page_number", "phrase", "score", "source_type", "appears_in", "rank")


def settings_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of both profiles, as text."""
    rows = [(p, f.name, str(getattr(Settings.of(p), f.name))) for p in ("notebook", "backend") for f in fields(Settings) if f.name != "profile"]
    return spark.createDataFrame(rows, "profile string, field string, value string")


def json_round_trip(make, read, *columns: str) -> Callable:  # noqa: ANN001
    """Rows as JSON arrays, a line each, read by a reader of decks."""

    def run(st: Steps) -> DataFrame:
        df, path = make(st), st.space.folder("json")
        df.select(F.concat(F.lit("["), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), F.lit("]")).alias("value")).write.text(path)
        return read(st.spark, path).select(*columns)

    return held(run)


def sunk(make, *columns: str) -> Callable:  # noqa: ANN001
    """A step's table as a sink of step files writes it, read again; columns as SQL."""

    def run(st: Steps) -> DataFrame:
        df, path = make(st), st.space.folder("step")
        writers.write_step(df, path)
        back = st.spark.read.schema(df.schema).json(path)
        return back.selectExpr("coalesce(doc_id, '') as doc_id", *columns)

    return held(run)


def markdown_files(st: Steps) -> DataFrame:
    """A text folder a slide, read again file by file."""
    path = st.space.folder("slides")
    writers.write_markdown(slides(st.spark, st.sf).withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), F.lit("none"))), path)
    back = st.spark.read.schema("value string, doc_id string, slide_id string").text(path, wholetext=True)
    return back.select("doc_id", "slide_id", "value")


def scored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """kp_score_cos over stored vectors: each against the first vector of its label."""
    v = labelled_vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("f"))
    return v.join(first, "label").select("vec_id", F.round(cosine(F.col("v"), F.col("f")), 4).alias("score"))


def resolved_phrases(st: Steps) -> DataFrame:
    """tr_resolve with strings as phrases of slides, one slide for all that begin alike: triples name stripped forms."""
    g = st.strings.where("p <> ''")
    slide = F.left("p", F.lit(2))
    named = g.select(F.lit("d").alias("doc_id"), slide.alias("slide_id"), F.lit(1).alias("page_number"), F.col("p").alias("phrase"))
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("slide_id").orderBy("phrase")))
    raw = named.select(*B.KEY, "rank", P.without_parens(F.lower("phrase")).alias("subject"), F.lit("zzz").alias("object"))
    return TR.resolved(raw, named).select("slide_id", "rank", "subject")


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """tr_evidence with stored vectors as evidence and the first of a label as its slide."""
    v = labelled_vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("f"))
    e = v.join(first, "label").withColumn("evidence", F.lit("x")).withColumn("fallback", F.col("vec_id") % 2 == 0)
    return e.where(TR.evidence_holds(cosine(F.col("v"), F.col("f")), F.col("fallback"), Settings(evidence_cosine=0.3, evidence_cosine_fallback=0.15))).select("vec_id")


def paired(st: Steps) -> DataFrame:
    """Normalised triples with a reversed twin each, so that pairs repeat and synonyms meet."""
    n = TR.normalized(st.raw).select(*B.KEY, "ord", "subject", "object", "confidence")
    back = n.select(*B.KEY, (F.col("ord") + 1000).alias("ord"), F.col("object").alias("subject"), F.concat("subject", F.lit(" of it")).alias("object"), "confidence")
    again = n.select(*B.KEY, (F.col("ord") + 2000).alias("ord"), "subject", "object", (F.col("confidence") + F.lit(0.01) * (F.col("ord") % 3 - 1)).alias("confidence"))
    return st.space.table(n.unionByName(back).unionByName(again).where("subject <> object"), "paired")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to buckets, repetition filter, clean text, lexicon keyphrases, the best of each slide."""
    s = slides(spark, sf).drop("lang")
    return K.keyphrases(B.bucketize(s), lexicon(spark, sf))
