"""Keyphrase operators: slide gate, text building, recognizers, scoring, source types, deduplication, limits, statistics.

Recognition and embedding are seams (see lectern.sources.backends); the operators here work on what those return:
candidates (KEY, phrase, score, label, ord), embeddings of distinct strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import lines as L
from lectern.functions import phrases as P
from lectern.functions.text import SPACE, at_most, n_words, strip, words
from lectern.functions.vectors import cosine
from lectern.operators.buckets import KEY
from lectern.plans.fold import greedy_keep
from lectern.plans.stage import Workspace
from lectern.schema import BUCKETS
from lectern.settings import Settings
from lectern.sources.backends import embed, embed_texts, hashed_bag

Encoder = Callable[[list[str]], list[list[float]]]

BREAK = r"<br\s*/?>"
#: A word, and in its group what is left of it without punctuation at its edges.
TRIMMED = rf"(?=[^{SPACE}])[^\p{{L}}\p{{N}}{SPACE}]*+((?:[\p{{L}}\p{{N}}](?:[^{SPACE}]*[\p{{L}}\p{{N}}])?)?)[^{SPACE}]*+"
#: Stop words and bars that stand alone, where all white space is of ASCII.
STOPS = r"(?<!\S)(?:\||" + "|".join(P.STOP_WORDS) + r")(?!\S)"


def toc_slide() -> Column:
    """First heading names a contents slide, or bullets alone, short ones, with under 40 words."""
    # lower case is never shorter, so what is longer than all of them is none of them
    first = strip(F.get("headings", F.lit(0)))
    listed = F.coalesce((F.length(first) <= max(map(len, P.TOC_HEADINGS))) & F.lower(first).isin(*P.TOC_HEADINGS), F.lit(False))
    bare = (F.size("body_text") == 0) & (F.size("table_cells") == 0) & (F.size("captions") == 0) & (F.size("bullets") > 0)
    total = F.aggregate("bullets", F.lit(0).cast("bigint"), lambda s, b: s + n_words(b))
    return listed | (bare & (total / F.greatest(F.size("bullets"), F.lit(1)) <= 5) & (n_words(F.col("clean_text")) < 40))


def pedagogical() -> Column:
    n = n_words(F.col("clean_text"))
    return ~((F.col("page_number") == 1) & (n < 40)) & (n >= 8) & ~toc_slide()


def extraction_text(profile: str = "notebook") -> Column:
    """The text that recognizers see: headings, a stop, and the rest; tables alone as `key: value.` pairs (notebook)."""
    heading = F.array_join("headings", " ")
    if profile == "backend":
        prose = F.filter(F.concat("body_text", "bullets"), lambda x: ~L.code(strip(x), "backend"))
        rest = F.array_join(F.concat(prose, F.col("captions"), F.col("table_cells")), " ")
        return F.when((heading != "") & (rest != ""), strip(F.concat(heading, F.lit(". "), rest))).otherwise(F.concat(heading, rest))
    cell = lambda c: strip(F.regexp_replace(c, BREAK, " "))
    n = F.size("table_cells")
    starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    pair = F.transform(starts, lambda i: F.struct(cell(F.get("table_cells", i)).alias("k"), cell(F.get("table_cells", i + 1)).alias("v")))
    good = F.filter(pair, lambda p: (p["k"] != "") & (p["v"] != "") & ~L.noise(p["k"]) & ~L.noise(p["v"]))
    pairs = F.transform(good, lambda p: F.concat(p["k"], F.lit(": "), p["v"], F.lit(".")))
    odd = F.when(n % 2 == 1, F.array(cell(F.get("table_cells", n - 1)))).otherwise(F.array().cast("array<string>"))
    alone = (n > 0) & (F.size("bullets") == 0) & (F.size("body_text") == 0)
    table = F.when(alone, F.array_join(F.concat(pairs, odd), " ")).otherwise(F.array_join(F.transform("table_cells", lambda c: F.regexp_replace(c, BREAK, " ")), " "))
    prose = F.array_join(F.concat("body_text", "bullets", "captions"), " ")
    rest = F.when(table != "", strip(F.concat(prose, F.lit(" "), table))).otherwise(prose)
    joined = F.when((heading != "") & (rest != ""), strip(F.concat(heading, F.lit(". "), rest))).when(heading != "", heading).otherwise(rest)
    return strip(F.regexp_replace(F.regexp_replace(joined, "<[^>]+>", " "), r"\s{2,}", " "))


def _numbered(longest: int, k: int):  # noqa: ANN202
    return lambda x, i: F.struct((i * longest + k).alias("ord"), x.alias("phrase"))


def ngrams(w: Column, longest: int = 4, sizes: tuple[int, ...] | None = None) -> Column:
    """Runs of 1 to `longest` of the words w, or of the sizes named, as structs (ord, phrase). Each length from the one
    below, so linear in w."""
    level = w
    out = []
    for k in range(1, max(sizes or (longest,)) + 1):
        if k > 1:
            level = F.zip_with(F.slice(level, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), F.slice(w, F.lit(k), F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
        if sizes is None or k in sizes:
            out.append(F.transform(level, _numbered(longest, k)))
    return F.concat(*out) if len(out) > 1 else out[0]


def grams_of(slides: DataFrame, text: str, longest: int = 4, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """KEY, ord, phrase of the lower-cased text, words without punctuation at their edges."""
    w = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TRIMMED), F.lit(1))
    # the words are a column of their own below a generator, so they are made once a slide
    once = slides.select(*KEY, F.explode(F.array(w)).alias("w"))
    return once.select(*KEY, F.inline(ngrams(F.col("w"), longest, sizes))).where(F.trim(F.col("phrase")) != "")


def recognize(slides: DataFrame, lexicon: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """KEY, ord, phrase, label, score: the lexicon recognizer. lexicon: (phrase, label, score). An n-gram join; Spark
    broadcasts the lexicon where its size allows. Words hold no blanks, so an n-gram has one blank less than words, and
    only sizes that the lexicon's phrases have by their blanks can be found: the others aren't made."""
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    sizes = [r[0] for r in lexicon.select(size.alias("n")).where(F.col("n") <= 4).distinct().collect()]
    grams = grams_of(slides, text, sizes=tuple(sizes) or (1,))
    return grams.join(lexicon, "phrase").where(F.col("score") >= settings.recognizer_threshold).select(*KEY, "ord", "phrase", "label", "score")


def noun_chunks(slides: DataFrame, text: str = "text") -> DataFrame:
    """KEY, ord, chunk: the offline splitter. Stretches between stop words and punctuation, of up to four words, cleaned,
    not led by a digit, of three characters at least, first occurrence each."""
    t = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\s_-]+", " | ")
    parts = F.regexp_extract_all(F.regexp_replace(t, STOPS, "|"), F.lit(r"[^\s|](?:[^|]*[^\s|])?"), F.lit(0))
    chunks = slides.select(*KEY, F.posexplode(parts).alias("ord", "raw")).where(at_most(F.col("raw"), 4))
    # a generator again, so that a chunk is cleaned once and not in each test of it
    chunks = chunks.select(*KEY, "ord", F.explode(F.array(P.clean(F.regexp_replace("raw", r"\s+", " ")))).alias("chunk"))
    chunks = chunks.where((F.length("chunk") >= 3) & ~F.col("chunk").rlike(r"^\d"))
    return chunks.groupBy(*KEY, "chunk").agg(F.min("ord").alias("ord"))


def best_scores(candidates: DataFrame) -> DataFrame:
    """The best score of each valid phrase of a slide, at its first place."""
    p = strip(F.lower(F.col("phrase")))
    return candidates.withColumn("phrase", p).where(P.valid(F.col("phrase"))).groupBy(*KEY, "phrase").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


def source_type(p: Column, low: Callable[[Column], Column] = F.lower, of: Callable[[str], Column] = F.col) -> Column:
    """The first bucket that holds the phrase. low: what lower-cases a block, where that isn't done yet. of: the bucket's column."""
    held = lambda bucket: F.exists(of(bucket), lambda x: F.contains(low(x), p))
    return F.when(held("headings"), "heading").when(held("bullets"), "bullet").when(held("table_cells"), "table").when(held("captions"), "caption").otherwise("body")


def boosted(score: Column, source: Column, settings: Settings = Settings()) -> Column:
    up = F.least(score + settings.heading_boost, F.lit(1.0))
    return F.bround(F.when(source == "heading", up).otherwise(score), 4)


def sentences(text: Column) -> Column:
    """The sentences of a text, as structs of a sentence and its lower case."""
    return F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))


def first_holding(p: Column, ends: Column, text: Column) -> Column:
    """The first of the text's sentences that holds the phrase, else the first 200 characters."""
    return F.coalesce(F.get(F.filter(ends, lambda e: F.contains(e["low"], p)), F.lit(0))["s"], F.left(text, F.lit(200)))


def sentence_of(p: Column, text: Column) -> Column:
    return first_holding(p, sentences(text), text)


def top_candidates(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best candidates of each slide, then those with enough score. Spark limits ranks before the shuffle."""
    rank = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "ord")
    top = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= settings.candidate_top)
    return top.where(F.col("score") >= settings.candidate_score).drop("rank")


def linguistic(p: Column) -> Column:
    """Not stop words alone, three characters at least."""
    return (F.length(p) >= 3) & F.exists(words(p), lambda w: ~w.isin(*P.STOP_WORDS))


def in_chunks(phrases: DataFrame, chunks: DataFrame) -> DataFrame:
    return phrases.join(chunks.select(*KEY, F.col("chunk").alias("phrase")).distinct(), [*KEY, "phrase"], "left_semi")


def dedup_phrases(phrases: DataFrame, vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per slide, by falling score: phrases whose embedding is not too near to a kept one's. vectors: (phrase, v).

    Each distinct string is embedded once and joined back; phrases without a vector are kept.
    """
    x = phrases.join(vectors, "phrase", "left")
    items = x.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", "phrase", F.col("v").cast("array<double>").alias("v")))).alias("items"))
    clash = lambda k, y: F.coalesce(cosine(k["v"], y["v"]) >= settings.phrase_dedup_cosine, F.lit(False))
    kept = greedy_keep(F.col("items"), "struct<neg:double,ord:int,phrase:string,v:array<double>>", clash)
    kept = items.select(*KEY, F.inline(kept)).select(*KEY, "phrase")
    return phrases.join(kept, [*KEY, "phrase"], "left_semi")


def limit(phrases: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rank = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "ord")
    return phrases.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= settings.keyphrase_max)


def needs_fallback(phrases: DataFrame, slides: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Slides with too few phrases and enough words, before any model is called."""
    n = phrases.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    found = slides.join(n, list(KEY), "left").where((F.coalesce("n", F.lit(0)) <= settings.fallback_max_phrases) & (n_words(F.col(text)) >= settings.fallback_min_words))
    return found.drop("n")


def with_fallback(phrases: DataFrame, slides: DataFrame, offered: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """phrases with those of poor slides replaced by `offered` (KEY, phrase, ord), even by none, at the fixed score."""
    poor = needs_fallback(phrases, slides, text, settings).select(*KEY)
    kept = phrases.join(poor, list(KEY), "left_anti").select(*KEY, "phrase", "score", "ord")
    more = offered.join(poor, list(KEY), "left_semi").select(*KEY, strip(F.lower(F.col("phrase"))).alias("phrase"), F.lit(settings.fallback_score).alias("score"), "ord")
    return kept.unionByName(more.where(P.valid(F.col("phrase"))))


def label_distribution(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def phrase_stats(phrases: DataFrame, slides: DataFrame) -> DataFrame:
    """doc_id, n_phrases, n_slides, mean a slide."""
    a = phrases.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_phrases"))
    b = slides.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_slides"))
    return b.join(a, "doc_id", "left").select("doc_id", F.coalesce("n_phrases", F.lit(0)).alias("n_phrases"), "n_slides", F.bround(F.coalesce("n_phrases", F.lit(0)) / F.col("n_slides"), 4).alias("mean_phrases"))


def top_phrases(phrases: DataFrame, n: int = 3) -> DataFrame:
    """KEY, n_phrases, top: the first n ranked phrases of each slide that has any."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), F.lit(1), F.lit(n))
    return phrases.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_phrases"), F.transform(best, lambda p: p["phrase"]).alias("top"))


def place(phrases: DataFrame, slides: DataFrame, settings: Settings | None = None) -> DataFrame:
    """KEY, phrase, score, source_type, appears_in, ord; scores in headings boosted where settings are given. A slide
    meets the list of its phrases, so it is shuffled as it is; blocks are lower-cased and texts cut into sentences once
    a slide, below a generator, not once a phrase."""
    mine = phrases.groupBy(*KEY).agg(F.collect_list(F.struct("phrase", "score", "ord")).alias("ps"))
    once = F.struct(*[F.transform(b, F.lower).alias(b) for b in BUCKETS], F.left("clean_text", F.lit(200)).alias("head"), sentences(F.col("clean_text")).alias("ends"))
    both = mine.join(slides.select(*KEY, *BUCKETS, "clean_text"), list(KEY)).select(*KEY, "ps", F.explode(F.array(once)).alias("x"))
    x = F.col("x")

    def placed(p: Column) -> Column:
        kind = source_type(p["phrase"], lambda block: block, lambda bucket: x[bucket])
        return F.struct(p["phrase"].alias("phrase"), p["score"].alias("score"), p["ord"].alias("ord"), kind.alias("source_type"), first_holding(p["phrase"], x["ends"], x["head"]).alias("appears_in"))

    out = both.select(*KEY, F.inline(F.transform("ps", placed)))
    score = F.col("score") if settings is None else boosted(F.col("score"), F.col("source_type"), settings)
    return out.select(*KEY, "phrase", score.alias("score"), "source_type", "appears_in", "ord")


def keyphrases(content: DataFrame, lexicon: DataFrame, settings: Settings = Settings(), encode: Encoder | None = None, offered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Step 3 whole with the lexicon recognizer: gate, text, recognition, best scores, boost, sentences, dedup, fallback, limit.

    encode: an embedder, without which near-equal phrases stay. offered: a model for poor slides, from slides with
    their text to (KEY, phrase, ord); its phrases replace the slide's, with the fixed score and no boost.
    """
    gate = content.where(pedagogical()).withColumn("text", extraction_text(settings.profile))
    return from_candidates(recognize(gate, lexicon, settings=settings), gate, settings, encode, offered)


def from_candidates(candidates: DataFrame, gate: DataFrame, settings: Settings = Settings(), encode: Encoder | None = None, offered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Step 3 from a recognizer's candidates on, for slides that passed the gate, with their text. Candidates that are a
    table keep Spark from testing the validity of every n-gram below the recognizer's join."""
    found = best_scores(candidates)
    if encode is not None:
        found = place(found, gate, settings)
        found = dedup_phrases(found, embed(found, "phrase", encode).select("phrase", "v"), settings)
    if offered is None:
        return limit(found if encode is not None else place(found, gate, settings), settings)
    # without an embedder phrases are as many before they are placed, and those of poor slides needn't be
    poor = needs_fallback(found, gate, settings=settings)
    more = offered(poor).select(*KEY, strip(F.lower(F.col("phrase"))).alias("phrase"), F.lit(settings.fallback_score).alias("score"), "ord")
    more = place(more.where(P.valid(F.col("phrase"))), poor)
    rich = found.join(poor.select(*KEY), list(KEY), "left_anti")
    return limit((rich if encode is not None else place(rich, gate, settings)).unionByName(more), settings)


def ranked_chunks(content: DataFrame, settings: Settings = Settings.of("backend"), encode: Encoder = hashed_bag, space: Workspace | None = None) -> DataFrame:
    """Step 3 whole by the older order: chunks scored against their slide's text, the best of them, linguistic and chunk
    tests, source types, boost, dedup. Chunks that the embedder knows nothing of score nothing and go. What comes here
    to the chunk test are the slide's chunks, so all pass it. Texts are embedded once a text and met by slide, not
    carried along with each chunk. space: where what several steps read is written once."""
    once = space.table if space is not None else lambda df, tag: df
    slides = once(content.withColumn("text", extraction_text("backend")).where("text <> ''").select(*KEY, *BUCKETS, "clean_text", "text"), "slides")
    offered = once(noun_chunks(slides), "offered")
    e = embed(offered, "chunk", encode).withColumnRenamed("v", "cv")
    t = embed_texts(slides.join(offered.select(*KEY).distinct(), list(KEY), "left_semi"), KEY, "text", encode).withColumnRenamed("v", "tv")
    scored = offered.join(e, "chunk").join(t, list(KEY)).select(*KEY, F.col("chunk").alias("phrase"), cosine(F.col("cv"), F.col("tv")).alias("score"), "ord")
    good = top_candidates(scored.where("score is not null"), settings).where(linguistic(F.col("phrase")))
    placed = once(place(good, slides, settings), "placed")
    placed = dedup_phrases(placed, embed(placed, "phrase", encode), settings)
    rank = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "ord")
    return placed.withColumn("rank", F.row_number().over(rank))
