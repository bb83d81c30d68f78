"""From slides to typed buckets: line routing, cross-slide repetition, assembly, loader repairs, statistics.

Routing runs in projections: the branch of a line, its text, then noise and code flags over that one text, so no
expression is repeated from branch to branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import lines as L
from lectern.functions.text import LINE_END, n_words, strip
from lectern.schema import BUCKETS
from lectern.settings import Settings

KEY = ("doc_id", "slide_id", "page_number")
BULLET_NB, BULLET_BE = r"^[-*¢—]\s+", r"^[-*]\s+"
NOT_BULLET = ("**", "*a", "*b", "*c")
OCR_BULLET = r"^[-*+¢—>]\s+"
OCR_RULE = r"^\|[\s\-|]+\|$"
BULLET_LEAD = r"^[\s◮•▶▪■►▸*\-–—]+"


def lines_of(slides: DataFrame) -> DataFrame:
    """KEY, line_no, s: the stripped lines that aren't blank."""
    out = slides.select(*KEY, F.posexplode(F.split("raw_markdown", LINE_END, -1)).alias("line_no", "line"))
    return out.withColumn("s", strip(F.col("line"))).where("s <> ''").drop("line")


def with_fences(lines: DataFrame) -> DataFrame:
    """lines with is_fence and in_fence: the parity of fence lines before, within the slide."""
    before = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("is_fence", F.col("s").startswith("```"))
    return lines.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)


def _starts(s: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | s.startswith(h)
    return out


def route_notebook(lines: DataFrame) -> DataFrame:
    """KEY, line_no, s, kind, bucket, items, ocr. bucket is `dropped` for noise, rules and headers, `fence` for fences."""
    s = F.col("s")
    quoted = strip(F.regexp_replace(s, r"^>\s*", ""))
    lines = with_fences(lines)
    kind = (
        F.when(F.col("is_fence"), "fence")
        .when(F.col("in_fence"), F.when(L.prose_label(s), "fence_label").otherwise("fence_code"))
        .when(s.startswith("#"), "heading")
        .when(s.startswith(">"), F.when(quoted.startswith("OCR:"), "ocr").otherwise("caption"))
        .when(s.rlike(BULLET_NB) & ~_starts(s, NOT_BULLET), "bullet")
        .when(s.rlike(L.DINGBAT_LED), "beamer")
        .when(s.startswith("|") & s.endswith("|"), "table")
        .otherwise("body")
    )
    lines = lines.withColumn("kind", kind)
    k = F.col("kind")
    raw = (
        F.when(k == "fence_label", L.unbulleted(s))
        .when(k == "heading", F.regexp_replace(s, r"^#+\s*", ""))
        .when(k == "caption", quoted)
        .when(k == "ocr", strip(F.substring(quoted, 5, 1 << 30)))
        .when(k == "bullet", F.regexp_replace(s, BULLET_NB, ""))
        .when(k == "beamer", F.regexp_replace(s, L.BULLET, ""))
        .otherwise(s)
    )
    lines = lines.withColumn("raw", raw)
    plain = k.isin("fence_code", "ocr", "table", "fence")
    lines = lines.withColumn("t", F.when(plain, F.col("raw")).otherwise(L.strip_inline(F.col("raw"))))
    lines = lines.withColumn("t", F.when(k == "beamer", strip(F.regexp_replace("t", L.BULLET, ""))).otherwise(F.col("t")))
    t = F.col("t")
    lines = lines.withColumn("bad", (t == "") | L.noise(t)).withColumn("is_code", ~F.col("bad") & k.isin("ocr", "bullet", "beamer", "body") & L.code(t))
    lines = lines.withColumn("bad", F.col("bad") | ((k == "ocr") & L.ocr_noise(t)))
    # OCR lines are classified anew
    sub = F.when(F.col("is_code"), "code_lines").when(t.startswith("#"), "headings").when(t.rlike(OCR_BULLET), "bullets").when(t.startswith("|") & t.endswith("|"), "table_cells").otherwise("body_text")
    bucket = (
        F.when(k == "fence", "fence")
        .when(k == "table", "table_cells")
        .when(F.col("bad"), "dropped")
        .when(k == "ocr", sub)
        .when(k.isin("fence_code") | F.col("is_code"), "code_lines")
        .when(k == "heading", "headings")
        .when(k == "caption", "captions")
        .when(k == "body", "body_text")
        .otherwise("bullets")
    )
    lines = lines.withColumn("bucket", bucket)
    b = F.col("bucket")
    ocr_text = F.when(b == "headings", strip(F.regexp_replace("t", r"^#+\s*", ""))).when(b == "bullets", strip(F.regexp_replace("t", L.BULLET, ""))).otherwise(t)
    one = F.filter(F.array(F.when(k == "ocr", ocr_text).otherwise(t)), lambda x: x != "")
    lines = lines.withColumn("row", F.when(k == "table", F.transform(L.cells(s), L.strip_inline)))
    row = F.col("row")
    table = F.when(L.separator_row(row) | L.header_row(row), F.array().cast("array<string>")).otherwise(F.filter(row, lambda c: (c != "") & ~L.noise(c)))
    ocr_table = F.when(t.rlike(OCR_RULE), F.array().cast("array<string>")).otherwise(L.cells(t))
    items = F.when(b.isin("dropped", "fence"), F.array().cast("array<string>")).when(k == "table", table).when((k == "ocr") & (b == "table_cells"), ocr_table).otherwise(one)
    return lines.withColumn("items", items).select(*KEY, "line_no", "s", "kind", "bucket", "items", (k == "ocr").alias("ocr"))


def route_backend(lines: DataFrame) -> DataFrame:
    """As route_notebook, by the older order: no fences, no OCR, no code test on bullets, noise after routing."""
    s = F.col("s")
    marked = (s.startswith("-") | s.startswith("*")) & ~_starts(s, NOT_BULLET)
    kind = (
        F.when(s.startswith("#"), "heading")
        .when(marked, F.when(s.rlike(BULLET_BE), "bullet").otherwise("marked"))
        .when(s.startswith("|") & s.endswith("|"), "table")
        .when(s.startswith(">"), "caption")
        .otherwise("body")
    )
    lines = lines.withColumn("kind", kind)
    k = F.col("kind")
    raw = F.when(k == "heading", F.regexp_replace(s, r"^#+\s*", "")).when(k == "bullet", F.regexp_replace(s, BULLET_BE, "")).when(k == "caption", F.regexp_replace(s, r"^>\s*", "")).otherwise(s)
    lines = lines.withColumn("raw", raw).withColumn("t", F.when(k == "table", F.col("raw")).otherwise(L.strip_inline(F.col("raw"))))
    t = F.col("t")
    lines = lines.withColumn("bad", (t == "") | L.noise(t, "backend")).withColumn("is_code", (k == "body") & L.code(t, "backend"))
    bucket = F.when(k == "table", "table_cells").when(F.col("bad"), "dropped").when(F.col("is_code"), "code_lines").when(k == "heading", "headings").when(k == "bullet", "bullets").when(k == "caption", "captions").otherwise("body_text")
    lines = lines.withColumn("bucket", bucket)
    lines = lines.withColumn("row", F.when(k == "table", F.transform(L.cells(s), L.strip_inline)))
    row = F.col("row")
    none = F.array().cast("array<string>")
    table = F.when(L.separator_row(row), none).otherwise(F.filter(row, lambda c: (c != "") & ~L.noise(c, "backend")))
    items = F.when(k == "table", table).when(F.col("bucket") == "dropped", none).otherwise(F.array("t"))
    return lines.withColumn("items", items).select(*KEY, "line_no", "s", "kind", "bucket", "items", F.lit(False).alias("ocr"))


def collect(routed: DataFrame, slides: DataFrame, profile: str = "notebook") -> DataFrame:
    """SlideContent: arrays in line order. Slides without lines have empty buckets."""
    parts = routed.select(*KEY, "bucket", "ocr", "kind", F.struct("line_no", "items").alias("x"))
    names = (*BUCKETS, "code_lines")
    text = {b: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("x")))), lambda x: x["items"])).alias(b) for b in names}
    content = parts.groupBy(*KEY).agg(*text.values(), F.bool_or("ocr").alias("ocr_applied"))
    out = slides.select(*KEY).join(content, list(KEY), "left")
    none = F.array().cast("array<string>")
    out = out.select(*KEY, *[F.coalesce(F.col(b), none).alias(b) for b in names], F.coalesce("ocr_applied", F.lit(False)).alias("ocr_applied"))
    return out.withColumn("heading_phrases", F.col("headings"))


def cross_slide_noise(content: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, block): blocks on more than the share of a document's slides, if it has enough slides."""
    blocks = content.select("doc_id", "slide_id", F.explode(F.array_distinct(F.concat(*BUCKETS if settings.profile == "notebook" else (*BUCKETS, "code_lines")))).alias("block"))
    held = blocks.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"))
    slides = content.groupBy("doc_id").agg(F.count(F.lit(1)).alias("slides")).where(F.col("slides") >= settings.repetition_min_slides)
    return held.join(slides, "doc_id").where(F.col("n") > F.col("slides") * settings.repetition_share).select("doc_id", "block")


def cross_slide_filter(content: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """content without repeated blocks.

    A document's repeated blocks are one bounded list: each is on more than the share of its slides, so there are
    fewer than a slide's blocks divided by the share. The list meets the slides, and their arrays are filtered in place.
    """
    backend = settings.profile == "backend"
    names = (*BUCKETS, "code_lines") if backend else BUCKETS
    noise = cross_slide_noise(content, settings).groupBy("doc_id").agg(F.collect_list("block").alias("__noise"))
    out = content.join(noise, "doc_id", "left")
    kept = lambda b: F.when(F.col("__noise").isNull(), F.col(b)).otherwise(F.filter(b, lambda x: ~F.array_contains("__noise", x)))
    out = out.withColumns({b: kept(b) for b in names}).select(*content.columns)
    return out.withColumn("heading_phrases", F.col("headings")) if backend else out


def clean_text(profile: str = "notebook") -> Column:
    joined = F.array_join(F.concat(*BUCKETS), " ")
    return strip(joined) if profile == "notebook" else joined


def assemble(content: DataFrame, profile: str = "notebook") -> DataFrame:
    return content.withColumn("clean_text", clean_text(profile))


def has_content(profile: str = "notebook") -> Column:
    t = strip(F.col("clean_text"))
    return t != "" if profile == "notebook" else (F.size("bullets") >= 2) | (F.length(t) > 200)


def stats(content: DataFrame) -> DataFrame:
    """A row a slide: bucket lengths, clean_text length."""
    n = {"n_headings": "headings", "n_bullets": "bullets", "n_table_cells": "table_cells", "n_captions": "captions", "n_body": "body_text"}
    return content.select(*KEY, *[F.size(v).cast("bigint").alias(k) for k, v in n.items()], F.length("clean_text").cast("bigint").alias("clean_text_len"))


def deck_stats(content: DataFrame) -> DataFrame:
    return content.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_slides"), F.count_if(has_content()).alias("n_content"), F.count_if("ocr_applied").alias("n_ocr"), F.count_if(F.size("bullets") > 0).alias("n_bullet_slides"))


def repair(content: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Loader repairs of pre-bucketed slides: page tags out of body, markers off bullets, headings out of body, code
    routed, clean_text rebuilt. Of several headings that begin a body line the longest goes."""
    none = F.array().cast("array<string>")
    content = content.withColumns({b: F.coalesce(F.col(b), none) for b in (*BUCKETS, "heading_phrases")})
    content = content.withColumn("heads", F.array_sort(F.array_distinct(F.transform("headings", lambda h: strip(F.lower(h)))), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)))

    def unheaded(x: Column) -> Column:
        low = strip(F.lower(x))
        head = F.get(F.filter(F.col("heads"), lambda h: low.startswith(F.concat(h, F.lit(" "))) | low.startswith(F.concat(h, F.lit("\t")))), F.lit(0))
        return F.when(head.isNull(), x).otherwise(strip(F.substr(x, F.length(head) + 1)))

    body = F.filter("body_text", lambda x: ~strip(x).rlike(r"^\{\d+\}$") & ~F.array_contains(F.col("heads"), strip(F.lower(x))))
    content = content.withColumn("kept", F.filter(F.transform(body, unheaded), lambda x: x != ""))
    bullets = F.filter(F.transform("bullets", lambda x: strip(F.regexp_replace(x, BULLET_LEAD, ""))), lambda x: x != "")
    is_code = lambda x: L.code(strip(x), "backend")
    content = content.withColumns({"bullets": bullets, "code_lines": F.filter("kept", is_code), "body_text": F.filter("kept", lambda x: ~is_code(x)), "ocr_applied": F.lit(False)})
    if doc_id is not None:
        content = content.withColumn("doc_id", F.lit(doc_id))
    return assemble(content.drop("heads", "kept"), "backend")


def bucketize(slides: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Step 2 whole: routing, repetition filter, assembly."""
    lines = lines_of(slides)
    routed = route_notebook(lines) if settings.profile == "notebook" else route_backend(lines)
    return assemble(cross_slide_filter(collect(routed, slides, settings.profile), settings), settings.profile)


def word_count() -> Column:
    return n_words(F.col("clean_text"))
