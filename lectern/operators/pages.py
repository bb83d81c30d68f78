"""Page operators: split, blank collapse, emptiness, word sets, near-duplicate pages, numbering, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.plans.fold import greedy_runs
from lectern.settings import Settings

SEPARATOR = "-" * 48


def split_pages(converted: DataFrame, separator: str = SEPARATOR, text: str = "markdown") -> DataFrame:
    """One row a page: page_number from 1, raw_markdown stripped. With n_pages, trailing pages come as empty ones."""
    parts = F.split(F.col(text), rf"\Q{separator}\E", -1)
    if "n_pages" in converted.columns:
        lacking = F.greatest(F.col("n_pages") - F.size(parts), F.lit(0))
        parts = F.slice(F.concat(parts, F.array_repeat(F.lit(""), lacking.cast("int"))), F.lit(1), F.greatest(F.col("n_pages").cast("int"), F.lit(0)))
    return converted.select("doc_id", F.posexplode(parts).alias("pos", "page")).select("doc_id", (F.col("pos") + 1).alias("page_number"), strip(F.col("page")).alias("raw_markdown"))


def collapse_blank(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def is_empty(c: Column) -> Column:
    """Fewer than 10 characters once images, slide tags and markup characters are gone."""
    t = F.regexp_replace(strip(c), r"!\[.*?\]\(.*?\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\{\d+\}", ""), r"[#>\-*|]", "")
    return F.length(strip(t)) < 10


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), " +", -1), lambda w: w != ""))


def ocr_prefixed(c: Column) -> Column:
    """Recognised text as quoted OCR lines; blank lines vanish."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> OCR: "), x)), "\n")


def drop_near_duplicates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages of each doc_id in order, without those too like one of the last accepted ones.

    Only numbers and word sets (as 64-bit hashes) are dealt, by stretches of a deck; the markdown is joined back. A null raw_markdown
    has no words.
    """
    least, jaccard = settings.near_dup_min_words, settings.near_dup_jaccard

    def clash(kept: set, page: set) -> bool:
        return len(page) >= least and len(kept) > 0 and len(kept & page) / max(len(kept | page), 1) >= jaccard

    hashed = F.transform(word_set(F.col("raw_markdown")), lambda w: F.xxhash64(w))
    numbers = greedy_runs(pages.select("doc_id", "page_number", hashed.alias("w")), "doc_id", "page_number", "w", settings.near_dup_window, clash)
    return pages.join(numbers, ["doc_id", "page_number"], "left_semi")


def emit(pages: DataFrame) -> DataFrame:
    """Slides of pages that aren't blank, numbered by page with gaps."""
    t = collapse_blank(F.col("raw_markdown"))
    return pages.where(strip(F.col("raw_markdown")) != "").select(F.format_string("slide_%03d", "page_number").alias("slide_id"), "page_number", t.alias("raw_markdown"), "doc_id")


def counts(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_empty, n_ocr, n_kept, n_skipped."""
    raw = F.col("raw_markdown")
    a = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(is_empty(raw)).alias("n_empty"), F.count_if(raw.startswith("> OCR:")).alias("n_ocr"))
    b = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(b, "doc_id", "left").select("doc_id", "n_pages", "n_empty", "n_ocr", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_pages") - F.coalesce("n_kept", F.lit(0))).alias("n_skipped"))


def parse_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Step 1 after conversion: near-duplicate pages out, blank pages out, the rest numbered."""
    return emit(drop_near_duplicates(pages.withColumn("page_number", F.col("page_number").cast("int")), settings))
