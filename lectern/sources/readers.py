"""Readers of slides: parsed and preprocessed JSON, PDF through a pluggable parser with a cache, HTML pages, documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators.buckets import repair
from lectern.operators.pages import collapse_blank
from lectern.plans.stage import small_batches
from lectern.schema import SLIDE_CONTENT, SLIDE_MARKDOWN


def stem(path: Column) -> Column:
    """A file's name without folders and extension: the doc_id of an upload."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def parsed_json(spark: SparkSession, path: str, doc_id: str | None = None, lines: bool = False) -> DataFrame:
    """SlideMarkdown from JSON arrays; doc_id is the caller's, else the file's stem. Unknown keys are ignored.

    lines: an array a line, which Spark can split into tasks; else an array a file.
    """
    df = spark.read.schema(SLIDE_MARKDOWN).option("multiLine", not lines).json(path)
    return df.withColumn("doc_id", F.lit(doc_id) if doc_id is not None else stem(F.input_file_name()))


def preprocessed_json(spark: SparkSession, path: str, doc_id: str | None = None, lines: bool = False) -> DataFrame:
    """SlideContent from JSON arrays of buckets, repaired. lines as in parsed_json."""
    df = spark.read.schema(SLIDE_CONTENT).option("multiLine", not lines).json(path)
    return repair(df.withColumn("doc_id", F.lit(doc_id) if doc_id is not None else stem(F.input_file_name())))


#: Characters of pages that a worker gathers before it hands them on, and what a page counts besides its text.
HELD, ROW = 1 << 20, 200
Parser = Callable[[bytes], list[tuple[int, str]]]


def plain_parser(content: bytes) -> list[tuple[int, str]]:
    """The offline default: text with form feeds between pages. Pages count from 0."""
    return list(enumerate(content.decode("utf-8", "replace").split("\f")))


def pdf_pages(files: DataFrame, parser: Parser = plain_parser) -> DataFrame:
    """files (path, content) to doc_id, sha, page_number from 1, raw_markdown: blanks collapsed, empty pages dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "page_number", "markdown"]
        for frame in frames:
            rows, held = [], 0
            for p, c in zip(frame["path"], frame["content"], strict=True):
                for n, text in parser(bytes(c)):
                    rows.append((p, n + 1, text))
                    held += len(text) + ROW
                    if held >= HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    small_batches(files.sparkSession)
    keys = files.select("path", F.sha2("content", 256).alias("sha"))
    pages = files.select("path", "content").mapInPandas(run, "path string, page_number int, markdown string")
    out = pages.join(keys, "path").select(stem(F.col("path")).alias("doc_id"), "sha", "page_number", strip(collapse_blank(F.col("markdown"))).alias("raw_markdown"))
    return out.where("raw_markdown <> ''")


def read_pdf(spark: SparkSession, path: str, parser: Parser = plain_parser, cache: DataFrame | None = None) -> DataFrame:
    """SlideMarkdown of binary files. cache (sha, page_number, raw_markdown): files found there aren't parsed again; their pages come under the file's own doc_id."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if cache is None:
        pages = pdf_pages(files, parser).drop("sha")
    else:
        keyed = files.withColumn("sha", F.sha2("content", 256))
        fresh = pdf_pages(keyed.join(cache.select("sha").distinct(), "sha", "left_anti").select("path", "content"), parser).drop("sha")
        known = keyed.select("path", "sha").join(cache, "sha").select(stem(F.col("path")).alias("doc_id"), "page_number", "raw_markdown")
        pages = fresh.unionByName(known)
    return pages.select(F.format_string("slide_%03d", "page_number").alias("slide_id"), "page_number", "raw_markdown", "doc_id")


HTML_SKIPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
HTML_LEADS = (("h[1-6]", "# "), ("li", "- "), ("footer", "> "), ("p", ""), ("blockquote", "> "))
HTML_BREAKS = r"(?i)<br\s*/?>|</(p|li|h[1-6]|footer|div|tr)\s*>"
HTML_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&amp;", "&"))


def html_markdown(html: Column) -> Column:
    """Headings, list items, paragraphs and footers of an HTML page as markdown lines; scripts, styles and comments out."""
    t = F.regexp_replace(html, HTML_SKIPPED, "")
    for tag, lead in HTML_LEADS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>", f"\n{lead}")
    t = F.regexp_replace(F.regexp_replace(t, HTML_BREAKS, "\n"), r"<[^>]*>", " ")
    for name, char in HTML_ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))
