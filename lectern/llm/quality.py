"""Quality rules with cross-document line frequency.

Base rules count on each whole text: words (`[^\\x20\\x09-\\x0D]+`), their characters, symbols, repeated lines and
words in repeated 3-word windows. The method then looks across documents: lines with a word are normalised (lower
case, digits as 0, white space as one space) and hashed, and for each host (the source) the distinct documents that
hold a line are counted, exact copies of a document as one. A line held by more than
max(`least_docs`, `share` of the host's distinct documents) is removed; a document that keeps less than `keep` of
its words is depleted and rejected. The lines that are left are judged by the quality rules: symbols (at most `symbols`
a word), characters a word (within `word_chars`) and repeated lines (at most `dup_lines` of the lines with a word), so
a menu that goes with the frequent lines doesn't count against its document. The limits are those of the Gopher rules;
scripts without blanks have long words and fail them.

Null texts have no words and fail the base rules; a null source is one host. Repeated rows are judged alike and count
once. A line repeated in a document counts once there but all its words go when it's removed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import cut
from lectern.plans.stage import Workspace

BLANK = " \t\n\r\x0b\x0c"
SYMBOLS = "[#*$%&|<>]"  # as a set of characters: those between the brackets
_DIGITS = re.compile(r"[0-9]+")
#: Of a line: words, their characters, symbols, how often it's in the text, and how often equal to an earlier line.
PARTS = ("words", "chars", "symbols", "n", "again")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split on exactly the six ASCII blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS[1:-1]))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    again = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        place: dict[bytes, int] = {}
        ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
        code = (ids[:-2] * len(place) + ids[1:-1]) * len(place) + ids[2:] if len(place) < 2_000_000 else None
        if code is None:
            seen = Counter(zip(words, words[1:], words[2:], strict=False))
            twice = np.array([seen[w] > 1 for w in zip(words, words[1:], words[2:], strict=False)])
        else:
            _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    return n, chars, symbols, again, repeat


def line_parts(text: str | None) -> dict[int, list[int]]:
    """Hash of each normalised line with a word, to its PARTS in the text, repeats included."""
    out: dict[int, list[int]] = {}
    seen: set[str] = set()
    for line in (text or "").split("\n"):
        words = line.lower().encode().split()
        if words:
            h = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", b" ".join(words).decode("utf-8", "replace"))) - (1 << 63)
            part = out.setdefault(h, [0] * len(PARTS))
            part[0] += len(words)
            part[1] += len(line) - sum(map(line.count, BLANK))
            part[2] += sum(map(line.count, SYMBOLS[1:-1]))
            part[3] += 1
            part[4] += line in seen
            seen.add(line)
    return out


def apply_rules(docs: DataFrame, least_docs: int = 10, share: float = 0.03, keep: float = 0.5, min_words: int = 50, byte_budget: int = 1 << 20, symbols: float = 0.1, word_chars: tuple[float, float] = (3, 10), dup_lines: float = 0.3) -> DataFrame:
    """doc_id, text_hash, the five measures, base_failed, kept_words, kept: a row for each row of docs.

    Texts are read once and never shuffled: only hashes of lines are. The counts by (host, line) combine on the map
    side, so a line of a third of all documents is one row a task; the join of lines to the frequent ones may be
    split by skew handling.
    """
    source = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", host string, text_hash bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", n_lines bigint, lines array<struct<h: bigint, " + ", ".join(f"{p}: int" for p in PARTS) + ">>"
    kind = pa.list_(pa.struct([("h", pa.int64()), *((p, pa.int32()) for p in PARTS)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", byte_budget):
                texts = part.column("text").to_pylist()
                rows = list(zip(*map(measure, texts), strict=True))
                lines = [line_parts(t) for t in texts]
                parts = np.array([x for v in lines for x in v.values()], np.int32).reshape(-1, len(PARTS))
                values = pa.StructArray.from_arrays([pa.array([h for v in lines for h in v], pa.int64()), *(pa.array(x) for x in parts.T.copy())], ["h", *PARTS])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in lines])]), pa.int32())
                cols = [part.column(i) for i in range(3)] + [pa.array(r, pa.int64()) for r in rows] + [pa.array([sum(x[3] for x in v.values()) for v in lines], pa.int64())] + [pa.ListArray.from_arrays(offsets, values).cast(kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "host", "text_hash", *MEASURES, "n_lines", "lines"])

    with Workspace(docs.sparkSession) as space:
        return space.finish(_verdicts(space.table(source.mapInArrow(run, schema), "lines"), least_docs, share, keep, min_words, symbols, word_chars, dup_lines), "judged")


def _verdicts(measured: DataFrame, least_docs: int, share: float, keep: float, min_words: int, symbols: float, word_chars: tuple[float, float], dup_lines: float) -> DataFrame:
    once = measured.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    lines = once.select("host", "text_hash", F.inline("lines"))
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    held = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    often = held.join(sizes, "host").where(F.col("n") > F.greatest(F.lit(float(least_docs)), F.col("n_docs") * share)).select("host", "h")
    gone = lines.join(often, ["host", "h"], "left_semi").groupBy("host", "text_hash").agg(*(F.sum(p).alias(f"gone_{p}") for p in PARTS))
    out = measured.drop("lines").join(gone, ["host", "text_hash"], "left")
    all_ = dict(zip(PARTS, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"), strict=True))
    out = out.select("doc_id", "text_hash", *MEASURES, *((F.col(m) - F.coalesce(f"gone_{p}", F.lit(0))).alias(f"kept_{p}") for p, m in all_.items()))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    few = F.col("kept_words") < keep * F.col("n_words")
    noisy = F.col("kept_symbols") > symbols * F.col("kept_words")
    odd = ~F.col("kept_chars").between(word_chars[0] * F.col("kept_words"), word_chars[1] * F.col("kept_words"))
    again = F.col("kept_again") > dup_lines * F.col("kept_n")
    return out.select("doc_id", "text_hash", *MEASURES, "kept_words", "base_failed", (~F.col("base_failed") & ~few & ~noisy & ~odd & ~again).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept", "kept_words")
