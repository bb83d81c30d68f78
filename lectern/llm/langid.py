"""Language identification by segmentation-marginalised unigrams.

Over the pieces of a fixed public vocabulary each language has piece probabilities. A word's probability in a
language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over
its words. Words are runs of letters, lower-cased, with the vocabulary's word mark in front; every word of the whole
text counts.

The model is fitted by expectation maximisation on a bounded sample: at most `sample_docs` documents a language (the
first by a hash of doc_id) and `sample_chars` characters of each. Everything else reads whole texts.

Null texts and texts without a letter give `und` with score 0. Ties go to the language first by code point. Repeated
rows give repeated results. With no labelled row to learn from every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.batches import cut
from lectern.plans.stage import small_batches

WORDS = regex.compile(r"\p{L}+")
ROUGH = re.compile(r"[^\W\d_]+")  # the same and numbers that are no digits, but fast
LONGEST_PIECE = 16
UNSEEN = 1e-7
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Of this Python worker: scores of words met in earlier tasks under the same model; one model at a time.
_WORKER: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's pieces of letters, found by an open-addressed table over hashes of code points."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.pieces = sorted(p for p in found if 0 < len(p) <= LONGEST_PIECE and p.replace("▁", "").isalpha() or p == "▁")
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = ((h + ord(c) + 1) * int(_MIX)) % (1 << 64)
                h ^= h >> 29
            self.hashes[i] = h
            at = h >> (64 - self.bits)
            while self.table[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.table[at] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or the number of pieces where there is none."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), len(self.pieces), np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            got = self.table[at[open_]]
            live = got >= 0
            open_, got = open_[live], got[live]
            hit = self.hashes[got] == h[open_]
            out[open_[hit]] = got[hit]
            open_ = open_[~hit]
            at[open_] = (at[open_] + 1) % (1 << self.bits)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def _grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of any length, zero-padded, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    grid = np.zeros((len(words), int(lengths.max())), np.uint32)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = flat
    return grid, lengths


def _spans(grid: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece or none): every span of at most LONGEST_PIECE characters that is a piece or one letter."""
    n = grid.shape[1]
    for start in range(n):
        h = np.zeros(len(grid), np.uint64)
        for end in range(start + 1, min(n, start + LONGEST_PIECE) + 1):
            h = (h + grid[:, end - 1].astype(np.uint64) + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
            rows = np.flatnonzero(lengths >= end)
            if not len(rows):
                break
            got = pieces.find(h[rows])
            if end > start + 1:
                rows, got = rows[got < len(pieces.pieces)], got[got < len(pieces.pieces)]
            if len(rows):
                yield start, end, rows, got


def _scaled(x: np.ndarray, at: int, lo: int, hi: int, log: np.ndarray) -> None:
    """Divide x[lo:hi] by x[at], for each word and language, and add its logarithm to log."""
    scale = np.where(x[at] > 0, x[at], 1.0)
    x[lo:hi] /= scale
    log += np.log(scale)


def _long(word: str, probs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """forward() of one word of any length: a ring of sums, and the pieces of a stretch of places at a time."""
    n, width = len(word), LONGEST_PIECE
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    ring = np.zeros((width, probs.shape[1]))  # ring[e % width]: the sum up to place e
    ring[0] = 1.0
    log = np.zeros(probs.shape[1])
    for lo in range(0, n, 1 << 14):
        ends = np.arange(lo + 1, min(n, lo + (1 << 14)) + 1)
        found = np.full((len(ends), width), -1, np.int64)  # by length less one: the piece that ends there
        for size in range(1, width + 1):
            fits = ends >= size
            h = np.zeros(int(fits.sum()), np.uint64)
            for k in range(size):
                h = (h + codes[ends[fits] - size + k]) * _MIX
                h ^= h >> np.uint64(29)
            got = pieces.find(h).astype(np.int64)
            found[fits, size - 1] = got if size == 1 else np.where(got < len(pieces.pieces), got, -1)
        for e, row in zip(ends.tolist(), found, strict=True):
            sizes = np.flatnonzero(row >= 0)
            total = (ring[(e - 1 - sizes) % width] * probs[row[sizes]]).sum(0)
            total = np.where(total > 0, total, 1.0)
            ring /= total
            log += np.log(total)
            ring[e % width] = 1.0
    return log


def forward(words: list[str], probs: np.ndarray, pieces: Pieces, wide: int = 48) -> np.ndarray:
    """log P(word | language), summed over all segmentations: one row a word, one column a language.

    probs: one row a piece and a last one for letters without a piece. Scaled at every place, so long words don't
    underflow. Words of up to `wide` letters go side by side, longer ones alone, in memory that doesn't follow their length.
    """
    out = np.zeros((len(words), probs.shape[1]))
    order = sorted((i for i in range(len(words)) if len(words[i]) <= wide), key=lambda i: len(words[i]))
    for i in range(len(words)):
        if len(words[i]) > wide:
            out[i] = _long(words[i], probs, pieces)
    for lo in range(0, len(order), 8192):
        part = order[lo : lo + 8192]
        grid, lengths = _grid([words[i] for i in part])
        sums = np.zeros((grid.shape[1] + 1, len(part), probs.shape[1]))
        sums[0] = 1.0
        log = np.zeros((len(part), probs.shape[1]))
        now, first = -1, 0
        for start, end, rows, got in _spans(grid, lengths, pieces):
            if start != now:
                now, first = start, int(np.searchsorted(lengths, start, side="right"))  # words sorted by length: those that go on
                _scaled(sums[:, first:], start, start, min(start + LONGEST_PIECE, len(sums) - 1) + 1, log[first:])
            sums[end, rows] += sums[start, rows] * probs[got]
        out[part] = np.log(np.maximum(sums[lengths, np.arange(len(part))], 1e-300)) + log
    return out


def expected(words: list[str], weight: np.ndarray, probs: np.ndarray, pieces: Pieces, cells: int = 1 << 17) -> np.ndarray:
    """How often each piece is expected in each language, over all segmentations of words with weights (words, languages)."""
    total = np.zeros_like(probs)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, every in sorted(by_length.items()):
        step = max(1, cells // (n + 1))
        for lo in range(0, len(every), step):
            part = every[lo : lo + step]
            grid, lengths = _grid([words[i] for i in part])
            spans = list(_spans(grid, lengths, pieces))
            a, b = (np.zeros((n + 1, len(part), probs.shape[1])) for _ in range(2))
            loga, logb = np.zeros_like(a), np.zeros_like(b)
            a[0], b[n] = 1.0, 1.0
            log, now = np.zeros_like(a[0]), -1
            for start, end, rows, got in spans:
                if start != now:
                    now = start
                    _scaled(a, start, start, min(start + LONGEST_PIECE, n) + 1, log)
                    loga[start] = log
                a[end, rows] += a[start, rows] * probs[got]
            loga[n] = log
            log, now = np.zeros_like(a[0]), n + 1
            for start, end, rows, got in sorted(spans, key=lambda x: -x[1]):
                while now > end:  # from the word's end down: scale what lies before the place
                    now -= 1
                    _scaled(b, now, max(0, now - LONGEST_PIECE), now + 1, log)
                    logb[now] = log
                b[start, rows] += probs[got] * b[end, rows]
            whole = np.maximum(a[n], 1e-300)
            for start, end, rows, got in spans:
                factor = np.exp(np.minimum(loga[start, rows] + logb[end, rows] - loga[n, rows], 700))
                share = a[start, rows] * probs[got] * b[end, rows] / whole[rows] * factor * weight[part][rows]
                for k in range(probs.shape[1]):
                    total[:, k] += np.bincount(got, share[:, k], len(total))
    return total


def fit(counts: list[Counter], pieces: Pieces, rounds: int = 2, smooth: float = 0.5) -> np.ndarray:
    """Piece probabilities of each language from word counts, by expectation maximisation over all segmentations."""
    words = sorted(set().union(*counts)) if counts else []
    k, n = len(counts), len(pieces.pieces)
    weight = np.array([[c[w] for c in counts] for w in words], float).reshape(len(words), k)
    probs = np.full((n + 1, k), 1.0 / (n + 1))
    probs *= np.array([[0.25 ** min(len(p), 8)] for p in pieces.pieces] + [[UNSEEN]]) ** -0.5
    probs /= probs.sum(0)
    for _ in range(rounds):
        got = expected(words, weight, probs, pieces)
        back = got.sum(1, keepdims=True)
        back = (back + 1e-3) / (back.sum() + 1e-3 * (n + 1))
        probs = (got + smooth * (n + 1) * 0.01 * back) / (got.sum(0) + smooth * (n + 1) * 0.01)
    probs[n] = np.maximum(probs[n], UNSEEN)
    return probs


def train(docs: DataFrame, path: str | None = None, sample_docs: int = 120, sample_chars: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages by code point, piece probabilities) from documents whose crc32(doc_id as text) mod 5 isn't 0.

    Two passes: the sample's ids from narrow columns (a rank limit that Spark applies before the shuffle), then their
    texts. At most sample_docs ids a language are broadcast, and as many rows of sample_chars characters reach the driver.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.where("text is not null").select("doc_id", "lang").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs).select("doc_id").distinct()
    langs: dict[str, Counter] = {}
    for lang, text in known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", F.substring("text", 1, sample_chars)).collect():
        langs.setdefault(lang, Counter()).update("▁" + w for w in WORDS.findall((text or "").lower()))
    names = sorted(langs)
    pieces = vocabulary(path or default_vocabulary())
    return names, fit([langs[x] for x in names], pieces).astype(np.float32).astype(float)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None, text: str = "text", byte_budget: int = 1 << 20, cached_words: int = 300_000) -> DataFrame:
    """docs with lang_pred and score: one narrow pass, no shuffle. Columns of those names in docs are replaced.

    Scores of words are kept in a table of at most cached_words words in each Python worker.
    """
    names, probs = model
    where = path or default_vocabulary()
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(where)
        k = max(1, len(names))
        key = (where, cached_words, tuple(names), hash(probs.tobytes()))
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = ({}, np.zeros((cached_words * 2, k + 1)))
        at, table = _WORKER[key]

        def learn(words: list[str]) -> None:
            """Rows of the table for words as ROUGH finds them, from those of the letter runs in them."""
            runs = [[w] if w.isalpha() else WORDS.findall(w) for w in words]
            logs = forward(["▁" + r for v in runs for r in v], probs, pieces)
            many = np.fromiter(map(len, runs), np.int64, len(runs))
            first, some = np.cumsum(many) - many, many > 0
            rows = np.arange(len(at), len(at) + len(words))
            table[rows] = 0
            table[rows[some], :k] = np.add.reduceat(logs, first[some]) if some.any() else 0
            table[rows, k] = many
            at.update(zip(words, rows.tolist(), strict=True))

        for batch in batches:
            for part in cut(batch, text, byte_budget):
                split = [ROUGH.findall((t or "").lower()) for t in part.column(text).to_pylist()]
                new = set().union(*split) - at.keys()
                if len(at) + len(new) > cached_words:
                    at.clear()
                    new = set().union(*split)
                if len(new) > len(table):
                    table = np.zeros((len(new), k + 1))
                    _WORKER[key] = (at, table)
                if names:
                    learn(list(new))
                pred, score = [], []
                for words in split:
                    got = table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(0) if words and names else np.zeros(k + 1)
                    if not got[k]:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(np.argmax(got[:k]))
                    pred.append(names[best])
                    score.append(float(1.0 / np.exp(got[:k] - got[best]).sum()))
                cols = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
