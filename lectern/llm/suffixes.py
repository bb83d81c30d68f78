"""Removal of repeated byte strings by suffix arrays (linear grouping construction), exact over all documents.

Every `window`-byte string is judged: it is removed if it also starts anywhere else. A suffix array of a whole corpus
fits no machine, and a third of all documents may share a passage, so the strings are first dealt by content and
folded where they're identical; suffix arrays then decide what is left, in bounded tasks:

1. Each string has an anchor, its 48-gram of least hash: a function of the string alone, so equal strings have equal
   anchors at equal offsets. Strings in a row with one anchor are a run. Runs are counted by anchor, combined on the
   map side. An anchor met once rules its whole run out; equal runs (128 bits of hash) are all repeated.
2. Of anchors with differing runs, each distinct run is cut into ranges of 32 string starts, aligned at the anchor.
   All strings of a range share its 369-byte core. Ranges are counted by core, again on the map side: a core met once
   rules its strings out, equal ranges are all repeated.
3. Ranges with one core and differing edges remain. A range becomes a string of its left edge, one symbol for the core
   and its right edge, in which a `window`-byte string is one of 32 symbols; suffix arrays over such strings, in
   batches of whole cores, give the repeated ones as neighbours that agree on 32 symbols.
   A core with more than `hot` differing ranges is dealt on by (core, offset, edges) and counted instead.
4. Repeated strings, as byte intervals, meet their document once more; their union is cut out.

Texts are UTF-8 bytes; null is empty. Matches don't cross documents, overlaps count, and strings are judged on the
input. Texts shorter than the window keep all bytes. Two rows alike in doc_id and text repeat each other's strings.
A null doc_id is a value like others. Other columns of the documents pass through `deduplicate` unread.

A window in words is the same work over texts in which a word is a code of 8 bytes, of which only strings that start
with a word count. It catches what a window in bytes can't: passages of short words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import cut, text_bytes
from lectern.llm.grouping import suffix_array
from lectern.plans.stage import Workspace

WINDOW, GRAM, RANGE, HOT = 400, 48, 32, 4096
#: Bytes of a long document taken at a time: what a worker holds doesn't follow the length of texts.
STRETCH = 1 << 19
CODE = 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, and a random value for each byte."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers_of(x: int, size: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return out.cumprod(dtype=np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (self._powers_of(x, size) for x in (self.base, self.inverse))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.byte[raw] * self.up[: n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.down[start]


@lru_cache(maxsize=4)
def _powers(seed: int) -> _Powers:
    return _Powers(seed)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    pad = -n % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def find_runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, run hash, first start, last start, anchor), positions within the documents."""
    lengths = np.diff(offsets)
    if len(raw) < window or not (lengths >= window).any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    one, two = _powers(1), _powers(2)
    sums = one.sums(raw)
    grams = _mixed((sums[gram:] - sums[:-gram]) * one.down[: len(raw) - gram + 1])
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(ranked, window - gram + 1) & np.uint64(0xFFFFFFFF)
    ok = np.zeros(len(raw) + 1, np.int64)
    fits = lengths >= window
    np.add.at(ok, offsets[:-1][fits], 1)
    np.add.at(ok, offsets[1:][fits] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok)[: len(least)] > 0)
    anchors = least[starts].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    lo, hi, at = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1], anchors[first]
    doc = np.searchsorted(offsets, lo, side="right") - 1
    whole = _mixed(two.of(two.sums(raw), lo, hi + window)) ^ (hi - lo).astype(np.uint64)
    base = offsets[doc]
    return doc, grams[at].view(np.int64), whole.view(np.int64), lo - base, hi - base, at - base


def stretched_runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """find_runs, a stretch of a long document at a time: runs that start in the stretch, with enough of the bytes
    around it that each is whole (a run has at most window - gram + 1 starts)."""
    if len(raw) <= 2 * stretch or len(offsets) > 2:
        return find_runs(raw, offsets, window, gram)
    parts, n = [], len(raw)
    for c in range(0, n, stretch):
        a, b = max(0, c - window), min(n, c + stretch + 2 * window)
        doc, f, h, lo, hi, at = find_runs(raw[a:b], np.array([0, b - a]), window, gram)
        mine = (lo + a >= c) & (lo + a < c + stretch)
        parts.append([x[mine] for x in (doc, f, h, lo + a, hi + a, at + a)])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes_of(text: str | None, coded: bool) -> bytes:
    return word_codes(text).encode() if coded else (text or "").encode()


def _runs(docs: DataFrame, window: int, coded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", 1 << 19):
                texts = part.column("text")
                raw, offsets = text_bytes(pa.array([_bytes_of(t, True) for t in texts.to_pylist()], pa.large_binary()) if coded else texts)
                doc, f, h, lo, hi, at = stretched_runs(raw, offsets, window)
                i = pa.array(doc, pa.int64())
                small = [pa.array(x.astype(np.int32)) for x in (lo, hi, at)]
                yield pa.RecordBatch.from_arrays([part.column("kd").take(i), part.column("kh").take(i), pa.array(f), pa.array(h), *small], ["kd", "kh", "f", "h", "lo", "hi", "at"])

    return docs.select("kd", "kh", "text").mapInArrow(run, "kd bigint, kh bigint, f bigint, h bigint, lo int, hi int, at int")


def find_ranges(raw: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, window: int = WINDOW, width: int = RANGE) -> tuple:
    """(core hashes k1, k2, start of the core, left edge's length, edges): the ranges of the runs of one document."""
    one, two = _powers(1), _powers(2)
    s1, s2 = one.sums(raw), two.sums(raw)
    f = f.view(np.uint64)
    z0, z1 = (at - hi) // width, (at - lo) // width
    n = z1 - z0 + 1
    i = np.repeat(np.arange(len(f)), n)
    z = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + z0[i]
    core = at[i] - z * width
    size = window - width + 1
    k1 = _mixed(one.of(s1, core, core + size) ^ _mixed(f[i] + z.astype(np.uint64)))
    k2 = _mixed(two.of(s2, core, core + size) ^ z.astype(np.uint64))
    left = np.minimum(core, width - 1)
    data = raw.tobytes()
    edges = [data[c - n : c] + data[c + size : c + window] for c, n in zip(core.tolist(), left.tolist(), strict=True)]
    return k1.view(np.int64), k2.view(np.int64), core, left, edges


def stretched_ranges(raw: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, window: int = WINDOW, width: int = RANGE, stretch: int = STRETCH) -> Iterator[tuple]:
    """find_ranges, a stretch of a long document at a time."""
    group = lo // stretch
    for g in np.unique(group):
        mine = group == g
        a, b = max(0, int(lo[mine].min()) - 2 * width), min(len(raw), int(hi[mine].max()) + window + 2 * width)
        k1, k2, core, left, edges = find_ranges(raw[a:b], f[mine], lo[mine] - a, hi[mine] - a, at[mine] - a, window, width)
        yield k1, k2, core + a, left, edges


def _ranges(picked: DataFrame, window: int, width: int, coded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", 1 << 19):
                texts, kd, kh, runs = part.column("text"), part.column("kd"), part.column("kh"), part.column("runs")
                at_ = runs.offsets.to_numpy()
                fields = [x.to_numpy() for x in runs.values.flatten()]
                f, lo, hi, at = fields[0], *(x.astype(np.int64) for x in fields[1:])
                for i in range(part.num_rows):
                    mine = slice(int(at_[i]), int(at_[i + 1]))
                    raw = np.frombuffer(_bytes_of(texts[i].as_py(), coded), np.uint8)
                    for k1, k2, core, left, edges in stretched_ranges(raw, f[mine], lo[mine], hi[mine], at[mine], window, width):
                        same = pa.array(np.full(len(core), i))
                        yield pa.RecordBatch.from_arrays([kd.take(same), kh.take(same), pa.array(k1), pa.array(k2), pa.array(core.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(edges, pa.binary())], ["kd", "kh", "k1", "k2", "core", "nl", "edges"])

    return picked.mapInArrow(run, "kd bigint, kh bigint, k1 bigint, k2 bigint, core int, nl int, edges binary")


def repeated_starts(groups: list[list[tuple[int, bytes]]], width: int = RANGE) -> list[list[int]]:
    """For each group (one core) and each of its distinct (left edge's length, edges): a bit for each offset x of the
    core in the string, set where the string of width symbols starting x symbols before the core is in the group twice."""
    symbols: list[int] = []
    begin: list[tuple[int, int, int, int]] = []
    for g, members in enumerate(groups):
        for m, (nl, edges) in enumerate(members):
            begin.append((len(symbols), nl, g, m))
            symbols += [2 + b for b in edges[:nl]]
            symbols.append(258 + g)
            symbols += [2 + b for b in edges[nl:]]
            symbols.append(1)
    out = [[0] * len(members) for members in groups]
    text = np.array(symbols, np.int64)
    valid = np.zeros(len(text), bool)
    owner: dict[int, tuple[int, int, int]] = {}
    for s, nl, g, m in begin:
        total = len(groups[g][m][1]) + 1
        for p in range(0, min(nl, total - width) + 1):
            valid[s + p] = True
            owner[s + p] = (g, m, nl - p)
    order = np.array(suffix_array(symbols), np.int64)
    order = order[valid[order]] if len(order) else order
    if len(order) < 2:
        return out
    spans = text[order[:, None] + np.arange(width)]
    same = (spans[1:] == spans[:-1]).all(1)
    for p in order[np.concatenate([same, [False]]) | np.concatenate([[False], same])].tolist():
        g, m, x = owner[p]
        out[g][m] |= 1 << x
    return out


def _masks(groups: DataFrame, width: int, most_symbols: int = 40_000) -> DataFrame:
    """groups: (k1, k2, members): the mask of each member. Suffix arrays over whole groups, most_symbols at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple[int, int, list[tuple[int, bytes]]]]) -> pa.RecordBatch:
            masks = repeated_starts([r[2] for r in rows], width)
            flat = [(k1, k2, nl, e, mask) for (k1, k2, members), got in zip(rows, masks, strict=True) for (nl, e), mask in zip(members, got, strict=True) if mask]
            cols = list(zip(*flat, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["k1", "k2", "nl", "edges", "mask"])

        for batch in batches:
            held, symbols = [], 0
            for i in range(batch.num_rows):
                members = [(m["nl"], m["edges"]) for m in batch.column("members")[i].as_py()]
                held.append((batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py(), members))
                symbols += sum(len(e) + 2 for _, e in members)
                if symbols >= most_symbols:
                    yield solve(held)
                    held, symbols = [], 0
            if held:
                yield solve(held)

    return groups.mapInArrow(run, "k1 bigint, k2 bigint, nl int, edges binary, mask bigint")


def document_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a document, (kd, kh): its doc_id and the hash of its text."""
    return docs.withColumn("kd", document_key()).withColumn("kh", F.xxhash64("text"))


def repeated_intervals(docs: DataFrame, window: int = WINDOW, width: int = RANGE, hot: int = HOT, coded: bool = False) -> DataFrame:
    """(kd, kh, intervals: set of (start, stop) bytes) of keyed documents that hold a repeated string. coded: over the
    words' codes in place of the text."""
    with Workspace(docs.sparkSession) as space:
        return space.finish(_repeated_intervals(space, docs.select("kd", "kh", "text"), window, width, hot, coded), "intervals")


def _repeated_intervals(space: Workspace, texts: DataFrame, window: int, width: int, hot: int, coded: bool) -> DataFrame:
    runs = space.table(_runs(texts, window, coded), "runs")
    met = runs.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1")).where("n > 1").select("f", (F.col("h0") == F.col("h1")).alias("alike"))
    # tables of their own, here and below: a join right on the aggregate could not split a key that many rows have
    met = space.table(runs.join(space.table(met, "anchors"), "f"), "met")
    space.drop(runs)
    classes = met.where("not alike").groupBy("f", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kd", "kh", "lo", "hi", "at")).alias("r"))
    classes = space.table(classes, "classes")
    whole = met.where("alike").select("kd", "kh", "lo", "hi").unionByName(met.where("not alike").join(classes.where("n > 1").select("f", "h"), ["f", "h"], "left_semi").select("kd", "kh", "lo", "hi"))
    whole = whole.select("kd", "kh", F.col("lo").alias("start"), (F.col("hi") + window).alias("stop"))

    picked = classes.select(F.col("r.kd").alias("kd"), F.col("r.kh").alias("kh"), F.struct("f", "r.lo", "r.hi", "r.at").alias("r")).groupBy("kd", "kh").agg(F.collect_list("r").alias("runs"))
    ranges = space.table(_ranges(texts.join(picked, ["kd", "kh"]), window, width, coded), "ranges")
    edge_hash = F.xxhash64("edges", "nl")
    cores = ranges.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(edge_hash).alias("e0"), F.max(edge_hash).alias("e1")).where("n > 1").select("k1", "k2", "n", (F.col("e0") == F.col("e1")).alias("alike"))
    cut_ = ranges
    ranges = space.table(ranges.join(space.table(cores, "cores"), ["k1", "k2"]), "shared")
    space.drop(cut_)
    nr = F.length("edges") - F.col("nl")
    # starts of strings in a range, as bytes before its core: from the least to the most that the text allows
    least, most = F.lit(width - 1) - nr, F.col("nl")
    every = ranges.where("alike").where(least <= most).select("kd", "kh", (F.col("core") - most).alias("start"), (F.col("core") - least + window).alias("stop"))

    open_ = ranges.where("not alike")
    kinds = space.table(open_.groupBy("k1", "k2", "nl", "edges").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")), "kinds")
    copies = kinds.where("c > 1").where(least <= most).select("k1", "k2", "nl", "edges", F.expr(f"(shiftleft(1L, nl + 1) - shiftleft(1L, {width - 1} - (length(edges) - nl)))").alias("mask"))
    groups = kinds.where(F.col("n") <= hot).groupBy("k1", "k2").agg(F.collect_list(F.struct("nl", "edges")).alias("members")).where(F.size("members") > 1)
    # sorting costs far more than its bytes suggest, so its tasks aren't coalesced by them
    solved = _masks(groups.repartition(int(space.spark.conf.get("spark.sql.shuffle.partitions"))), width)
    x = F.col("x")
    each = kinds.where(F.col("n") > hot).where(least <= most).withColumn("x", F.explode(F.sequence(least, most)))
    each = each.withColumn("own", F.expr(f"concat(substring(edges, nl - x + 1, x), substring(edges, nl + 1, {width - 1} - x))"))
    twice = each.groupBy("k1", "k2", "x", "own").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k1", "k2", "x", "own")
    dealt = each.join(space.table(twice, "twice"), ["k1", "k2", "x", "own"], "left_semi").groupBy("k1", "k2", "nl", "edges").agg(F.bit_or(F.expr("shiftleft(1L, x)")).alias("mask"))
    masks = copies.unionByName(solved).unionByName(dealt).groupBy("k1", "k2", "nl", "edges").agg(F.bit_or("mask").alias("mask"))
    masks = space.table(masks, "masks")
    # neighbouring strings as one interval: from each bit whose upper neighbour is unset down to the next whose lower one is
    tops = F.expr(f"filter(sequence(0, {width - 1}), i -> (mask & shiftleft(1L, i)) <> 0 and (mask & shiftleft(2L, i)) = 0)")
    lows = F.expr(f"filter(sequence(0, {width - 1}), i -> (mask & shiftleft(1L, i)) <> 0 and (i = 0 or (mask & shiftleft(1L, i - 1)) = 0))")
    spans = F.explode(F.arrays_zip(tops.alias("top"), lows.alias("low")))
    some = open_.join(masks.select("k1", "k2", "nl", "edges", spans.alias("x")), ["k1", "k2", "nl", "edges"])
    some = some.select("kd", "kh", (F.col("core") - x["top"]).alias("start"), (F.col("core") - x["low"] + window).alias("stop"))
    return whole.unionByName(every).unionByName(some).groupBy("kd", "kh").agg(F.collect_set(F.struct("start", "stop")).alias("intervals"))


def word_codes(text: str | None) -> str:
    """8 ASCII characters a word: 56 bits of its hash."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, (text or "").encode().split()), np.uint64)
    return ((h[:, None] >> np.arange(0, 7 * CODE, 7, dtype=np.uint64)) & np.uint64(127)).astype(np.uint8).tobytes().decode("ascii")


def repeated_word_intervals(docs: DataFrame, words: int, width: int = RANGE, hot: int = HOT) -> DataFrame:
    """(kd, kh, word_intervals: array of (start, stop) words) of keyed documents that hold a repeated string of `words` words."""
    found = repeated_intervals(docs, words * CODE, width, hot, coded=True)
    # of the strings that start from start to stop - window, those that start with a word
    whole = F.expr(f"transform(intervals, i -> struct((i.start + {CODE - 1}) div {CODE} as start, (i.stop - {words * CODE}) div {CODE} + {words} as stop))")
    found = found.select("kd", "kh", F.filter(whole, lambda i: i["start"] + words <= i["stop"]).alias("word_intervals"))
    return found.where(F.size("word_intervals") > 0)


def _bounds(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows, starts and stops of a column of intervals; null is empty."""
    start, stop = column.values.flatten()
    return column.offsets.to_numpy(), start.to_numpy(zero_copy_only=False).astype(np.int64), stop.to_numpy(zero_copy_only=False).astype(np.int64)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, in order; those that touch are one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(start[1:] > far[:-1]) + 1
    return start[np.concatenate([[0], new])], far[np.concatenate([new - 1, [len(far) - 1]])]


def deduplicate(docs: DataFrame, window: int = WINDOW, width: int = RANGE, hot: int = HOT, keep_text: bool = True, words: int | None = None) -> DataFrame:
    """docs (without text, and with kept_text if keep_text) with n_bytes, n_removed, n_spans and kept_sha256.

    kept_text drops bytes of characters that the cut splits. Columns of those names in docs are replaced.
    With `words`, strings of so many words (without regard to the blanks between them) that repeat go as well, with the
    blanks behind them.
    """
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text]
    docs = docs.drop(*extra)
    key = keyed(docs.select("doc_id", "text"))
    found = repeated_intervals(key, window, width, hot)
    if words is None:
        found = found.withColumn("word_intervals", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"))
    else:
        found = found.join(repeated_word_intervals(key, words, width, hot), ["kd", "kh"], "full")
    others = [c for c in docs.columns if c != "text"]
    found = found.select(F.col("kd").alias("__kd"), F.col("kh").alias("__kh"), F.col("intervals").alias("__bytes"), F.col("word_intervals").alias("__words"))
    own = (document_key() == F.col("__kd")) & (F.xxhash64("text") == F.col("__kh"))
    joined = docs.join(found, own, "left").select(*others, F.col("text").alias("__text"), "__bytes", "__words")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *["kept_text string"] * keep_text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "__text", 1 << 19):
                bounds = [_bounds(part.column(c)) for c in ("__bytes", "__words")]
                rows, texts = [], []
                for i, text in enumerate(part.column("__text")):
                    data = (text.as_py() or "").encode()
                    (a, b), (c, d) = ((s[o[i] : o[i + 1]], e[o[i] : o[i + 1]]) for o, s, e in bounds)
                    if len(c):
                        places = np.array([*(m.start() for m in WORD.finditer(data)), len(data)])
                        a, b = np.concatenate([a, places[c]]), np.concatenate([b, places[d]])
                    a, b = merged(a, b)
                    whole = text.as_py()
                    if len(a):
                        at = [0, *b.tolist()]
                        data, n = b"".join([data[x:y] for x, y in zip(at, [*a.tolist(), len(data)], strict=True)]), len(data)
                        whole = data.decode("utf-8", "ignore")
                    else:
                        n = len(data)
                    rows.append((n, n - len(data), len(a), hashlib.sha256(data).hexdigest()))
                    if keep_text:
                        texts.append(whole)
                cols = [part.column(i) for i in range(len(others))]
                cols += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(texts, pa.string())] * keep_text], [*others, *extra])

    return joined.mapInArrow(run, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).withColumnRenamed("kept_text", "text")
