"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct shingles of `width` words (one shingle of all words where it has fewer). Two small
collections of `bands` band values of `rows` minhashes each are computed, A and B; the table keys are all pairs
(A_i, B_j). So bands^2 tables of 2 * rows minhashes each cost 2 * bands * rows minhashes instead of
2 * bands^2 * rows. With 8 bands of 2 rows a pair of similarity 0.85 misses every table with probability 7e-5.

1. One pass reads texts and writes sketches. Documents with equal sets (128-bit hash of the sorted set) become a class
   under its smallest doc_id, with map-side combination, so copies cost a row a task.
2. A bands that only one class has are dropped before the product with B is made.
3. Each class is checked against the smallest member of each of its table buckets, on full sets; links give components.
4. Exactness: classes in a bucket with classes of other components stay open. Pairs of open classes of different
   components that share an element of their prefixes (a bound that loses no link) are checked on full sets; no
   bucket, partner or candidate is capped.

Links hold where 100 * |A and B| >= 100 * threshold * |A or B|. Null texts and texts without words have no shingles
and link with nothing. Rows of one doc_id are one node. Repeated rows give repeated results. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.batches import cut
from lectern.plans.components import connected_components
from lectern.plans.stage import Workspace

WIDTH, BANDS, ROWS, THRESHOLD = 5, 8, 2, 85
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower() lowers A-Z only; bytes.split() splits on \\x20 and \\x09-\\x0D."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    take = min(width, len(ids))
    h = np.full(len(ids) - take + 1, take, np.uint64)
    for k in range(take):
        h = (h ^ ids[k : k + len(h)]) * _M1
        h ^= h >> np.uint64(32)
    return np.unique(h)


def band_values(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row a set (all non-empty), 2 * bands values: A then B. One pass over all shingles for each minhash."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    rng = np.random.default_rng(20_240_601)
    factors = rng.integers(1 << 62, 1 << 63, (2 * bands * rows, 2), dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), 2 * bands), np.uint64)
    for i, (a, b) in enumerate(factors):
        v = (flat ^ b) * a
        v ^= v >> np.uint64(31)
        low = np.minimum.reduceat(v * _M2, starts)
        out[:, i // rows] = (out[:, i // rows] ^ low) * _M1
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def sketch(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, byte_budget: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set), a, b (band values; null for empty sets): one narrow pass."""
    schema = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, a array<bigint>, b array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", byte_budget):
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                values = band_values([sets[i] for i in full], bands, rows) if full else np.zeros((0, 2 * bands), np.int64)
                lengths = np.zeros(len(sets), np.int64)
                lengths[full] = bands
                at, mask = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(lengths == 0)
                lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(v).ravel(), pa.int64()), mask=mask) for v in (values[:, :bands], values[:, bands:])]
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *lists], ["doc_id", "n_shingles", "h1", "h2", "a", "b"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the sorted set, as bytes, of each distinct text of the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", 1 << 20):
                sets = [shingles(t, width).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return rows.mapInArrow(run, "id bigint, s binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("sx"), batch.column("sy")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys))
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good[i] = same > 0 and 100 * same >= percent * (len(both) - same)
            yield batch.select(["x", "y"]).filter(pa.array(good))

    left = sets.select(F.col("id").alias("x"), F.col("s").alias("sx"))
    right = sets.select(F.col("id").alias("y"), F.col("s").alias("sy"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint").distinct()


def _similar_sizes(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _open_pairs(space: Workspace, members: DataFrame, percent: int) -> DataFrame:
    """(x, y, cx, cy): pairs of members (id, s, component) of different components that may link, by prefixes.

    Sets of similarity p share an element among the n - ceil(p n) + 1 rarest of each, in any one order of elements.
    With the order by the number of members that hold an element, elements of one member alone come first: a set with
    more of those than the prefix is long links with nothing, and copies with edits of their own meet nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "s", 1 << 20):
                sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column("s")]
                i = pa.array(np.repeat(np.arange(len(sets)), [len(v) for v in sets]), pa.int64())
                sizes = pa.array([len(v) for v in sets], pa.int64())
                own = pa.array([xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63) for v in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(i), own.take(i), part.column("component").take(i), sizes.take(i), pa.array(np.concatenate(sets))], ["id", "own", "component", "n", "e"])

    elements = space.table(members.select("id", "component", "s").mapInArrow(run, "id bigint, own bigint, component bigint, n bigint, e bigint"), "elements")
    held = elements.groupBy("e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    each = Window.partitionBy("id", "own")
    prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    shared = elements.join(held, "e").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(each)).withColumn("rank", F.row_number().over(each.orderBy("c", "e")))
    shared = shared.withColumn("pos", F.col("alone") + F.col("rank")).where(F.col("pos") <= prefix)
    shared = space.table(shared.select("id", "component", "n", "e", "pos"), "prefixes")
    p, q = shared.alias("p"), shared.alias("q")
    # at a pair's first common element, what follows it in either set must suffice for the overlap that the pair needs
    enough = lambda s: (F.col(f"{s}.n") - F.col(f"{s}.pos") + 1) * (100 + percent) >= percent * (F.col("p.n") + F.col("q.n"))
    met = (F.col("p.component") < F.col("q.component")) & _similar_sizes(F.col("p.n"), F.col("q.n"), percent) & enough("p") & enough("q")
    pairs = p.join(q, (F.col("p.e") == F.col("q.e")) & met)
    return pairs.select(F.col("p.id").alias("x"), F.col("q.id").alias("y"), F.col("p.component").alias("cx"), F.col("q.component").alias("cy")).distinct()


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    with Workspace(docs.sparkSession) as space:
        return space.finish(_near_duplicates(space, docs, percent, width, bands, rows), "near")


def _near_duplicates(space: Workspace, docs: DataFrame, percent: int, width: int, bands: int, rows: int) -> DataFrame:
    sketches = space.table(sketch(docs, width, bands, rows), "sketches")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = space.table(classes, "classes")

    ones = classes.select("id", F.posexplode("a").alias("i", "v"))
    shared = ones.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "v")
    some = ones.join(shared, ["i", "v"], "left_semi").groupBy("id").agg(F.collect_set("i").alias("is"))
    wide = classes.join(some, "id").select("id", "n", "a", "b", F.explode("is").alias("i"))
    wide = wide.select("id", "n", F.get("a", F.col("i")).alias("av"), "i", F.posexplode("b").alias("j", "bv"))
    tables = wide.select("id", "n", F.xxhash64("i", "j", "av", "bv").alias("key"))
    buckets = tables.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id <> last").select("key", F.col("first.id").alias("y"), F.col("first.n").alias("m"))
    tables = space.table(tables.join(buckets, "key"), "tables")
    sets = space.table(_full_sets(docs, tables.select("id").distinct(), width).distinct(), "sets")

    stars = tables.where(F.col("id") != F.col("y")).where(_similar_sizes(F.col("n"), F.col("m"), percent)).select(F.col("id").alias("x"), "y").distinct()
    linked = space.table(_links(stars, sets, percent), "links")
    first = connected_components(linked, "x", "y")

    placed = tables.select("key", "id").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = placed.join(mixed, "key", "left_semi").select("id", "component").distinct()
    pairs = space.table(_open_pairs(space, sets.join(open_, "id"), percent), "pairs")
    more = _links(pairs.select("x", "y"), sets, percent).join(pairs, ["x", "y"]).select("cx", "cy").distinct()
    second = connected_components(more, "cx", "cy").select(F.col("node").alias("component"), F.col("component").alias("joined"))
    parts = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "id").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = parts.join(second, "component", "left").select("h1", "h2", "n_shingles", F.coalesce("joined", "component").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "h1", "h2").join(parts, ["h1", "h2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_minhash_tensored(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
