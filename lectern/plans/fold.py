"""Greedy acceptance in order: what is kept depends on what was kept before, so neither lag() nor an anti-join will do."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.plans.stage import Workspace, small_batches

#: Orders in a segment of a key's run.
SPAN = 1024


def greedy_keep(items: Column, kind: str, clash: Callable[[Column, Column], Column]) -> Column:
    """Of an ordered array of structs (of type `kind`), those that clash with none of the kept ones before. For the
    phrases or triples of one slide: every kept one may matter, so all are carried."""

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.array().cast(f"array<{kind}>"), step)


def greedy_runs(rows: DataFrame, key: str, order: str, words: str, window: int, clash: Callable[[set, set], bool], span: int = SPAN) -> DataFrame:
    """(key, order) of the rows accepted, per key in order, if they clash with none of the last `window` accepted ones.
    order: a whole number. words: an array of whole numbers, a row's set.

    A run is cut into segments of `span` orders, which tasks fold side by side, holding `window` sets each. A segment
    depends on those before it only by the rows that were last accepted there: all segments are folded, then those again
    whose rows to begin with were others than they had, until none are. Each round settles the first open segment at
    least, so the result is that of one pass over the whole run.
    """
    small_batches(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, seg, seed, order, words) to accepted ones and, at the end of a segment, the last accepted."""
        now: tuple | None = None
        last: deque[tuple] = deque(maxlen=window)

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kept_types, strict=True)], ["key", "seg", "at", "last"])

        kept_types: list = []
        for batch in batches:
            kept_types = [batch.column("key").type, pa.int64(), pa.int64(), pa.list_(pa.int64())]
            found = []
            columns = [batch.column(c).to_pylist() for c in ("key", "seg", "seed", "at")]
            for k, seg, seed, at, w in zip(*columns, batch.column("w"), strict=True):
                if (k, seg) != now:
                    if now is not None:
                        found.append((*now, None, [x for x, _ in last]))
                    now = (k, seg)
                    last.clear()
                mine = set(w.values.to_pylist()) if w.is_valid else set()
                if seed:
                    last.append((at, mine))
                elif not any(clash(s, mine) for _, s in last):
                    last.append((at, mine))
                    found.append((k, seg, at, None))
            if found:
                yield out(found)
        if now is not None:
            yield out([(*now, None, [x for x, _ in last])])

    def folded(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("key", "seg").sortWithinPartitions("key", "seg", F.col("seed").desc(), "at")
        return dealt.mapInArrow(run, f"key {kinds[key]}, seg bigint, at bigint, last array<bigint>")

    at = F.col(order).cast("bigint")
    before = Window.partitionBy("key").orderBy("seg")
    with Workspace(rows.sparkSession) as space:
        every = rows.select(F.col(key).alias("key"), F.floor(at / F.lit(span)).cast("bigint").alias("seg"), F.lit(False).alias("seed"), at.alias("at"), F.col(words).alias("w"))
        every = space.table(every.where("key is not null and at is not null"), "rows")
        done = space.table(folded(every), "folded")
        begun = done.where("last is not null").select("key", "seg", F.array().cast("array<bigint>").alias("begun"))
        while True:
            ends = done.where("last is not null").select("key", "seg", F.coalesce(F.lag("last").over(before), F.array().cast("array<bigint>")).alias("start"))
            again = space.table(ends.join(begun, ["key", "seg"]).where("start <> begun").select("key", "seg", "start"), "again")
            if again.isEmpty():
                return space.finish(done.where("at is not null").select(F.col("key").alias(key), F.col("at").cast(kinds[order]).alias(order)), "kept")
            seeds = again.select("key", "seg", F.explode("start").alias("at")).join(every.select("key", "at", "w"), ["key", "at"])
            open_ = every.join(again.select("key", "seg"), ["key", "seg"], "left_semi").unionByName(seeds.select("key", "seg", F.lit(True).alias("seed"), "at", "w"))
            new = folded(open_).unionByName(done.join(again.select("key", "seg"), ["key", "seg"], "left_anti"))
            done = space.table(new, "folded")
            begun = begun.join(again, ["key", "seg"], "left").select("key", "seg", F.coalesce("start", "begun").alias("begun"))
            begun = space.table(begun, "begun")
