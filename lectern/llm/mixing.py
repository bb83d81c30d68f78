"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Targets: weights 3, 1, 2, 3, ... over the sources by code point (null last) share `share` of all words; a source
   stops at `most_epochs` times its own words and the excess is shared again by weight until none is above.
2. The mix is dealt in blocks of `block` words. Blocks go to sources by the highest quotients target / (2 k - 1).
   A multiplier x between 1 - n/2N and 1 + n/2N (n sources, N blocks) always gives the N highest quotients, so only
   the quotients in that interval are listed: about three a source, whatever N is.
3. A source is dealt over shards by a hash of doc_id (one shard for each `shard_words` words, `most_shards` at most),
   and its blocks over its shards in the same way, so a source with a third of all rows is many shards.
4. In a shard, documents stand in an order seeded by `seed`; the shard's quota takes whole rounds of it and then
   blocks from its start. A document's `taken` is what those blocks hold of it.

Null texts have size 0 and are never taken. Null sources are one source. Repeated rows are documents of their own.
All draws are functions of seed and row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.plans.stage import Workspace

#: Fixed value: the weights, repeated over the sources in order.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to targets. One row a source, so the window over all of them stays small.

    Filling: with sources by cap / weight, the first m stop at their caps, where m is the number whose ratio is at
    most the level (budget - caps before) / (weights from here on).
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("place", F.row_number().over(fill)).withColumn("open", F.col("ratio") > F.col("level"))
    # the first open source's level; later ones of the same ratio would count it as stopped
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(every)["level"]
    t = t.withColumn("fill", F.coalesce(level, F.lit(float("inf"))))
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("fill")).alias("target"))


def apportion(t: DataFrame, group: list[str], unit: str, share: str, seats: str, total: str) -> DataFrame:
    """t with `seats`: `total` seats (a column, constant in a group) over the group's units by Sainte-Lague quotients of `share`.

    Ties go to the unit first in order. Groups without any share get no seats.
    """
    whole = Window.partitionBy(*group)
    t = t.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__sum", F.sum(share).over(whole))
    t = t.withColumn("__q", F.when((F.col("__sum") > 0) & (F.col(total) > 0), F.col(share) / F.col("__sum") * F.col(total)).otherwise(0.0))
    slack = F.col("__n") / (F.lit(2.0) * F.greatest(F.col(total), F.lit(1)))
    t = t.withColumn("__low", F.greatest(F.ceil(F.col("__q") * (F.lit(1.0) - slack) - 0.5) - 1, F.lit(0)).cast("bigint"))
    t = t.withColumn("__high", F.when(F.col("__q") > 0, F.floor(F.col("__q") * (F.lit(1.0) + slack) + 0.5) + 1).otherwise(F.lit(0)).cast("bigint"))
    t = t.withColumn("__open", F.col(total) - F.sum("__low").over(whole))
    names = t.columns
    # a unit without open quotients keeps one row with a null k
    t = t.withColumn("__k", F.explode(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high"))).otherwise(F.array(F.lit(None).cast("bigint")))))
    quotient = F.col("__q") / (2 * F.col("__k") - 1)
    rank = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), F.col(unit).asc_nulls_last(), "__k")
    won = F.count_if(F.col("__k").isNotNull() & (F.col("__rank") <= F.col("__open")))
    t = t.withColumn("__rank", F.row_number().over(rank)).groupBy(*names).agg(won.alias("__won"))
    return t.withColumn(seats, F.when(F.col("__q") > 0, F.col("__low") + F.col("__won")).otherwise(F.lit(0)).cast("bigint")).drop("__n", "__sum", "__q", "__low", "__high", "__open", "__won")


def measured(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size and dice: what a draw needs of a document."""
    dice = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), dice.alias("dice"))


def draw(narrow: DataFrame, seed: int = 7, share: float = 1.5, most_epochs: float = 2.0, block: int = 16, shard_words: int = 16_384, most_shards: int = 4096) -> DataFrame:
    """Measured documents with source_size, target and taken."""
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    t = targets(sizes, share, most_epochs)
    t = t.withColumn("__all", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")).withColumn("__one", F.lit(1))
    t = apportion(t, ["__one"], "source", "target", "__seats", "__all")
    t = t.withColumn("__shards", F.greatest(F.lit(1), F.least(F.lit(most_shards), (F.col("source_size") / shard_words).cast("int"))))
    t = t.select(F.col("source").alias("__source"), "source_size", "target", "__seats", "__shards")
    rows = narrow.join(t, narrow.source.eqNullSafe(t["__source"]))
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "__shards").cast("int"))
    cells = rows.groupBy("__source", "__shard", "__seats").agg(F.sum("size").cast("double").alias("__size"))
    cells = apportion(cells, ["__source"], "__shard", "__size", "__quota", "__seats").select(F.col("__source").alias("__cs"), F.col("__shard").alias("__ch"), "__size", "__quota")
    in_order = Window.partitionBy("__source", "__shard").orderBy("dice", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    rows = rows.join(cells, rows["__source"].eqNullSafe(cells["__cs"]) & (rows["__shard"] == cells["__ch"]))
    words = F.least(F.col("__quota") * F.lit(block), (F.col("__size") * most_epochs).cast("bigint"))
    rounds = F.when(F.col("__size") > 0, F.floor(words / F.col("__size"))).otherwise(F.lit(0)).cast("bigint")
    rest = words - rounds * F.col("__size").cast("bigint")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before")))
    return rows.withColumn("taken", F.least(taken, (F.col("size") * most_epochs).cast("bigint")).cast("bigint")).select("doc_id", "source", "size", "dice", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 7, share: float = 1.5, most_epochs: float = 2.0, block: int = 16, shard_words: int = 16_384, most_shards: int = 4096) -> DataFrame:
    """docs with size, source_size, target and taken. Columns of those names in docs are replaced.

    The draw runs over narrow rows, written to the shared folder; texts are dealt once, to meet it by doc_id and dice.
    Rows alike in both are numbered on either side, so each gets a draw of its own.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    with Workspace(docs.sparkSession) as space:
        drawn = space.finish(draw(space.table(measured(docs, seed), "measured"), seed, share, most_epochs, block, shard_words, most_shards), "drawn")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    one = F.struct("taken", "size", "source_size", "target")
    sets = drawn.groupBy(key.alias("__id"), F.col("dice").alias("__dice"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__src")).agg(F.array_sort(F.collect_list(one)).alias("__draws"))
    rows = docs.withColumn("__id", key).withColumn("__dice", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).withColumn("__src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    alike = Window.partitionBy("__id", "__dice", "__src").orderBy("__id")
    met = rows.withColumn("__n", F.row_number().over(alike)).join(sets, ["__id", "__dice", "__src"]).withColumn("__draw", F.element_at("__draws", F.col("__n")))
    return met.select(*docs.columns, "__draw.size", "__draw.source_size", "__draw.target", "__draw.taken")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark) as space:
        drawn = draw(space.table(measured(docs), "measured")).select("doc_id", "size", "source_size", "target", "taken")
        return space.finish(drawn, "drawn")
