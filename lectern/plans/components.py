"""Connected components over an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.stage import Workspace


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable, for every node that has an edge.

    Rounds of minimum propagation and pointer jumping; each round is a table in the shared folder.
    A hub's neighbours are aggregated with a map-side minimum, and joins on a hub are left to skew-join splitting.
    Null ends and self-links are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    with Workspace(edges.sparkSession) as space:
        e = space.table(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        held = labels = space.table(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
        for _ in range(max_rounds):
            near = (
                e.join(labels, e.v == labels.node)
                .groupBy("u")
                .agg(F.min("component").alias("near"))
                .join(labels.select(F.col("node").alias("u"), "component"), "u")
                .select(F.col("u").alias("node"), F.least("near", "component").alias("hop"), "component")
            )
            # the label's own label: halves the depth of chains
            of = labels.select(F.col("node").alias("hop"), F.col("component").alias("up"))
            step = near.join(of, "hop", "left").select("node", F.least("hop", F.coalesce("up", "hop")).alias("component"), F.col("component").alias("before"))
            step = space.table(step, "labels")
            changed = step.where("component <> before").limit(1).count()
            space.drop(held)
            held, labels = step, step.select("node", "component")
            if not changed:
                return space.finish(labels, "components")
    raise RuntimeError("components did not settle; raise max_rounds")
