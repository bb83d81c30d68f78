"""URL filter over path-template trees, in DataFrame operations only.

Each host has a tree of templates over its paths' segments, grown until no node has `least` pages to split. At a node, a
child segment stays literal where it holds at least `least` pages and `share` of the node's pages; the other children
are variable and become the wildcard `*`. What lies below a node of fewer pages is one `**`. Leaves carry labelled
pages (`labels` by page_id: bad where toxic is 1 or quality is 0). From the deepest level up, siblings are compared with
each other in order of their bad share, and neighbours whose shares differ by no more than `z` standard errors are
merged; siblings that are all merged make their parent one branch among its own siblings. A merged branch's purity is (bad + prior * base) / (labelled + prior) with the base rate over all labelled pages; a branch of
purity `reject` or more is rejected. Rules come first: the longest rule that fits decides, else the template's verdict.

A null url or one without `://` has an empty host and path and the template of an empty path. Repeated rows count as
pages each. Hosts are counted by (host, template, segment) with map-side combination, so a host with a third of all
pages is a row for each of its segments in each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.plans.stage import Workspace

#: Ends of leaves: of paths that end at a node, and of all that is below one with too few pages. No segment holds them.
ENDS, BELOW = "/?", "/#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:  # noqa: ANN001
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def templates(space: Workspace, nodes: DataFrame, least: int, share: float) -> DataFrame:
    """nodes (host, segs, n, seen, bad) with `node`, a leaf of the tree: one level at a time, over counts and never over
    pages, until no node has enough pages to be split. A leaf is a node's path and an end: ENDS or BELOW."""
    t = nodes.withColumn("node", F.lit(""))
    closed, level = [], 0
    while True:
        t = t.withColumn("seg", F.get("segs", F.lit(level)))
        whole = t.where("seg is not null").groupBy("host", "node").agg(F.sum("n").alias("whole"))
        # a table: a join right on the aggregate could not split a host that many paths have
        t = space.table(t.join(space.table(whole, "whole"), ["host", "node"], "left"), "level")
        more = F.col("seg").isNotNull() & (F.col("whole") >= least)
        end = F.when(F.col("seg").isNull(), F.lit(ENDS)).otherwise(F.lit(BELOW))
        closed.append(t.where(~more).withColumn("node", F.concat("node", end)).select(*nodes.columns, "node"))
        t = t.where(more)
        if not t.limit(1).count():
            return reduce(DataFrame.unionByName, closed)
        kids = t.groupBy("host", "node", "seg").agg(F.sum("n").alias("kid"), F.first("whole").alias("whole"))
        literal = kids.where((F.col("kid") >= least) & (F.col("kid") >= F.col("whole") * share)).select("host", "node", "seg", F.lit(True).alias("literal"))
        step = F.when(F.col("literal"), F.concat(F.lit("/"), "seg")).otherwise(F.lit("/*"))
        t = t.join(literal, ["host", "node", "seg"], "left").withColumn("node", F.concat("node", step)).select(*nodes.columns, "node")
        level += 1


def parent_of(node: Column) -> Column:
    return F.regexp_replace(node, "/[^/]*$", "")


def clustered(branch: DataFrame, z: float, least_seen: int) -> DataFrame:
    """branch (host, node, seen, bad) with `parent` and `cluster`: siblings in order of their bad share, cut between
    neighbours whose shares differ by more than z standard errors of the difference.

    Branches of under least_seen labelled pages can't differ from anything and would chain those that do; they are one
    cluster, -1, of their parent. Siblings are at most 1 / share literal ones and three more, so a window over them is small.
    """
    b = branch.withColumn("parent", parent_of(F.col("node"))).withColumn("enough", F.col("seen") >= least_seen)
    b = b.withColumn("rate", F.col("bad") / F.greatest(F.col("seen"), F.lit(1)))
    own = Window.partitionBy("host", "parent", "enough").orderBy("rate", "node")
    b = b.withColumns({"seen0": F.lag("seen").over(own), "bad0": F.lag("bad").over(own), "rate0": F.lag("rate").over(own)})
    pool = (F.col("bad") + F.col("bad0")) / F.greatest(F.col("seen") + F.col("seen0"), F.lit(1))
    error = F.sqrt(pool * (1 - pool) * (1 / F.greatest(F.col("seen"), F.lit(1)) + 1 / F.greatest(F.col("seen0"), F.lit(1))))
    apart = F.coalesce(F.col("rate") - F.col("rate0") > z * error, F.lit(False))
    cut = F.sum(apart.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return b.select("host", "node", "parent", "seen", "bad", F.when(F.col("enough"), cut).otherwise(F.lit(-1)).alias("cluster"))


def merge(space: Workspace, leaves: DataFrame, z: float, least_seen: int) -> DataFrame:
    """(host, node, branch, seen, bad): the merged branches, from the deepest level up. Siblings that are all alike make
    their parent one branch, which is compared with its own siblings next."""
    depth = F.size(F.split("node", "/", -1)) - 1
    leaves = space.table(leaves.withColumn("depth", depth), "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    names, up, out = ["host", "node", "seen", "bad"], None, []
    for d in range(deepest, 0, -1):
        here = leaves.where(F.col("depth") == d).select(names)
        m = space.table(clustered(here if up is None else here.unionByName(up), z, least_seen), "siblings")
        kinds = F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster")))
        alike = m.groupBy("host", "parent").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), kinds.alias("kinds")).where((F.col("kinds") <= 1) & F.lit(d > 1))
        up = alike.select("host", F.col("parent").alias("node"), "seen", "bad")
        left = m.join(alike.select("host", "parent"), ["host", "parent"], "left_anti")
        out.append(left.select("host", "node", F.concat_ws("#", "parent", F.col("cluster").cast("string")).alias("branch"), "seen", "bad"))
    if not out:
        return leaves.select("host", "node", F.col("node").alias("branch"), "seen", "bad")
    return reduce(DataFrame.unionByName, out)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: int = 20, share: float = 0.02, z: float = 2.58, least_seen: int = 10, prior: float = 20.0, reject: float = 0.6) -> DataFrame:  # noqa: ANN001
    """page_id, host, path, rule, verdict, template, purity: a row for each row of pages."""
    with Workspace(pages.sparkSession) as space:
        return space.finish(_judge(space, pages, labels, rules, least, share, z, least_seen, prior, reject), "judged")


def _judge(space: Workspace, pages: DataFrame, labels: DataFrame, rules, least: int, share: float, z: float, least_seen: int, prior: float, reject: float) -> DataFrame:  # noqa: ANN001
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.withColumn("segs", F.filter(F.split("path", "/", -1), lambda s: s != ""))
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    marked = at.join(bad, "page_id", "left")
    nodes = marked.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = space.table(templates(space, space.table(nodes, "nodes"), least, share), "tree")
    leaves = space.table(tree.groupBy("host", "node").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")), "branches")
    base = leaves.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("seen"), F.lit(0)), F.lit(1))).alias("base"))
    branches = space.table(merge(space, leaves, z, least_seen), "merged")
    pure = branches.groupBy("host", "branch").agg(((F.sum("bad") + prior * base.scalar()) / (F.sum("seen") + prior)).alias("purity"))
    verdicts = space.table(branches.join(pure, ["host", "branch"]).select("host", F.col("node").alias("at"), "purity"), "verdicts")
    # of a leaf's ancestors and itself, exactly one is a merged branch
    parts = F.split("node", "/", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    placed = leaves.select("host", "node", F.explode(every).alias("at")).join(verdicts, ["host", "at"]).select("host", "node", "purity")
    template = F.when(F.col("node").endswith(ENDS), F.expr(f"left(node, length(node) - {len(ENDS)})")).otherwise(F.concat(F.expr(f"left(node, length(node) - {len(BELOW)})"), F.lit("/**")))
    found = tree.select("host", "segs", "node").join(placed, ["host", "node"]).select("host", "segs", template.alias("template"), "purity")
    out = at.join(space.table(found, "found"), ["host", "segs"], "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")] if rules else F.lit(None).cast("string")
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "template", "purity")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
