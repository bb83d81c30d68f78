"""Quotation linking for conversations, in DataFrame operations only.

A quoted line starts with one or more `>` (blanks between them allowed); their number is its level. Consecutive quoted
lines of one level are a passage. Passages and messages are normalised (ASCII lower case, runs of white space as one
space, trimmed) and hashed. What a message says itself is its lines outside quotes; originals are whole own bodies and
their single lines. A level-1 passage links its message to the latest earlier message of the same conversation whose
own body, or else one of whose own lines, hashes alike, or whose own lines hold those of a passage of several lines, one
after the other (blank lines apart); deeper passages link the messages that they quote on the way.
Messages are given in reply order with their parents and their depth below the first message, without quotes.

Parent: the original of a level-1 passage (the latest if there are several); null where nothing is linked, which
leaves the message a reply to the conversation's turn before it. Null texts are empty and quote nothing; a null
conversation or turn links with nothing. Repeated rows of one (conversation, turn) are kept, each linked alike.
Quoted passages with an empty normal form link with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.stage import Workspace

QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"
BLANKS = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BLANKS, " "))


def digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def own_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(QUOTED))


def passages(lines: Column) -> Column:
    """Array of (level, text, lines): consecutive quoted lines of one level, joined and apart, in order. A fold over one message's lines."""
    empty = F.array().cast("array<struct<level:int,text:string,lines:array<string>,open:boolean>>")

    def step(acc: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        body = F.regexp_replace(line, MARKS, "")
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & last["open"] & (last["level"] == level)
        joined = F.struct(level.alias("level"), F.concat(last["text"], F.lit(" "), body).alias("text"), F.concat(last["lines"], F.array(body)).alias("lines"), F.lit(True).alias("open"))
        fresh = F.struct(level.alias("level"), body.alias("text"), F.array(body).alias("lines"), F.lit(True).alias("open"))
        shut = F.struct(last["level"].alias("level"), last["text"].alias("text"), last["lines"].alias("lines"), F.lit(False).alias("open"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(level == 0, F.when(F.size(acc) > 0, F.concat(head, F.array(shut))).otherwise(acc)).when(same, F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(lines, empty, step)


def said_lines(lines: Column) -> Column:
    """The lines' normal forms, without blank ones."""
    return F.filter(F.transform(lines, normal), lambda x: x != "")


def partly_quoted(space: Workspace, quotes: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, at, pos, level, turn, part: earlier messages whose own lines hold all lines of a passage, one after the other.

    Passages meet messages by their first two lines; the rows of the lines then decide, so no row holds more than a line.
    """
    of = ["conv_id", "at", "pos", "level", "lid"]
    many = quotes.where(F.size("lines") > 1).withColumn("lid", digest(F.array_join("lines", "\n"))).select(*of, "lines").distinct()
    two = lambda a, b: digest(F.concat(a, F.lit("\n"), b))
    own = said.join(many.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("own", said_lines(F.col("own"))).where(F.size("own") > 1)
    own = own.select("conv_id", "turn", digest(F.array_join("own", "\n")).alias("mid"), "own").dropDuplicates(["conv_id", "turn", "mid"])
    rows = own.select("conv_id", "turn", "mid", F.posexplode(F.transform("own", lambda x, i: F.struct(digest(x).alias("line"), two(x, F.get("own", i + 1)).alias("both")))).alias("i", "x"))
    rows = space.table(rows.select("conv_id", "turn", "mid", "i", "x.line", "x.both"), "own-lines")
    begin = many.select(*of, F.size("lines").alias("n"), two(F.get("lines", F.lit(0)), F.get("lines", F.lit(1))).alias("both"))
    begin = begin.join(rows.select("conv_id", "turn", "mid", F.col("i").alias("start"), "both"), ["conv_id", "both"]).where(F.col("turn") < F.col("at"))
    each = begin.join(many.select(*of, F.posexplode(F.transform("lines", digest)).alias("k", "line")), of).withColumn("i", F.col("start") + F.col("k"))
    same = each.join(rows.select("conv_id", "turn", "mid", "i", "line"), ["conv_id", "turn", "mid", "i", "line"])
    same = same.groupBy(*of, "turn", "mid", "start").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where("c = n")
    return same.select("conv_id", "at", "pos", "level", "turn", F.lit(1).alias("part")).distinct()


def link(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """conv_id, turn, role, parent_turn, depth, n_quoted, max_level, n_linked, text: text without quotes.

    Quotes are joined to originals by (conversation, hash), so a conversation with a third of all messages is dealt
    by its hashes. Depths by pointer jumping over linked messages only.
    """
    with Workspace(messages.sparkSession) as space:
        return space.finish(_link(space, messages, max_rounds), "linked")


def _link(space: Workspace, messages: DataFrame, max_rounds: int) -> DataFrame:
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1)
    m = messages.select("conv_id", "turn", "role", lines.alias("lines"))
    quoting = F.exists("lines", lambda x: x.rlike(QUOTED))
    m = m.withColumn("own", F.when(quoting, own_lines(F.col("lines"))).otherwise(F.col("lines")))
    m = m.withColumn("passages", F.when(quoting, passages(F.col("lines"))))
    said = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", "own")
    whole = said.select("conv_id", "turn", F.lit(0).alias("part"), normal(F.array_join("own", " ")).alias("body"))
    parts = said.where(F.size("own") > 1).select("conv_id", "turn", F.lit(1).alias("part"), F.explode("own").alias("body")).withColumn("body", normal(F.col("body")))
    origins = whole.unionByName(parts).where("body <> ''").groupBy("conv_id", digest(F.col("body")).alias("h"), "turn").agg(F.min("part").alias("part"))
    quotes = m.where("passages is not null and conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("at"), F.posexplode("passages").alias("pos", "p"))
    quotes = quotes.select("conv_id", "at", "pos", F.col("p.level").alias("level"), normal(F.col("p.text")).alias("body"), said_lines(F.col("p.lines")).alias("lines")).where("body <> ''").withColumn("h", digest(F.col("body"))).drop("body")
    quotes = space.table(quotes, "passages")
    best = F.max_by("turn", F.struct(-F.col("part"), "turn"))
    found = quotes.drop("lines").distinct().join(origins, ["conv_id", "h"]).where(F.col("turn") < F.col("at"))
    found = found.select("conv_id", "at", "pos", "level", "turn", "part").unionByName(partly_quoted(space, quotes, said)).groupBy("conv_id", "at", "pos", "level").agg(best.alias("turn"))
    found = space.table(found, "quotes")
    parents = found.groupBy("conv_id", "at").agg(F.max(F.when(F.col("level") == 1, F.col("turn"))).alias("parent_turn"), F.count(F.lit(1)).alias("n_linked"))
    # depth: hops to the first message that links nowhere
    hops = parents.where("parent_turn is not null").select("conv_id", F.col("at").alias("node"), F.col("parent_turn").alias("up"), F.lit(1).cast("bigint").alias("hops"))
    for _ in range(max_rounds):
        far = hops.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        step = hops.join(far, ["conv_id", "up"], "left").select("conv_id", "node", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("up2").isNotNull().alias("moved"))
        step = space.table(step, "hops")
        hops = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    depths = hops.select("conv_id", F.col("node").alias("at"), "hops")
    by = parents.join(depths, ["conv_id", "at"], "left").withColumnRenamed("at", "turn")
    n_quoted = F.coalesce(F.size(F.filter("lines", lambda x: x.rlike(QUOTED))), F.lit(0)).cast("bigint")
    level = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("bigint")
    out = m.join(by, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("hops", F.lit(0)).alias("depth"), n_quoted.alias("n_quoted"), level.alias("max_level"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.array_join("own", "\n").alias("text"))


def conversations(linked: DataFrame) -> DataFrame:
    """One row a message, sorted in reply order within each conversation: files of a conversation read in order."""
    return linked.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")


def op7_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB for op7: the same result by regular expressions over single lines.
ORACLE_SQL = r"""
with l as (
  select conv_id, turn, role, rowid_, pos, line, regexp_matches(line, '^[ \t]*>') as q,
         length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) as level,
         regexp_replace(line, '^((?:[ \t]*>)+)', '') as body
  from (select conv_id, turn, role, rowid_, unnest(ls) as line, generate_subscripts(ls, 1) as pos
        from (select conv_id, turn, role, row_number() over () as rowid_, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) as ls from conversations))),
m as (select rowid_, any_value(conv_id) as conv_id, any_value(turn) as turn, any_value(role) as role,
             coalesce(string_agg(line, chr(10) order by pos) filter (where not q), '') as text,
             coalesce(string_agg(line, ' ' order by pos) filter (where not q), '') as flat,
             cast(count(*) filter (where q) as bigint) as n_quoted, cast(max(level) as bigint) as max_level from l group by rowid_),
g as (select *, pos - row_number() over (partition by rowid_, level order by pos) as run from l),
p as (select distinct conv_id, turn as here, level, first_pos, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as body
      from (select conv_id, turn, level, min(pos) as first_pos, string_agg(body, ' ' order by pos) as body from g where q group by rowid_, conv_id, turn, level, run)),
o as (select conv_id, turn, min(part) as part, body from (
        select conv_id, turn, 0 as part, trim(regexp_replace(translate(flat, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as body from m
        union all
        select conv_id, turn, 1, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) from l where not q)
      where body <> '' group by conv_id, turn, body),
f as (select p.conv_id, here, first_pos, level, arg_max(turn, (-part) * 1000000000 + turn) as turn
      from p join o on p.conv_id = o.conv_id and p.body = o.body and o.turn < p.here where p.body <> '' group by p.conv_id, here, first_pos, level),
parents as (select conv_id, here, max(turn) filter (where level = 1) as parent_turn, count(*) as n_linked from f group by conv_id, here),
d as (with recursive up(conv_id, here, cur, hops) as (
        select conv_id, here, parent_turn, 1 from parents where parent_turn is not null
        union all select u.conv_id, u.here, q.parent_turn, u.hops + 1 from up u join parents q on q.conv_id = u.conv_id and q.here = u.cur and q.parent_turn is not null)
      select conv_id, here, max(hops) as hops from up group by conv_id, here)
select m.conv_id, m.turn, m.role, parents.parent_turn, cast(coalesce(d.hops, 0) as bigint) as depth, m.n_quoted, m.max_level,
       cast(coalesce(parents.n_linked, 0) as bigint) as n_linked, m.text
from m left join parents on parents.conv_id = m.conv_id and parents.here = m.turn left join d on d.conv_id = m.conv_id and d.here = m.turn
"""
