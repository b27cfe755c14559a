"""Taint through nested branches: every use of a variable is joined with the definitions that reach it.

Branches become tables of arms; where arms meet, a variable has a definition of its own that all of them feed. Tags then
follow these links, so a function is never one array or one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import closure, cut, fixpoint, numbered

#: Events of a function that a window puts in order at a time.
BLOCK = 4096
ROOT = -1
WRITES = "source", "assign", "mutate", "sanitise"
MARKS = {"open": 1, "close": -1}


def _depths(rows: DataFrame) -> DataFrame:
    """rows(fn, at, op) with depth, the open branches after the row, and stray where a mark belongs to none.

    A close without an open changes nothing: the depth is the running sum above its own lowest value so far.
    """
    step = F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in MARKS.items()], F.lit(0))
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("step", step)
    inner = W.partitionBy("fn", "block").orderBy("at")
    rows = rows.withColumn("sum", F.sum("step").over(inner)).withColumn("low", F.min("sum").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    blocks = rows.groupBy("fn", "block").agg(F.sum("step").alias("all"), F.min("low").alias("least"))
    outer = W.partitionBy("fn").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("all").over(outer) - F.col("all")).withColumn("least", F.col("before") + F.col("least"))
    blocks = blocks.withColumn("floor", F.least(F.coalesce(F.min("least").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.lit(0)))
    rows = rows.join(blocks.select("fn", "block", "before", "floor"), ["fn", "block"])
    total, low = F.col("before") + F.col("sum"), F.least(F.col("floor"), F.col("before") + F.col("low"))
    rows = rows.withColumn("depth", (total - low).cast("int"))
    was_low = F.least(F.col("floor"), F.col("before") + F.coalesce(F.lag("low").over(inner), F.lit(0)))
    return rows.withColumn("stray", ((F.col("op") == "else") & (F.col("depth") == 0)) | ((F.col("op") == "close") & (total < was_low))).drop("block", "step", "sum", "low", "before", "floor")


def latest(asked: DataFrame, marks: DataFrame, by: list[str], name: str) -> DataFrame:
    """asked(by, at, ...) with the largest at of marks(by, at) below its own as column name, null if there is none.

    Looks inside blocks of a group first; what a block lacks comes from the blocks before it.
    """
    both = asked.withColumn("_mark", F.lit(None).cast("long")).unionByName(marks.select(*by, "at", F.col("at").alias("_mark")), allowMissingColumns=True).withColumn("_block", F.floor(F.col("at") / BLOCK))
    both = both.withColumn("_own", F.max("_mark").over(W.partitionBy(*by, "_block").orderBy("at").rangeBetween(W.unboundedPreceding, -1)))
    blocks = both.groupBy(*by, "_block").agg(F.max("_mark").alias("_mark"))
    blocks = blocks.withColumn("_far", F.max("_mark").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_mark")
    out = both.where("_mark IS NULL").join(blocks, [*by, "_block"], "left")
    return out.withColumn(name, F.coalesce("_own", "_far")).select(*asked.columns, name)


def branch_environment(events: DataFrame) -> DataFrame:
    """(fn, variable, tags array<string>): what each variable may hold after a function's events; none without tags.

    events(fn, seq, op, target, inputs array<string>, tags array<string>), in order of seq, then op and target. op source
    sets the tags, assign joins those of its inputs, mutate adds them to the target's, sanitise clears. open starts a
    branch, else another arm of it, close ends it; there an environment joins those of the arms, and that before the branch
    if it has no else. Branches left open end with the function; else and close without an open, other ops, and rows
    without fn or seq count for nothing. Null inputs and tags are empty. An empty table has no rows.
    """
    events = events.where("fn IS NOT NULL AND seq IS NOT NULL").select("fn", "seq", "op", "target", "inputs", "tags")
    rows = cut(_depths(numbered(events, ["fn", "seq", "op", "target"], "at").drop("seq")).where("NOT stray").drop("stray"))
    ends = rows.groupBy("fn").agg(F.max(F.struct("at", "depth")).alias("e")).where("e.depth > 0").select("fn", F.explode(F.sequence(F.lit(1), "e.depth")).alias("k"), "e")
    ends = ends.select("fn", F.lit("close").alias("op"), (F.col("e.at") + F.col("k")).alias("at"), (F.col("e.depth") - F.col("k")).cast("int").alias("depth"))
    rows = rows.unionByName(ends, allowMissingColumns=True)

    # Arms by their first mark; the one around a row at some depth is the last one that began there.
    starts = rows.where("op IN ('open', 'else')").select("fn", F.col("depth").alias("level"), "at")
    opens = rows.where("op = 'open'").select("fn", F.col("depth").alias("level"), "at")
    marks = rows.where("op IN ('open', 'else', 'close')").select("fn", "op", "at", F.when(F.col("op") == "close", F.col("depth") + 1).otherwise(F.col("depth")).alias("level"))
    outer = latest(marks.withColumn("level", F.col("level") - 1), starts, ["fn", "level"], "outer").withColumn("level", F.col("level") + 1)
    inner = latest(latest(outer, starts, ["fn", "level"], "arm"), opens, ["fn", "level"], "branch")
    inner = cut(inner.select("fn", "op", "at", "level", F.coalesce("outer", F.lit(ROOT)).alias("outer"), "arm", "branch"))
    parents = inner.where("op IN ('open', 'else')").select("fn", F.col("at").alias("arm"), "outer")
    around = cut(closure(parents.select("fn", "arm", F.col("arm").alias("around")), parents.select("fn", F.col("arm").alias("around"), F.col("outer").alias("next")), ["fn", "arm", "around"], lambda f, e: f.join(e, ["fn", "around"]).select("fn", "arm", F.col("next").alias("around"))))

    writes = rows.where(F.col("op").isin(*WRITES) & F.col("target").isNotNull()).withColumn("level", F.col("depth"))
    writes = latest(writes.select("fn", "level", "at", "op", "target", "inputs", "tags"), starts, ["fn", "level"], "arm").withColumn("arm", F.coalesce("arm", F.lit(ROOT)))
    writes = cut(writes.select("fn", "arm", "at", "op", "target", "inputs", "tags"))

    # A variable written in a branch is written once more where the branch ends.
    closes = inner.where("op = 'close'").select("fn", "branch", F.col("at").alias("shut"), F.col("outer").alias("after"))
    of_arm = inner.where("op = 'open'").select("fn", F.col("at").alias("arm"), F.col("at").alias("branch")).unionByName(inner.where("op = 'else'").select("fn", F.col("at").alias("arm"), "branch"))
    touched = writes.select("fn", "arm", "target").distinct().join(around, ["fn", "arm"]).select("fn", F.col("around").alias("arm"), "target").join(of_arm, ["fn", "arm"])
    merges = cut(touched.join(closes, ["fn", "branch"]).select("fn", "branch", F.col("target").alias("variable"), "shut", "after").distinct())
    defs = writes.select("fn", "arm", F.col("target").alias("variable"), "at").unionByName(merges.select("fn", F.col("after").alias("arm"), "variable", F.col("shut").alias("at")))

    # What each definition reads, from which arm and where.
    read = F.when(F.col("op") == "assign", F.coalesce("inputs", F.array().cast("array<string>"))).when(F.col("op") == "mutate", F.array_append(F.coalesce("inputs", F.array().cast("array<string>")), F.col("target"))).otherwise(F.array().cast("array<string>"))
    uses = writes.select("fn", F.col("target").alias("to_variable"), F.col("at").alias("to"), "arm", "at", F.explode(F.array_distinct(read)).alias("variable"))
    ended = inner.where("op IN ('else', 'close')").select("fn", "branch", "arm", "at")
    skipped = inner.where("op = 'open'").select("fn", F.col("at").alias("branch"), F.col("outer").alias("arm"), "at").join(inner.where("op = 'else'").select("fn", "branch"), ["fn", "branch"], "left_anti")
    meets = merges.join(ended.unionByName(skipped), ["fn", "branch"]).select("fn", F.col("variable").alias("to_variable"), F.col("shut").alias("to"), "arm", "at", "variable")
    final = defs.select("fn", "variable").distinct().select("fn", F.col("variable").alias("to_variable"), F.lit(1 << 62).alias("to"), F.lit(ROOT).cast("long").alias("arm"), F.lit(1 << 62).alias("at"), "variable")
    uses = cut(uses.unionByName(meets).unionByName(final))
    # A definition in an arm is later than any before the arm, so the latest in all arms around is the one that holds.
    everywhere = uses.join(around, ["fn", "arm"], "left").select("fn", "to_variable", "to", "variable", "at", F.explode(F.array_distinct(F.array(F.coalesce("around", "arm"), "arm"))).alias("arm"))
    met = latest(everywhere.distinct(), defs, ["fn", "arm", "variable"], "from")
    feeds = cut(met.groupBy("fn", "to_variable", "to", "variable", "at").agg(F.max("from").alias("from")).where("from IS NOT NULL").select("fn", F.col("variable").alias("from_variable"), "from", "to_variable", "to").distinct())

    # Chains of definitions with one input are passed by doubling; what is left are sources, meetings and what joins several.
    key = ["fn", "to_variable", "to"]
    fresh = writes.where("op = 'source'").select("fn", F.col("target").alias("to_variable"), F.col("at").alias("to"))
    single = feeds.join(feeds.groupBy(*key).count().where("count = 1").select(*key), key, "left_semi").join(fresh, key, "left_anti").withColumn("moved", F.lit(True))

    def jump(state: DataFrame, _: int) -> DataFrame:
        further = state.select("fn", F.col("to_variable").alias("from_variable"), F.col("to").alias("from"), F.col("from_variable").alias("v"), F.col("from").alias("p"))
        got = state.join(further, ["fn", "from_variable", "from"], "left")
        return got.select("fn", F.coalesce("v", "from_variable").alias("from_variable"), F.coalesce("p", "from").alias("from"), "to_variable", "to", F.col("p").isNotNull().alias("moved"))

    roots = fixpoint(single, jump, lambda _, new: new.where("moved").isEmpty(), 64, "chains").drop("moved")
    rest = feeds.join(roots.select(*key), key, "left_anti")
    hop = roots.select("fn", F.col("to_variable").alias("from_variable"), F.col("to").alias("from"), F.col("from_variable").alias("v"), F.col("from").alias("p"))
    links = cut(rest.join(hop, ["fn", "from_variable", "from"], "left").select("fn", F.coalesce("v", "from_variable").alias("variable"), F.coalesce("p", "from").alias("at"), "to_variable", "to").distinct())
    seeds = writes.where("op = 'source'").select("fn", F.col("target").alias("variable"), "at", F.explode("tags").alias("tag")).where("tag IS NOT NULL")
    held = closure(seeds, links, ["fn", "variable", "at", "tag"], lambda f, e: f.join(e, ["fn", "variable", "at"]).select("fn", F.col("to_variable").alias("variable"), F.col("to").alias("at"), "tag"))
    last = feeds.where(F.col("to") == (1 << 62)).select("fn", "to_variable", "to")
    through = roots.join(last, key, "left_semi").select("fn", F.col("from_variable").alias("variable"), F.col("from").alias("at"), F.col("to_variable").alias("out")).join(held, ["fn", "variable", "at"]).select("fn", F.col("out").alias("variable"), "tag")
    found = held.where(F.col("at") == (1 << 62)).select("fn", "variable", "tag").unionByName(through).distinct()
    return found.groupBy("fn", "variable").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
