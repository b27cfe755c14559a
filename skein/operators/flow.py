"""Greatest flows and least cuts of graphs of any size, as waves of joins over a table of residual arcs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import cut, numbered

#: Arcs of one node that a window puts in order at a time.
BLOCK = 1024
#: Rounds of a search that stay tables of their own until they are written as one.
TABLES = 24


@dataclass(frozen=True)
class Flow:
    """value; arcs(src, dst, capacity, flow) with net flows, or None where only the cut was asked; cut(src, dst,
    capacity) of the least cut nearest the sinks; sink_side(id), all that still reaches a sink."""

    value: int
    arcs: DataFrame | None
    cut: DataFrame
    sink_side: DataFrame


def _distances(residual: DataFrame, goals: DataFrame, barred: DataFrame | None) -> DataFrame:
    """(id, d): fewest residual arcs to a goal(id), of the nodes that reach one; paths don't enter barred(id)."""
    back = residual.where("room > 0").select(F.col("dst").alias("at"), F.col("src").alias("id"))
    back = cut(back if barred is None else back.join(barred, "id", "left_anti"))
    last, hops = cut(goals.select("id", F.lit(0).alias("d"))), 0
    seen = [last]
    while True:
        hops += 1
        near = last.select(F.col("id").alias("at")).join(back, "at").select("id").distinct()
        last = cut(near.join(_all(seen).select("id"), "id", "left_anti").withColumn("d", F.lit(hops)))
        if last.isEmpty():
            return cut(_all(seen))
        seen.append(last)
        if len(seen) == TABLES:
            seen = [cut(_all(seen))]


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _shares(arcs: DataFrame, excess: DataFrame) -> DataFrame:
    """(src, dst, pushed): each node's excess(id, excess) along its arcs(src, dst, block, room), in order, as far as there is room.

    Sums run over blocks of a node first and then inside each, so a hub is many groups.
    """
    live = arcs.join(excess.select(F.col("id").alias("src"), "excess"), "src")
    blocks = live.groupBy("src", "block").agg(F.sum("room").alias("all"))
    blocks = blocks.select("src", "block", (F.sum("all").over(W.partitionBy("src").orderBy("block")) - F.col("all")).alias("before"))
    inside = F.sum("room").over(W.partitionBy("src", "block").orderBy("dst")) - F.col("room")
    pushed = F.greatest(F.least("room", F.col("excess") - F.col("before") - F.col("inside")), F.lit(0))
    return live.withColumn("inside", inside).join(blocks, ["src", "block"]).withColumn("pushed", pushed).where("pushed > 0").select("src", "dst", "pushed")


def _drain(residual: DataFrame, excess: DataFrame, goals: DataFrame, barred: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Waves that carry excess to goals until none of it reaches one: the residual arcs, the excess and the last distances.

    A wave measures distances, then empties the levels from the farthest on, each once. What stays at a node has used up
    all its arcs to the level below, so its distance has grown by the next wave: the waves end.
    """
    while True:
        d = _distances(residual, goals, barred)
        active = cut(excess.where("excess > 0").join(d, "id").where("d > 0"))
        top = active.agg(F.max("d").alias("d")).first()["d"]
        if top is None:
            return residual, excess, d
        down = residual.where("room > 0").join(d.select(F.col("id").alias("src"), F.col("d").alias("level")), "src")
        down = cut(down.join(d.select(F.col("id").alias("dst"), (F.col("d") + 1).alias("level")), ["dst", "level"]).where(F.col("level") <= top))
        here, pushes = active.where(F.col("d") == top).select("id", "excess"), None
        for level in range(top, 0, -1):
            pushed = cut(_shares(down.where(F.col("level") == level), here))
            pushes = pushed if pushes is None else pushes.unionByName(pushed)
            arrived = pushed.select(F.col("dst").alias("id"), F.col("pushed").alias("excess"))
            here = active.where(F.col("d") == level - 1).select("id", "excess").unionByName(arrived).groupBy("id").agg(F.sum("excess").alias("excess"))
        moved = pushes.select("src", "dst", (-F.col("pushed")).alias("change")).unionByName(pushes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("pushed").alias("change")))
        change = moved.groupBy("src", "dst").agg(F.sum("change").alias("change"))
        residual = cut(residual.join(change, ["src", "dst"], "left").withColumn("room", F.col("room") + F.coalesce("change", F.lit(0))).drop("change"))
        ends = pushes.select(F.col("src").alias("id"), (-F.col("pushed")).alias("excess")).unionByName(pushes.select(F.col("dst").alias("id"), F.col("pushed").alias("excess")))
        excess = cut(excess.unionByName(ends).groupBy("id").agg(F.sum("excess").alias("excess")).where("excess > 0"))


def max_flow(arcs: DataFrame, sources: DataFrame, sinks: DataFrame, with_flow: bool = True) -> Flow:
    """The greatest flow of arcs(src, dst, capacity) from sources(id) to sinks(id), and the least cut nearest the sinks.

    Capacities are whole numbers; those of parallel arcs add up, none or a negative one counts as 0. Loops and rows without
    an end are left out. Without a source, a sink or a way between, the value is 0. A node that is both is an error.
    with_flow=False stops once the cut is known and saves carrying back what no sink can take.
    """
    s = cut(sources.where("id IS NOT NULL").select("id").distinct())
    t = cut(sinks.where("id IS NOT NULL").select("id").distinct())
    if not s.join(t, "id", "left_semi").isEmpty():
        raise ValueError("a node is a source and a sink")
    given = arcs.where("src <> dst").groupBy("src", "dst").agg(F.sum(F.greatest(F.coalesce(F.col("capacity").cast("long"), F.lit(0)), F.lit(0))).alias("capacity")).where("capacity > 0")
    # No greatest flow needs an arc into a source or out of a sink.
    given = given.join(s.withColumnRenamed("id", "dst"), "dst", "left_anti").join(t.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "capacity")
    given = cut(given)
    first = given.join(s.withColumnRenamed("id", "src"), "src", "left_semi")
    filled = first.select("src", "dst", F.lit(True).alias("filled"))
    ways = given.join(filled, ["src", "dst"], "left").select("src", "dst", F.when(F.col("filled"), F.lit(0)).otherwise(F.col("capacity")).alias("room"))
    ways = ways.unionByName(given.join(filled, ["src", "dst"], "left").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("filled"), F.col("capacity")).otherwise(F.lit(0)).alias("room")))
    residual = numbered(ways.groupBy("src", "dst").agg(F.sum("room").alias("room")), ["src", "dst"], "n")
    residual = cut(residual.select("src", "dst", F.floor(F.col("n") / BLOCK).alias("block"), "room"))
    excess = cut(first.groupBy(F.col("dst").alias("id")).agg(F.sum("capacity").alias("excess")))
    residual, excess, d = _drain(residual, excess, t, s)
    value = excess.join(t, "id", "left_semi").agg(F.coalesce(F.sum("excess"), F.lit(0)).alias("v")).first()["v"]
    side = d.select("id")
    parted = given.join(side.withColumnRenamed("id", "dst"), "dst", "left_semi").join(side.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "capacity")
    flows = None
    if with_flow:
        rest = cut(excess.join(t, "id", "left_anti").join(s, "id", "left_anti"))
        residual, _, _ = _drain(residual, rest, s, t)
        net = given.join(residual.select("src", "dst", "room"), ["src", "dst"])
        # Of two opposite arcs the one whose room has shrunk carries the difference.
        flows = net.select("src", "dst", "capacity", F.greatest(F.col("capacity") - F.col("room"), F.lit(0)).alias("flow"))
    return Flow(value, flows, parted, side)


def vertex_cut(edges: DataFrame, sources: DataFrame, targets: DataFrame, weights: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(id, weight): the nodes of least total weight, nearest the targets, without which no path leads from sources(id) to targets(id).

    weights(id, weight) are whole numbers, 1 where there is none; nodes of weight 0 cost nothing. Sources and targets stay; an
    edge between two of them, or a node that is both, is an error: nothing separates these.
    """
    ways = edges.where("src <> dst").select("src", "dst")
    if not directed:
        ways = ways.unionByName(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = cut(ways.distinct())
    ends = sources.select("id").unionByName(targets.select("id")).distinct().withColumn("end", F.lit(True))
    if not sources.join(targets, "id", "left_semi").isEmpty() or not ways.join(sources.withColumnRenamed("id", "src"), "src", "left_semi").join(targets.withColumnRenamed("id", "dst"), "dst", "left_semi").isEmpty():
        raise ValueError("a source is a target or next to one")
    nodes = ways.select(F.col("src").alias("id")).unionByName(ways.select(F.col("dst").alias("id"))).distinct()
    own = F.lit(1).cast("long")
    if weights is not None:
        nodes = nodes.join(weights.groupBy("id").agg(F.max(F.col("weight").cast("long")).alias("weight")), "id", "left")
        own = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(0)).cast("long")
    nodes = cut(nodes.join(ends, "id", "left").select("id", F.when(F.col("end"), F.lit(None)).otherwise(own).alias("weight")))
    into, out = lambda c: F.concat(F.lit("i:"), c), lambda c: F.concat(F.lit("o:"), c)
    # An edge has more room than the lighter of its ends, so no least cut has edges.
    w = lambda c, name: nodes.select(F.col("id").alias(c), F.col("weight").alias(name))
    wide = ways.join(w("src", "a"), "src").join(w("dst", "b"), "dst").where("a IS NOT NULL OR b IS NOT NULL")
    arcs = wide.select(out(F.col("src")).alias("src"), into(F.col("dst")).alias("dst"), (F.least("a", "b") + 1).alias("capacity"))
    arcs = arcs.unionByName(nodes.where("weight IS NOT NULL").select(into(F.col("id")).alias("src"), out(F.col("id")).alias("dst"), F.col("weight").alias("capacity")))
    found = max_flow(arcs, sources.select(out(F.col("id")).alias("id")), targets.select(into(F.col("id")).alias("id")), with_flow=False)
    free = found.sink_side.where("id LIKE 'o:%'").select(F.substring("id", 3, 1 << 30).alias("id"))
    shut = found.sink_side.where("id LIKE 'i:%'").select(F.substring("id", 3, 1 << 30).alias("id"))
    return nodes.where("weight > 0").join(free, "id", "left_semi").join(shut, "id", "left_anti")
