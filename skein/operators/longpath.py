"""Distances, reachability and strong components where paths are long: graphs are contracted before anything walks them.

Distances: a node whose ways in are settled by where a path goes next (one node before it, or two between which paths
only pass, or nowhere to go) is left out; every arc follows the single arc before it, by pointer doubling, back to
a node that stays. Chains, trees and rings, and what turns into them when others are gone, end in logarithmically many
rounds. A frontier walks what is left, in runs that are merged when they have grown as large as the run before, so that
what is known is rewritten a logarithmic number of times. Strong components leave out sources, sinks and chains
likewise and merge nodes that have a single way in or out.
Results are exact at any size and no number of rounds is an error; a core that contraction doesn't shrink (a grid)
takes as many rounds as its longest shortest path has arcs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import Runs, cut, numbered
from .traverse import both_ways, components, strongly_connected

#: Nodes next to each other in an order, and arcs among these, that a task merges at a time.
BLOCK, BLOCK_ARCS = 1 << 18, 1 << 21
#: Contraction goes on while it takes away at least this part of the arcs.
LEAST_SHRINK = 0.1


def _contracted(arcs: DataFrame, stays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arcs(src, dst, w) between nodes that stay, and entries(id, origin, w): the last of these before a node left out."""
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    out = arcs.join(into.withColumnRenamed("id", "src"), "src", "left")
    passing = (F.col("n") == 1) | ((F.col("n") == 2) & F.col("dst").isin(F.col("lo"), F.col("hi")))
    ways = out.groupBy(F.col("src").alias("id")).agg(F.bool_and(F.coalesce(passing, F.lit(False))).alias("passing"))
    kept = stays.withColumn("stays", F.lit(True))
    # A node without ways in that is no source is never reached: its arcs go.
    flags = cut(into.join(ways, "id", "full").join(kept, "id", "left").select("id", "n", "lo", "hi", (F.col("stays").isNull() & F.coalesce("passing", F.lit(True))).alias("left_out"), (F.col("n").isNull() & F.col("stays").isNull()).alias("dead")))
    start = arcs.join(flags.withColumnRenamed("id", "src"), "src").where("not dead").withColumn("before", F.when(F.col("n") == 1, F.col("lo")).when(F.col("dst") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    # A node behind which there is only the one it came from leads nowhere.
    start = start.where("not left_out OR before <> dst")
    state = cut(start.select("src", "dst", "w", F.when(F.col("left_out"), F.col("before")).alias("a"), F.when(F.col("left_out"), F.col("src")).alias("b"), F.when(~F.col("left_out"), F.col("src")).alias("origin")))
    open_arcs = state.where("origin IS NULL").count()
    while open_arcs:
        earlier = state.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("more"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("origin").alias("found"))
        moved = state.where("origin IS NULL").drop("origin").join(earlier, ["a", "b"]).select("src", "dst", (F.col("w") + F.col("more")).alias("w"), F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("found").alias("origin"))
        state = cut(state.where("origin IS NOT NULL").unionByName(moved))
        was, open_arcs = open_arcs, state.where("origin IS NULL").count()
        if open_arcs == was:
            # Every chain with an end has arcs that are found in each round: what is left are rings that nothing enters.
            break
    ends = state.where("origin IS NOT NULL AND origin <> dst").join(flags.select(F.col("id").alias("dst"), "left_out"), "dst")
    found = cut(ends.groupBy(F.col("origin").alias("src"), "dst", "left_out").agg(F.min("w").alias("w")))
    return found.where("not left_out").select("src", "dst", "w"), found.where("left_out").select(F.col("dst").alias("id"), F.col("src").alias("origin"), "w")


def _walk(arcs: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """start(*keys, hops) and the least hops of all that arcs lead to; the last key is id."""
    known = Runs(lambda rows: rows.groupBy(keys).agg(F.min("hops").alias("hops")))
    frontier, size = start, start.count()
    while size:
        known.add(frontier, size)
        near = frontier.withColumnRenamed("id", "src").join(arcs, "src").select(*keys[:-1], F.col("dst").alias("id"), (F.col("hops") + F.col("w")).alias("hops"))
        near = near.groupBy(keys).agg(F.min("hops").alias("hops")).alias("near")
        better = [F.col(f"near.{k}") == F.col(f"known.{k}") for k in keys] + [F.col("known.hops") <= F.col("near.hops")]
        frontier = cut(near.join(known.all().alias("known"), better, "left_anti"))
        size = frontier.count()
    return known.all().groupBy(keys).agg(F.min("hops").alias("hops")) if known.tables else start


def _distances(edges: DataFrame, start: DataFrame, keys: list[str], directed: bool) -> DataFrame:
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    arcs = cut((rows.select("src", "dst").distinct() if directed else both_ways(rows)).withColumn("w", F.lit(1).cast("long")))
    start = cut(start)
    stays = cut(start.select("id").distinct())
    entries, size = [], arcs.count()
    while size:
        arcs, left = _contracted(arcs, stays)
        entries.append(left)
        was, size = size, arcs.count()
        if size > was * (1 - LEAST_SHRINK):
            break
    found = cut(_walk(arcs, start, keys) if size else start)
    for left in reversed(entries):
        behind = left.join(found.withColumnRenamed("id", "origin"), "origin").groupBy(keys).agg(F.min(F.col("hops") + F.col("w")).alias("hops"))
        found = cut(found.unionByName(behind))
    return found


def distances(edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(source, id, hops long) of every node that a source(id) reaches along edges(src, dst), itself with 0 hops.

    Null ends and null sources are dropped, loops and repeated edges change nothing; a source that no edge has is
    there with itself; of no sources or no edges nothing else comes.
    """
    start = sources.where("id IS NOT NULL").select(F.col("id").alias("source"), "id").distinct().withColumn("hops", F.lit(0).cast("long"))
    return _distances(edges, start, ["source", "id"], directed)


def nearest(edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(id, hops long): how far the nearest source(id) is, for nodes that one reaches; cases as in distances."""
    start = sources.where("id IS NOT NULL").select("id").distinct().withColumn("hops", F.lit(0).cast("long"))
    return _distances(edges, start, ["id"], directed)


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id): entries(id) and everything that directed paths of any length lead to."""
    return nearest(edges, entries).select("id")


def chain_ends(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of links(way, id, next), a single next for each (way, id): (way, id, end), the first node along next without one; and
    links(way, id, next) of ids that only lead round a ring."""
    ids = links.select("way", F.col("id").alias("next"), F.lit(True).alias("more"))
    state = cut(links.join(ids, ["way", "next"], "left").select("way", "id", "next", F.col("more").isNull().alias("done")))
    open_links = state.where("not done").count()
    while open_links:
        ahead = state.select("way", F.col("id").alias("next"), F.col("next").alias("then"), F.col("done").alias("ends"))
        moved = state.where("not done").join(ahead, ["way", "next"]).select("way", "id", F.col("then").alias("next"), F.col("ends").alias("done"))
        state = cut(state.where("done").unionByName(moved))
        was, open_links = open_links, state.where("not done").count()
        if open_links == was:
            break
    return state.where("done").select("way", "id", F.col("next").alias("end")), links.join(state.where("not done").select("way", "id"), ["way", "id"], "left_semi")


def _merged(arcs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """arcs(src, dst) after nodes with a single way out (or in) were merged with the node there, and (id, partner, other) of these.

    other are the nodes of the remaining ways in (or out): id is in its partner's component if one of them is. No partner is
    merged itself: of partners that could be, coins that change with every turn decide.
    """
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
    single = into.join(out, "id", "full").select("id", F.when(F.col("n_out") == 1, F.lit(1)).when(F.col("n_in") == 1, F.lit(0)).alias("way"), "before", "after").where("way IS NOT NULL")
    single = cut(single.select("id", "way", F.when(F.col("way") == 1, F.col("after")).otherwise(F.col("before")).alias("partner")).where("partner IS NOT NULL"))
    coin = F.xxhash64("id", F.lit(turn)) % 2 == 0
    tossed = single.join(single.select(F.col("id").alias("partner"), F.lit(True).alias("too")), "partner", "left").select("id", "way", "partner", (coin | F.col("too").isNull()).alias("head"))
    tossed = cut(tossed)
    heads = tossed.select(F.col("id").alias("partner"), F.col("head").alias("other_head"))
    gone = cut(tossed.join(heads, "partner", "left").where("head AND NOT coalesce(other_head, false)").select("id", "way", "partner"))
    ends = arcs.join(gone.select(F.col("id").alias("src"), F.col("way").alias("src_way"), F.col("partner").alias("src_to")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.col("way").alias("dst_way"), F.col("partner").alias("dst_to")), "dst", "left")
    # An arc out of a node with one way out, or into a node with one way in, is that way: it goes.
    ends = cut(ends.where("coalesce(src_way, 0) <> 1 AND coalesce(dst_way, 1) <> 0").select("src", "dst", "src_way", "dst_way", F.coalesce("src_to", "src").alias("a"), F.coalesce("dst_to", "dst").alias("b")))
    merged = ends.where("dst_way = 1").select(F.col("dst").alias("id"), F.col("b").alias("partner"), F.col("a").alias("other")).unionByName(ends.where("src_way = 0").select(F.col("src").alias("id"), F.col("a").alias("partner"), F.col("b").alias("other")))
    return cut(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()), cut(merged.distinct())


def _joined(label: DataFrame, left_out: DataFrame) -> DataFrame:
    """(id, component) of left_out(id, partner, other) with a partner and another in one component by label(id, component)."""
    found = left_out.join(label.select(F.col("id").alias("partner"), F.col("component").alias("p")), "partner", "left").join(label.select(F.col("id").alias("other"), F.col("component").alias("o")), "other", "left")
    shared = F.coalesce("p", "partner")
    return found.where(shared == F.coalesce("o", "other")).select("id", shared.alias("component")).distinct()


def _strong(first: list[int], to: list[int]) -> list[int]:
    """A node of its strong component for each node of a small graph, whose arcs lead to to[first[v]:first[v + 1]]: one search in depth."""
    n = len(first) - 1
    at, number, label = first[:n], [-1] * n, [-1] * n
    met, bounds, count = [], [], 0
    for start in range(n):
        way = [start] if number[start] < 0 else []
        while way:
            v = way[-1]
            if number[v] < 0:
                number[v], count = count, count + 1
                met.append(v)
                bounds.append(number[v])
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if number[w] < 0:
                    way.append(w)
                elif label[w] < 0:
                    while bounds[-1] > number[w]:
                        bounds.pop()
                continue
            way.pop()
            if bounds[-1] == number[v]:
                bounds.pop()
                while label[v] < 0:
                    label[met.pop()] = v
    return label


def _blocks_merged(arcs: DataFrame, order: DataFrame, block: int) -> tuple[DataFrame, DataFrame, bool]:
    """arcs(src, dst) after components within blocks of so many nodes along order(id, at) were merged, (id, root) of these,
    and whether one block had all arcs, so that what is left has no components."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    place = cut(numbered(ends.join(order, "id"), ["at", "id"], "n").select("id", "n"))
    near = arcs.join(place.toDF("src", "x"), "src").join(place.toDF("dst", "y"), "dst").withColumn("block", F.floor(F.col("x") / block))
    near = cut(near.where(F.col("block") == F.floor(F.col("y") / block)).select("block", "x", "y"))
    sizes = near.groupBy("block").agg(F.count(F.lit(1)).alias("k"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([rows["x"], rows["y"]]), return_inverse=True)
        src, dst = at[: len(rows)], at[len(rows) :]
        by = np.argsort(src, kind="stable")
        root = names[_strong(np.searchsorted(src[by], np.arange(len(names) + 1)).tolist(), dst[by].tolist())]
        return pd.DataFrame({"n": names, "root": root})[root != names]

    found = near.join(sizes.where(F.col("k") <= BLOCK_ARCS), "block").select("block", "x", "y").groupBy("block").applyInPandas(merge, "n long, root long")
    merged = cut(found.join(place, "n").select("id", F.col("root").alias("n")).join(place.toDF("root", "n"), "n").select("id", "root"))
    moved = arcs.join(merged.toDF("src", "a"), "src", "left").join(merged.toDF("dst", "b"), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    total, most = sizes.agg(F.sum("k"), F.max("k")).first()
    whole = total == most and total <= BLOCK_ARCS and total == arcs.count() if total else False
    return cut(moved.where("src <> dst").distinct()), merged, whole


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, order: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(id, component): the smallest id of the strongly connected component, of the edges' ends and of nodes(id).

    Null ids are dropped, loops and repeated edges change nothing. A chain lies in the component
    of its ends if these share one, else its nodes are their own. Where most arcs are short along order(id, at), whatever their
    direction, components within blocks of it are merged in tasks first, again while that shrinks the graph; the rest is as without.
    """
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    ids = rows.select(F.explode(F.array("src", "dst")).alias("id"))
    ids = cut((ids if nodes is None else ids.unionByName(nodes.select("id").where("id IS NOT NULL"))).distinct())
    arcs = cut(rows.where("src <> dst").distinct())
    blocks, steps, settled = [], [], []
    size = arcs.count()
    if order is not None:
        order = order.where("id IS NOT NULL").groupBy("id").agg(F.min("at").alias("at"))
    while size and order is not None:
        arcs, merged, whole = _blocks_merged(arcs, order, block)
        blocks.append(merged)
        was, size = size, 0 if whole else arcs.count()
        if size > was * (1 - LEAST_SHRINK):
            break
    while size:
        into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
        out = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
        flags = cut(into.join(out, "id", "full"))
        alone = flags.where("n_in IS NULL OR n_out IS NULL").select("id")
        inner = flags.where("n_in = 1 AND n_out = 1")
        links = inner.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("before").alias("next")), F.struct(F.lit(1).alias("way"), F.col("after").alias("next")))).alias("x"), "id").select("x.way", "id", "x.next")
        ends, rings = chain_ends(cut(links))
        first = ends.where("way = 0").select("id", F.col("end").alias("head"))
        chain = cut(first.join(ends.where("way = 1").select("id", F.col("end").alias("tail")), "id"))
        rings = rings.where("way = 1")
        if not rings.isEmpty():
            settled.append(components(rings.select(F.col("id").alias("src"), F.col("next").alias("dst"))))
        gone = alone.unionByName(inner.select("id"))
        left = arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        over = chain.where("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst")).distinct()
        over = over.join(alone.withColumnRenamed("id", "src"), "src", "left_anti").join(alone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        arcs, merged = _merged(cut(left.unionByName(over).distinct()), len(steps))
        steps.append((chain, merged))
        was, size = size, arcs.count()
        if size > was * (1 - LEAST_SHRINK):
            break
    if size:
        settled.append(strongly_connected(arcs, arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()))
    label = cut(reduce(DataFrame.unionByName, settled) if settled else ids.limit(0).select("id", F.col("id").alias("component")))
    for chain, merged in reversed(steps):
        # Nodes without a label are their own component.
        label = cut(label.unionByName(_joined(label, merged.select("id", "partner", "other"))))
        label = cut(label.unionByName(_joined(label, chain.select("id", F.col("head").alias("partner"), F.col("tail").alias("other")))))
    for merged in reversed(blocks):
        label = cut(label.unionByName(merged.join(label.toDF("root", "component"), "root", "left").select("id", F.coalesce("component", "root").alias("component"))))
    root = ids.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("root"))
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")
