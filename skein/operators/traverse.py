"""Reachability, distances, components, paths and shortest paths as loops of joins or recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import Runs, closure, cut, fixpoint

MOST_ROUNDS = 500
LEAST_COST = 1e-6


def both_ways(edges: DataFrame) -> DataFrame:
    rows = edges.where("src <> dst").select("src", "dst")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): smallest id that undirected paths reach. Minimum labels with pointer jumping.

    Nodes without edges are their own component where `nodes(id)` is given.
    """
    both = cut(both_ways(edges))
    ids = both.select(F.col("src").alias("id")).distinct() if nodes is None else nodes.select("id").distinct()

    def step(labels: DataFrame, _: int) -> DataFrame:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("new"), "component")
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        return new.join(jump, "new", "left").select("id", F.least("new", F.coalesce("jump", "new")).alias("component"), (F.least("new", F.coalesce("jump", "new")) < F.col("component")).alias("moved"))

    start = ids.select("id", F.col("id").alias("component"), F.lit(True).alias("moved"))
    done = fixpoint(start, lambda s, i: step(s.select("id", "component"), i), lambda _, new: new.where("moved").isEmpty(), MOST_ROUNDS, "components")
    return done.select("id", "component")


def components_without(edges: DataFrame, nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Components after the nodes removed(id) are gone."""
    gone = removed.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return components(left, nodes.join(gone, "id", "left_anti"))


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id): entries(id) and everything that directed paths lead to."""
    return closure(entries.select("id"), edges.select("src", "dst"), ["id"], lambda f, e: f.join(e, f["id"] == e["src"]).select(e["dst"].alias("id")))


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id): targets(id) and everything that reaches them; with callers as src, the closure of "calls a source"."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets)


def entailed(edges: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, entailed): definite Horn clauses have the reachable nodes as their least model."""
    return targets.select("id").distinct().join(reachable(edges, entries).withColumn("r", F.lit(True)), "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("entailed"))


def hop_distances(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """(source, id, hops) of every node that a source(id) reaches, a round a hop; longpath.distances is for long paths."""
    links = cut(edges.select("src", "dst").distinct() if directed else both_ways(edges))
    frontier = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")).distinct())
    seen, hop = Runs(), 0
    while size := frontier.count():
        seen.add(frontier, size)
        hop += 1
        near = frontier.join(links, frontier["id"] == links["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = cut(near.join(seen.all(), ["source", "id"], "left_anti").select("source", "id", F.lit(hop).alias("hops")))
    return seen.all() if seen.tables else frontier


def strongly_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): smallest id of the strongly connected component, by forward and backward colours.

    Each round colours nodes by the largest id that reaches them and settles those that reach their colour's
    root in the same colour. Colours move an arc a round; longpath.strong_components contracts long paths first.
    """
    left = cut(nodes.select("id").distinct())
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found: DataFrame | None = None
    while not left.isEmpty():
        live = cut(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))

        def colour(state: DataFrame, _: int, live: DataFrame = live) -> DataFrame:
            near = live.join(state.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("near"))
            new = state.join(near, "id", "left")
            return new.select("id", F.greatest("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") > F.col("colour")).alias("moved"))

        colours = fixpoint(left.select("id", F.col("id").alias("colour"), F.lit(True).alias("moved")), colour, lambda _, new: new.where("moved").isEmpty(), None, "colours").select("id", "colour")
        same = live.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
        done = cut(reaching_in_colour(same, colours).withColumnRenamed("colour", "root"))
        named = done.groupBy("root").agg(F.min("id").alias("component"))
        part = cut(done.join(named, "root").select("id", "component"))
        found = part if found is None else cut(found.unionByName(part))
        left = cut(left.join(done, "id", "left_anti"))
    return found if found is not None else nodes.select("id", F.col("id").alias("component"))


def reaching_in_colour(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(id, colour) of nodes that reach the root of their colour along edges within it."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("id"))
    roots = colours.where("id = colour").select("id", "colour")
    return closure(roots, back, ["id", "colour"], lambda f, e: f.select(F.col("id").alias("at"), "colour").join(e, "at").select("id", "colour"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes; of ties that with the smallest id."""
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(best), "component").select("id", "component")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_nodes: int = 5) -> DataFrame:
    """(source, target, n_edges, nodes, relations): simple paths that stop at their first target.

    max_nodes bounds the nodes of a path. Parallel edges give a path each. Grows one edge a round, so paths are
    joined and never held on the driver; their number is exponential in max_nodes.
    """
    e = edges.select("src", "dst", F.coalesce(F.col("relation"), F.lit("")).alias("relation")) if "relation" in edges.columns else edges.select("src", "dst", F.lit("").alias("relation"))
    goal = targets.select(F.col("id").alias("dst")).distinct().withColumn("hit", F.lit(True))
    open_paths = sources.select("id").distinct().select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found = None
    for _ in range(max_nodes - 1):
        grown = open_paths.join(e, open_paths["at"] == e["src"]).where(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select("dst", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("relations", F.col("relation")).alias("relations")).join(goal, "dst", "left")
        grown = cut(grown)
        ended = grown.where("hit").select(F.element_at("nodes", 1).alias("source"), F.col("dst").alias("target"), F.size("relations").alias("n_edges"), "nodes", "relations")
        found = ended if found is None else found.unionByName(ended)
        open_paths = grown.where("hit IS NULL").select(F.col("dst").alias("at"), "nodes", "relations")
    return found


def tagged_paths(paths: DataFrame, tactics: DataFrame, model: DataFrame, most_tactics: int = 10_000) -> DataFrame:
    """Paths with the tactic of each relation (tactics: relation, tactic) and whether the model(id) holds the target.

    tactics is a small table; its size is checked before every task gets it.
    """
    if (n := tactics.count()) > most_tactics:
        raise ValueError(f"{n} relations are more than the {most_tactics} of a map")
    known = F.map_from_entries(F.collect_list(F.struct("relation", "tactic")))
    lookup = tactics.agg(known.alias("known"))
    held = model.select(F.col("id").alias("target"), F.lit(True).alias("held")).distinct()
    return (
        paths.join(F.broadcast(lookup)).withColumn("tactics", F.transform("relations", lambda r: F.try_element_at("known", r))).drop("known")
        .join(held, "target", "left").withColumn("entailed", F.coalesce("held", F.lit(False))).drop("held")
    )


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Shortest paths first, ties by their nodes."""
    return paths.orderBy("n_edges", F.array_join("nodes", "\u0001"))


def cheapest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(target, cost, nodes): least-cost path from any source; a step costs at least LEAST_COST.

    Bellman-Ford relaxation of a frontier; each node keeps its cost and its path. Ties go to the smaller path.
    """
    cost = F.greatest(F.coalesce(F.col("cost"), F.lit(1.0)), F.lit(LEAST_COST))
    links = cut(edges.select("src", "dst", cost.alias("step")).groupBy("src", "dst").agg(F.min("step").alias("step")))
    best = cut(sources.select("id", F.lit(0.0).alias("cost"), F.array("id").alias("nodes")).distinct())
    frontier = best
    for _ in range(most):
        offer = frontier.join(links, frontier["id"] == links["src"]).where(~F.array_contains("nodes", F.col("dst")))
        offer = offer.select(F.col("dst").alias("id"), F.struct((F.col("cost") + F.col("step")).alias("cost"), F.array_append("nodes", F.col("dst")).alias("nodes")).alias("way"))
        offer = offer.groupBy("id").agg(F.min("way").alias("way")).select("id", F.col("way.cost").alias("new"), F.col("way.nodes").alias("path"))
        frontier = cut(offer.join(best.select("id", "cost"), "id", "left").where("cost IS NULL OR new < cost").select("id", F.col("new").alias("cost"), F.col("path").alias("nodes")))
        if frontier.isEmpty():
            return best.join(targets.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target"), "cost", "nodes").orderBy("cost", "target")
        best = cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
    raise RuntimeError("shortest paths did not settle")
