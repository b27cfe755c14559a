"""Taint: a lattice of tag sets, folds over event tables, interprocedural fixpoints and pattern findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import Runs, closure, cut
from .traverse import reaching


def tags(column: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))))


def join_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def meet_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def below(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def join_all(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """The tags of each group; repeats go before a group's are collected. A group without tags has an empty list."""
    each = rows.select(*by, F.explode_outer(F.transform(column, lambda t: F.struct(t.alias("tag")))).alias("each")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.transform(F.collect_list("each"), lambda e: e["tag"])).alias(column))


def join_branches(a: Column, b: Column) -> Column:
    """Environments map<variable, tags> of two branches, joined by variable."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: join_tags(F.coalesce(x, none), F.coalesce(y, none)))


def taint_environment(events: DataFrame) -> DataFrame:
    """(fn, env): the environment after a function's events in order of seq.

    events(fn, seq, op, target, inputs array<string>, tags array<string>): op source sets the tags, assign joins
    those of its inputs (none left: the variable goes), sanitise clears, mutate adds the inputs' to the target's.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "target", "inputs", "tags")))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,array<string>>")

    def step(env: Column, e: Column) -> Column:
        got = F.aggregate(F.coalesce(e["inputs"], none), none, lambda acc, v: F.array_union(acc, F.coalesce(F.try_element_at(env, v), none)))
        own = F.coalesce(F.try_element_at(env, e["target"]), none)
        new = F.when(e["op"] == "source", F.coalesce(e["tags"], none)).when(e["op"] == "assign", got).when(e["op"] == "mutate", F.array_union(own, got)).when(e["op"] == "sanitise", none).otherwise(own)
        rest = F.map_filter(env, lambda k, _: k != e["target"])
        return F.when(F.size(new) > 0, F.map_concat(rest, F.create_map(e["target"], F.array_sort(new)))).otherwise(rest)

    return events.groupBy("fn").agg(steps.alias("steps")).select("fn", F.aggregate("steps", empty, step).alias("env"))


def tainted_sinks(environment: DataFrame, sinks: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """One row per tainted sink and source: sinks(fn, line, sink, category, position, argument).

    relevant(category, position) limits which arguments of a category count.
    """
    rows = sinks if relevant is None else sinks.join(relevant, ["category", "position"], "left_semi")
    rows = rows.join(environment, "fn").withColumn("source", F.explode(F.try_element_at("env", "argument")))
    return rows.select("fn", "line", "sink", "category", "source").distinct()


def match_profile(calls: DataFrame, profile: DataFrame) -> DataFrame:
    """calls(name, ...) with role and category of profile(role, name, category): exact, else leaf, else suffix match."""
    leaf = F.element_at(F.split(calls["name"], r"\.|->|::"), -1)
    p = profile.select(F.col("name").alias("known"), "role", "category")
    how = F.when(F.col("name") == F.col("known"), 0).when(leaf == F.col("known"), 1).otherwise(2)
    keyed = calls.withColumn("leaf", leaf)
    known_leaf = p.withColumn("leaf", F.element_at(F.split("known", r"\.|->|::"), -1))
    # Any of the three matches shares the last part of the name.
    rows = keyed.join(known_leaf, "leaf").where((F.col("name") == F.col("known")) | (leaf == F.col("known")) | F.col("name").endswith(F.concat(F.lit("."), F.col("known"))))
    best = rows.withColumn("how", how).groupBy(*calls.columns).agg(F.min(F.struct("how", "role", "category", "known")).alias("m"))
    return best.select(*calls.columns, "m.role", "m.category", F.col("m.known").alias("matched"))


def sink_calls(calls: DataFrame, profile: DataFrame) -> DataFrame:
    """Every call of a sink, tainted or not."""
    return match_profile(calls, profile.where("role = 'sink'"))


def interprocedural(arguments: DataFrame, seeds: DataFrame, by_caller: bool = False) -> DataFrame:
    """Tainted parameters (method, param[, caller]): semi-naive fixpoint over arguments.

    arguments(caller, caller_param, method, param): a call passes what came in by caller_param. seeds(method,
    param) are tainted at entry. by_caller keeps contexts apart by the calling method.
    """
    keys = ["method", "param", "caller"] if by_caller else ["method", "param"]
    start = seeds.select("method", "param", F.lit("").alias("caller")).select(keys)
    links = arguments.select(F.col("caller").alias("from"), F.col("caller_param").alias("from_param"), F.col("method").alias("to"), F.col("param").alias("to_param"))
    step = lambda f, e: f.join(e, (f["method"] == e["from"]) & (f["param"] == e["from_param"])).select(F.col("to").alias("method"), F.col("to_param").alias("param"), F.col("from").alias("caller")).select(keys)
    return closure(start, links, keys, step)


def interprocedural_contexts(arguments: DataFrame, seeds: DataFrame) -> DataFrame:
    """(method, caller, seeds array<string>): the sets of parameters that are tainted together, by calling method.

    arguments(call, caller, caller_param, method, param): one row for each argument of a call, passing what came in by
    caller_param. seeds(method, param) are tainted at entry, those of a method together; their caller is ''. A call passes
    on what its context taints, as one set; calls that pass nothing open no context. Sets are sorted and without repeats, so
    a context that comes again is the same row and recursion ends. Rows with a null in method or param count for nothing.
    """
    known = lambda c: F.array_sort(F.collect_set(c))
    start = seeds.where("method IS NOT NULL AND param IS NOT NULL").groupBy("method").agg(known("param").alias("seeds"))
    passed = arguments.where("caller IS NOT NULL AND method IS NOT NULL AND caller_param IS NOT NULL AND param IS NOT NULL")
    # A call is one row with all it passes; calls between the same two that pass the same are one.
    calls = passed.groupBy("call", F.col("caller").alias("from"), F.col("method").alias("to")).agg(known(F.struct("caller_param", "param")).alias("passes"))
    calls = cut(calls.select("from", "to", "passes").distinct())
    frontier, seen, found = cut(start), Runs(), [start.select("method", F.lit("").alias("caller"), "seeds")]
    # What a call passes depends on its context's method and set alone: each of these is followed once.
    while size := frontier.count():
        seen.add(frontier, size)
        met = calls.join(frontier.select(F.col("method").alias("from"), F.col("seeds").alias("outer")), "from")
        inner = F.array_sort(F.array_distinct(F.transform(F.filter("passes", lambda p: F.array_contains("outer", p["caller_param"])), lambda p: p["param"])))
        found.append(cut(met.select(F.col("to").alias("method"), F.col("from").alias("caller"), inner.alias("seeds")).where(F.size("seeds") > 0).distinct()))
        frontier = cut(found[-1].select("method", "seeds").distinct().join(seen.all(), ["method", "seeds"], "left_anti"))
    return reduce(DataFrame.unionByName, found).distinct()


def calls_tainted_sink(calls: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """One row per call site of a sink(name) in a function that calls a source(name) or a function that does."""
    tainted = reaching(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), sources.select(F.col("name").alias("id")))
    sites = calls.join(sinks.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    return sites.join(tainted.withColumnRenamed("id", "caller"), "caller", "left_semi")


def pattern_findings(files: DataFrame, patterns: DataFrame, most_patterns: int = 10_000) -> DataFrame:
    """(file, category, line, match): every match of patterns(category, pattern) in files(file, text), by line.

    patterns is a small table; its size is checked before every task gets it.
    """
    if (n := patterns.count()) > most_patterns:
        raise ValueError(f"{n} patterns are more than the {most_patterns} that a task can try")
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    rows = lines.join(F.broadcast(patterns), F.rlike(lines["content"], patterns["pattern"]))
    found = rows.select("file", "category", (F.col("i") + 1).alias("line"), F.explode(F.expr("regexp_extract_all(content, pattern, 0)")).alias("match"))
    return found.where("match <> ''")


def unsafe_order(functions: DataFrame) -> DataFrame:
    """Functions(fn, externals array<struct<offset, op>>, writes array<struct<offset, name>>) with an external call or
    delegatecall before a write; one row each."""
    call = F.filter("externals", lambda e: e["op"].isin("call", "delegatecall") & F.exists("writes", lambda w: e["offset"] < w["offset"]))
    return functions.withColumn("first", F.get(call, 0)).where("first IS NOT NULL").select("fn", F.col("first.op").alias("op"), F.col("first.offset").alias("offset"))


def call_write_graph(functions: DataFrame) -> DataFrame:
    """(src, dst): an edge to and from an external node for each external call that a write follows."""
    rows = functions.select("fn", F.posexplode("externals").alias("i", "e"), "writes").where(F.exists("writes", lambda w: F.col("e.offset") < w["offset"]))
    node = F.concat(F.lit("EXT"), F.col("i").cast("string"), F.lit(":"), F.col("fn"))
    return rows.select(F.explode(F.array(F.struct(F.col("fn").alias("src"), node.alias("dst")), F.struct(node.alias("src"), F.col("fn").alias("dst")))).alias("e2")).select("e2.src", "e2.dst")
