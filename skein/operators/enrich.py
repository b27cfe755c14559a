"""Joins that enrich findings: enclosing ranges, substring matches, lookups, diffs, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import cut

from ..functions import text as T

LINES = 256


#: Lines are numbers between -FAR and FAR; spans that go on beyond end there.
FAR = 1 << 61


def enclosing(points: DataFrame, spans: DataFrame, first: bool = False) -> DataFrame:
    """points(file, line, ...) with the innermost span(file, lo, hi, name, pos) around each; first takes the first by pos.

    Lines, lo and hi are whole numbers. A span is a few aligned stretches of 2^k lines, at most two a k; the best span of each stretch
    is found first, then the best of the stretches that a line lies in, at most one a k. So neither points nor spans that
    share lines meet each other: rows grow with both, not with their product, in one long file too.
    """
    far = lambda c: F.least(F.greatest(F.col(c).cast("long"), F.lit(-FAR)), F.lit(FAR))
    order = F.struct("pos", "name") if first else F.struct((F.col("hi").cast("long") - F.col("lo")).alias("width"), "pos", "name")
    rows = spans.where("lo <= hi AND file IS NOT NULL").select("file", far("lo").alias("lo"), far("hi").alias("hi"), F.struct(order.alias("order"), "name").alias("best"))
    rows = rows.groupBy("file", "lo", "hi").agg(F.min("best").alias("best"))
    # Of the stretches of 2^k lines, numbered l to r - 1, that lie within the span those at its ends are in no larger one.
    k = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("hi") - F.col("lo") + 1.0)).cast("int") + 1))
    rows = rows.withColumn("k", k).withColumns({"l": F.expr("-shiftright(-lo, k)"), "r": F.expr("shiftright(hi + 1, k)")}).where("l < r")
    ends = F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1))
    stretches = cut(rows.withColumn("at", F.explode(F.array_distinct(F.array_compact(ends)))).groupBy("file", "k", "at").agg(F.min("best").alias("best")))
    sizes = [r["k"] for r in stretches.select("k").distinct().collect()]
    lines = points.select("file", "line").distinct()
    within = lines.withColumn("k", F.explode(F.array(*[F.lit(s) for s in sorted(sizes)]).cast("array<int>"))).withColumn("at", F.expr("shiftright(cast(line AS bigint), k)"))
    best = within.join(stretches, ["file", "k", "at"]).groupBy("file", "line").agg(F.min("best").alias("best"))
    return points.join(best.select("file", "line", F.col("best.name").alias("enclosing")), ["file", "line"], "left").select(*points.columns, "enclosing")


def gated(findings: DataFrame, spans: DataFrame, gates: DataFrame) -> DataFrame:
    """Findings with the auth gates (name, gate) of their enclosing function; only those that have some."""
    own = gates.groupBy(F.col("name").alias("enclosing")).agg(F.array_sort(F.collect_set("gate")).alias("auth_gates"))
    return enclosing(findings, spans).join(own, "enclosing").where(F.size("auth_gates") > 0)


def ungated_access(functions: DataFrame, sources: DataFrame, sinks: DataFrame, categories: list[str], require_source: bool = True, require_no_gate: bool = True) -> DataFrame:
    """(file, function, line, sink, category, sources): resource sinks in functions with a web source and no gate.

    functions(file, name, lo, hi, gated), sources(file, line, label), sinks(file, line, sink, category). Lines meet functions
    by file and line bucket, so a long file isn't one task.
    """
    rows = functions.where(~F.coalesce("gated", F.lit(False))) if require_no_gate else functions
    rows = rows.select("file", "name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / LINES), F.floor(F.greatest("hi", "lo") / LINES))).alias("bucket"))
    inside = lambda t: rows.join(t.withColumn("bucket", F.floor(F.col("line") / LINES)), ["file", "bucket"]).where("line >= lo AND line <= hi")
    from_web = inside(sources).groupBy("file", "name", "lo").agg(F.array_sort(F.collect_list("label")).alias("sources"))
    hit = inside(sinks.where(F.col("category").isin(categories))).select("file", "name", "lo", "line", "sink", F.when(F.col("category") == "sql", "idor").otherwise("missing_authorization").alias("category"))
    return hit.join(from_web, ["file", "name", "lo"], "inner" if require_source else "left").drop("lo").withColumnRenamed("name", "function")


def api_candidates(operations: DataFrame) -> DataFrame:
    """operations(method, path, params array<struct<name, in>>) with an object id on a sensitive path, not bound to the caller."""
    ids = F.filter("params", lambda p: T.is_id_name(p["name"]) | (p["in"] == "path"))
    bound = T.any_of(F.col("path"), T.SELF_BOUND) | F.exists("params", lambda p: T.any_of(p["name"], T.SELF_BOUND))
    rows = operations.withColumn("ids", F.transform(ids, lambda p: p["name"]))
    return rows.where((T.has_path_id(F.col("path")) | (F.size("ids") > 0)) & T.any_of(F.col("path"), T.SENSITIVE) & ~bound).select(F.upper("method").alias("method"), "path", "ids")


def not_prefixed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct found(path) that start no known(path), sorted: the prefixes of the known paths as an anti-join."""
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substring("path", F.lit(1), n))).alias("path")).distinct()
    return found.where(F.col("path").startswith("/")).select("path").distinct().join(prefixes, "path", "left_anti").orderBy("path")


def lookup(base: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """base(cve, ...) with kev true/false and an epss score, 0 where there is none."""
    known = kev.select("cve").distinct().withColumn("in_kev", F.lit(True))
    scores = epss.groupBy("cve").agg(F.max("epss").alias("epss"))
    return base.join(known, "cve", "left").join(scores, "cve", "left").fillna(0.0, ["epss"]).fillna(False, ["in_kev"]).orderBy("cve")


def intelligence(asked: DataFrame, base: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """The record of each id of asked(cve), whatever its case: base's fields, whether and since when it is exploited,
    its score. An unknown id has a row of its own with what the other tables say."""
    ids = asked.where("cve IS NOT NULL").select(F.upper("cve").alias("cve")).distinct()
    seen = kev.select("cve", F.lit(True).alias("in_kev"), F.coalesce("date_added", F.lit("")).alias("kev_date_added"), F.coalesce("ransomware_campaign", F.lit(False)).alias("kev_ransomware"))
    rows = ids.join(base, "cve", "left").join(seen, "cve", "left").join(epss.select("cve", "epss"), "cve", "left")
    return rows.fillna(False, ["in_kev"]).fillna(0.0, ["epss"])


def mentions(texts: DataFrame, terms: DataFrame, words: str = r"[^\p{L}\p{N}_-]+") -> DataFrame:
    """(id, term) of single-word terms(term) that texts(id, text) hold as a word: an equi-join, no nested loop."""
    split = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), words))).alias("term"))
    return split.join(terms.select(F.lower("term").alias("term")).distinct(), "term").select("id", "term")


def contains_either_way(left: DataFrame, right: DataFrame, most_right: int = 10_000) -> DataFrame:
    """(name, product): names that contain a product or lie in one, whatever the case. right(product) is a small
    dimension; its size is checked before every task gets it."""
    n = right.count()
    if n > most_right:
        raise ValueError(f"{n} products are more than the {most_right} that a task can scan")
    a, b = F.lower(left["name"]), F.lower(right["product"])
    return left.join(F.broadcast(right), (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a)))


def enrich_findings(findings: DataFrame, names: DataFrame, intelligence: DataFrame) -> DataFrame:
    """findings(id, text) with matched ids, kev and largest epss; names(term, cve) maps words to intelligence(cve, in_kev, epss)."""
    hits = mentions(findings, names).join(names.select(F.lower("term").alias("term"), "cve"), "term").select("id", "cve").distinct().join(intelligence, "cve")
    agg = hits.groupBy("id").agg(F.array_sort(F.collect_set("cve")).alias("cves"), F.bool_or("in_kev").alias("in_kev"), F.max("epss").alias("epss"))
    return findings.join(agg, "id", "left").fillna(False, ["in_kev"]).fillna(0.0, ["epss"])


def first_hint(texts: DataFrame, hints: DataFrame, most_hints: int = 10_000) -> DataFrame:
    """texts(id, text) with the hint of the first of hints(pos, key, hint) whose key the text contains, whatever the
    case, else null. hints is a small table; its size is checked before every task gets it."""
    n = hints.count()
    if n > most_hints:
        raise ValueError(f"{n} hints are more than the {most_hints} that a task can scan")
    keys = F.broadcast(hints.where(F.length("key") > 0).agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("key").alias("key"), "hint"))).alias("known")))
    text = F.lower(F.coalesce("text", F.lit("")))
    return texts.join(keys).withColumn("hint", F.get(F.filter("known", lambda k: text.contains(k["key"])), F.lit(0))["hint"]).drop("known")


def hint_ids(hints: DataFrame, products: DataFrame, intelligence: DataFrame, pattern: str = r"(?i)CVE-\d{4}-\d+", most_products: int = 10_000) -> DataFrame:
    """hints(id, service, version, hypothesis, ...) with cves, in_kev and epss.

    Ids come from the text itself and from products(product, cve) that the text names; intelligence(cve, in_kev,
    epss) tells about them. Rows without any have an empty list. products' distinct names are a checked, small table.
    """
    names = products.where(F.length("product") > 0).select(F.lower("product").alias("product"), "cve").distinct()
    n = names.select("product").distinct().count()
    if n > most_products:
        raise ValueError(f"{n} products are more than the {most_products} that a task can scan")
    text = F.concat_ws(" ", "version", "hypothesis", "service")
    rows = hints.select("id", text.alias("text"))
    written = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("cve")).withColumn("cve", F.upper("cve"))
    known = F.broadcast(names.agg(F.array_sort(F.collect_set("product")).alias("known")))
    named = rows.join(known).select("id", F.explode(F.filter("known", lambda p: F.lower(F.col("text")).contains(p))).alias("product")).join(names, "product").select("id", "cve")
    found = written.unionByName(named).distinct().join(intelligence, "cve", "left")
    agg = found.groupBy("id").agg(F.array_sort(F.collect_set("cve")).alias("cves"), F.bool_or(F.coalesce("in_kev", F.lit(False))).alias("in_kev"), F.max(F.coalesce("epss", F.lit(0.0))).alias("epss"))
    out = hints.join(agg, "id", "left").withColumn("cves", F.coalesce("cves", F.array().cast("array<string>")))
    return out.fillna(False, ["in_kev"]).fillna(0.0, ["epss"])


def with_category(rows: DataFrame, categories: DataFrame, fallback: str = "generic") -> DataFrame:
    """rows(category, ...) with the attributes of categories(name, aliases, ...), by name or alias, else the fallback's."""
    alias = categories.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("category"))
    alias = alias.groupBy("category").agg(F.min("name").alias("name"))
    named = rows.join(alias, "category", "left").withColumn("name", F.coalesce("name", F.lit(fallback)))
    return named.join(categories.drop("aliases"), "name", "left")


def triangulate(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """findings(id, line, ...) with a verdict from runtime hits(line, pos, argument or arguments): confirmed, hit or unexecuted.

    The witness is the longest usable argument of the first hit that has one, of equal ones the first; a text that only
    names an object's address isn't usable.
    """
    values = F.col("arguments") if "arguments" in hits.columns else F.array("argument")
    usable = F.filter(values, lambda v: (F.length(v) > 0) & ~(v.startswith("<") & v.contains(" object at ")))
    longest = F.aggregate(usable, F.lit(""), lambda best, v: F.when(F.length(v) > F.length(best), v).otherwise(best))
    rows = hits.select("line", "pos", longest.alias("argument"))
    agg = rows.groupBy("line").agg(F.min_by("argument", F.when(F.length("argument") > 0, F.col("pos"))).alias("witness"), F.count(F.lit(1)).alias("n_hits"))
    verdict = F.when(F.length("witness") > 0, "confirmed").when(F.col("n_hits") > 0, "hit").otherwise("unexecuted")
    return findings.join(agg, "line", "left").withColumn("verdict", verdict).fillna(0, ["n_hits"])


def dynamic_only(findings: DataFrame, hits: DataFrame) -> DataFrame:
    return hits.join(findings.select("line").distinct(), "line", "left_anti")


def open_to_others(candidates: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """candidates(id, code) with `witness`: whether another's record can be had, as the code names none of the owner
    checks (tokens), whatever the case. Null code names none."""
    return candidates.withColumn("witness", ~T.any_of(F.col("code"), tuple(t.lower() for t in tokens)))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): resolved, introduced or persisting, over distinct keys; one aggregation of both sides."""
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.select(*keys, F.when(F.col("a") == 0, "resolved").when(F.col("b") == 0, "introduced").otherwise("persisting").alias("state"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def merge(old: DataFrame, new: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """old rows with the non-empty fields of new ones, defaults for what neither has."""
    fields = [c for c in old.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in fields if c in new.columns])
    pick = lambda c: F.coalesce(*([F.nullif(F.col(f"new_{c}").cast("string"), F.lit(""))] if c in new.columns else []), F.col(c).cast("string"), F.lit(defaults.get(c)))
    return old.join(fresh, key, "left").select(key, *[pick(c).alias(c) for c in fields])


def funnel(events: DataFrame, stages: list[str], user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """One row: users of each stage and its rate against the first, to four decimals."""
    seen = events.where(F.col(kind).isin(stages)).groupBy(user).agg(*[F.max((F.col(kind) == s).cast("int")).alias(s) for s in stages])
    n = seen.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages])
    return n.select(*stages, *[F.coalesce(F.round(F.try_divide(F.col(s).cast("double"), F.col(stages[0]).cast("double")), 4), F.lit(0.0)).alias(f"{s}_rate") for s in stages[1:]])


def selected(entities: DataFrame, flags: list[str], words: tuple[str, ...] = ()) -> DataFrame:
    """Enabled entities that have all flags and whose name contains one of the words, if any are given."""
    cond: Column = F.coalesce("enabled", F.lit(False))
    for f in flags:
        cond = cond & F.coalesce(f, F.lit(False))
    return entities.where(cond & T.any_of(F.col("name"), tuple(w.lower() for w in words)) if words else cond)


def source_files(files: DataFrame, suffixes: tuple[str, ...], per_case: int | None = 8) -> DataFrame:
    """files(case_id, path) with a source suffix outside tests and docs; the first per_case of each case."""
    rows = files.where(F.lower("path").rlike(rf"({'|'.join(suffixes)})$") & ~F.lower("path").rlike(r"(^|/)(tests?|docs?)(/|$)|(^|/)test_"))
    if per_case is None:
        return rows
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("case_id").orderBy("path"))).where(F.col("rn") <= per_case).drop("rn")


def reverse_patch(files: DataFrame, reach: int = 200) -> DataFrame:
    """(id, before) from files(id, after, hunks array<struct<start:int, old:array<string>, new:array<string>>>).

    Hunks are undone from the last; one is looked for at its place, then up to `reach` lines around. Null if one
    isn't found.
    """
    @F.pandas_udf("string")
    def undo(after: pd.Series, hunks: pd.Series) -> pd.Series:
        out = []
        for text, hs in zip(after, hunks, strict=True):
            lines = None if text is None else text.split("\n")
            for h in sorted(hs if hs is not None else [], key=lambda h: -h["start"]):
                if lines is None:
                    break
                new, at = list(h["new"]), h["start"] - 1
                spots = sorted(range(max(0, at - reach), min(len(lines), at + reach) + 1), key=lambda i: (abs(i - at), i))
                spot = next((i for i in spots if lines[i : i + len(new)] == new), None)
                lines = None if spot is None else [*lines[:spot], *h["old"], *lines[spot + len(new) :]]
            out.append(None if lines is None else "\n".join(lines))
        return pd.Series(out, dtype=object)

    return files.select("id", undo("after", "hunks").alias("before"))
