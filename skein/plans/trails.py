"""Queries on graphs whose paths are as long as the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import longpath
from ..operators.iterate import numbered
from .queries import _key, table


def _trail(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place in the order of time, at."""
    return numbered(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), ["ts", "event_id"], "at")


def _onward(trail: DataFrame) -> DataFrame:
    """(src, dst): each event leads to the next."""
    follow = trail.select((F.col("at") - 1).alias("at"), _key("e", "event_id").alias("dst"))
    return trail.select("at", _key("e", "event_id").alias("src")).join(follow, "at").select("src", "dst")


def _first_errors(trail: DataFrame) -> DataFrame:
    """(id): first events of users that are errors."""
    first = trail.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), "at").alias("first"))
    return first.where("first.event_type = 'error'").select(_key("e", "first.event_id").alias("id"))


def event_trail(spark: SparkSession, d: str) -> DataFrame:
    """How far every event, and every user as what their events lead to, is behind the nearest first event that is an error."""
    trail = _trail(spark, d)
    users = trail.select(_key("e", "event_id").alias("src"), _key("u", "user_id").alias("dst"))
    return longpath.nearest(_onward(trail).unionByName(users), _first_errors(trail))


def event_trail_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """How far every event is from the nearest first event that is an error, before or after it."""
    trail = _trail(spark, d)
    return longpath.nearest(_onward(trail), _first_errors(trail), directed=False)


def event_loops(spark: SparkSession, d: str) -> DataFrame:
    """Events in time, where an error leads back to its user's event before if that is less than an hour ago: strong components."""
    trail = _trail(spark, d)
    own = W.partitionBy("user_id").orderBy("at")
    back = trail.withColumns({"before": F.lag("event_id").over(own), "when": F.lag("ts").over(own)}).where("event_type = 'error' AND ts < when + INTERVAL 1 HOUR")
    arcs = _onward(trail).unionByName(back.select(_key("e", "event_id").alias("src"), _key("e", "before").alias("dst")))
    places = trail.select(_key("e", "event_id").alias("id"), "at")
    return longpath.strong_components(arcs, places, order=places)


QUERIES = {f.__name__: f for f in (event_trail, event_trail_both_ways, event_loops)}

_TRAIL = """WITH t AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS spot FROM events),
f AS (SELECT min(spot) AS spot FROM t GROUP BY user_id), s AS (SELECT spot FROM t JOIN f USING (spot) WHERE event_type = 'error'),
p AS (SELECT event_id, user_id, t.spot, max(s.spot) OVER (ORDER BY t.spot) AS low, min(s.spot) OVER (ORDER BY t.spot DESC) AS high FROM t LEFT JOIN s ON s.spot = t.spot)
"""

ORACLE_SQL = {
    "event_trail": _TRAIL + "SELECT 'e' || event_id AS id, spot - low AS hops FROM p WHERE low IS NOT NULL UNION ALL SELECT 'u' || user_id, 1 + min(spot - low) FROM p WHERE low IS NOT NULL GROUP BY user_id",
    "event_trail_both_ways": _TRAIL + "SELECT 'e' || event_id AS id, least(spot - low, high - spot) AS hops FROM p WHERE low IS NOT NULL OR high IS NOT NULL",
    # On a line every arc back closes a loop over its span; spans that share an event are one component.
    "event_loops": """WITH t AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS spot FROM events),
b AS (SELECT *, lag(spot) OVER (PARTITION BY user_id ORDER BY spot) AS low, lag(ts) OVER (PARTITION BY user_id ORDER BY spot) AS before FROM t),
s AS (SELECT low, spot AS high FROM b WHERE event_type = 'error' AND ts < before + INTERVAL 1 HOUR),
m AS (SELECT *, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT low, high, count(*) FILTER (reach IS NULL OR reach < low) OVER (ORDER BY low, high) AS g FROM m),
i AS (SELECT g, min(low) AS low, max(high) AS high FROM g GROUP BY g),
c AS (SELECT event_id, coalesce(g, -spot) AS c FROM t LEFT JOIN i ON spot BETWEEN low AND high)
SELECT 'e' || event_id AS id, min('e' || event_id) OVER (PARTITION BY c) AS component FROM c""",
}
