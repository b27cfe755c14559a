"""Names, tokens and other scalar functions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark resources of a user, and those that bind a request to its caller.
SENSITIVE = ("vehicle", "video", "order", "report", "document", "invoice", "account", "profile", "payment", "message", "ticket", "balance", "location", "coupon")
SELF_BOUND = ("self", "current", "session", "whoami")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def class_runs(text: Column) -> Column:
    """Runs of letters, digits and other characters."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), 1)


def structure(text: Column) -> Column:
    """Kind and length of each run, such as L4D2S1."""
    kind = lambda r: F.when(r.rlike("^[A-Za-z]"), "L").when(r.rlike("^[0-9]"), "D").otherwise("S")
    return F.array_join(F.transform(class_runs(text), lambda r: F.concat(kind(r), F.length(r).cast("string"))), "")


def leaf_name(name: Column) -> Column:
    """What follows the last dot, arrow or double colon."""
    return F.element_at(F.split(name, r"\.|->|::"), -1)


def import_name(name: Column) -> Column:
    """The name before an @ suffix."""
    return F.split_part(name, F.lit("@"), F.lit(1))


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.upper(name))


def evidence_hash(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def is_id_name(name: Column) -> Column:
    return F.lower(name).endswith("id")


def has_path_id(url: Column) -> Column:
    return url.rlike(r"\{[^}]+\}")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def report_level(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")
