"""CVSS scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric weights of the public CVSS 3.1 specification.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
EXPLOIT = {"X": 1.0, "H": 1.0, "F": 0.97, "P": 0.94, "U": 0.91}
REMEDY = {"X": 1.0, "U": 1.0, "W": 0.97, "T": 0.96, "O": 0.95}
CONFIDENCE = {"X": 1.0, "C": 1.0, "R": 0.96, "U": 0.92}
REQUIREMENT = {"X": 1.0, "H": 1.5, "M": 1.0, "L": 0.5}
# Weights that the closed form for 4.0 vectors uses besides those above.
AT4 = {"N": 0.85, "P": 0.62}
UI4 = {"N": 0.85, "P": 0.85, "A": 0.62}


def weight(metric: Column, table: dict[str, float]) -> Column:
    """The metric's weight; null for values that the table lacks."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), metric)


def roundup(x: Column) -> Column:
    """To one decimal, up, after rounding away noise."""
    return F.ceil(F.round(x, 5) * 10) / 10


def metrics(vector: Column) -> Column:
    """Map of metric to value, upper case, of a slash-separated vector; its first part is the version."""
    return F.str_to_map(F.upper(F.trim(vector)), F.lit("/"), F.lit(":"))


def _product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def _base(m: dict[str, Column]) -> tuple[Column, Column]:
    """Impact and exploitability of base metrics."""
    changed = m["S"] == "C"
    iss = 1 - _product([1 - weight(m[k], CIA) for k in ("C", "I", "A")])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    pr = F.when(changed, weight(m["PR"], PR_CHANGED)).otherwise(weight(m["PR"], PR))
    return impact, 8.22 * weight(m["AV"], AV) * weight(m["AC"], AC) * pr * weight(m["UI"], UI)


def base31(m: dict[str, Column]) -> Column:
    """Base score of the eight base metrics; null if one is missing or unknown."""
    impact, exploit = _base(m)
    both = F.when(m["S"] == "C", 1.08 * (impact + exploit)).when(m["S"] == "U", impact + exploit)
    return F.when(impact <= 0, F.lit(0.0) * both).otherwise(roundup(F.least(both, F.lit(10.0) + 0 * both)))


def temporal31(base: Column, m: dict[str, Column]) -> Column:
    return roundup(base * weight(F.coalesce(m["E"], F.lit("X")), EXPLOIT) * weight(F.coalesce(m["RL"], F.lit("X")), REMEDY) * weight(F.coalesce(m["RC"], F.lit("X")), CONFIDENCE))


def environmental31(m: dict[str, Column]) -> Column:
    """Environmental score; modified metrics that are X or missing take the base metric's value."""
    own = {k: F.when(F.coalesce(m[f"M{k}"], F.lit("X")) == "X", m[k]).otherwise(m[f"M{k}"]) for k in ("AV", "AC", "PR", "UI", "S", "C", "I", "A")}
    need = {k: weight(F.coalesce(m[f"{k}R"], F.lit("X")), REQUIREMENT) for k in ("C", "I", "A")}
    miss = F.least(1 - _product([1 - need[k] * weight(own[k], CIA) for k in ("C", "I", "A")]), F.lit(0.915))
    changed = own["S"] == "C"
    impact = F.when(changed, 7.52 * (miss - 0.029) - 3.25 * F.pow(miss * 0.9731 - 0.02, F.lit(13))).otherwise(6.42 * miss)
    both = F.when(changed, 1.08 * (impact + _base(own)[1])).otherwise(impact + _base(own)[1])
    return F.when(impact <= 0, 0.0).otherwise(temporal31(roundup(F.least(both, F.lit(10.0))), m))


def closed_form40(m: dict[str, Column]) -> Column:
    """A version 3 style closed form for 4.0 base vectors; not the specification's lookup."""
    vulnerable = 1 - _product([1 - weight(m[k], CIA) for k in ("VC", "VI", "VA")])
    later = 1 - _product([1 - weight(m[k], CIA) for k in ("SC", "SI", "SA")])
    after = F.when(later > 0, 7.52 * (later - 0.029) - 3.25 * F.pow(later - 0.02, F.lit(15))).otherwise(0.0)
    impact = 6.42 * vulnerable + after
    exploit = 8.22 * weight(m["AV"], AV) * weight(m["AC"], AC) * weight(m["AT"], AT4) * weight(m["PR"], PR) * weight(m["UI"], UI4)
    return F.when(impact <= 0, 0.0).otherwise(roundup(F.least(impact + exploit, F.lit(10.0))))


def score(vector: Column) -> Column:
    """Base score of a 3.0, 3.1 or 4.0 vector; null if it can't be read."""
    got = metrics(vector)
    m = {k: F.try_element_at(got, F.lit(k)) for k in ("AV", "AC", "AT", "PR", "UI", "S", "C", "I", "A", "VC", "VI", "VA", "SC", "SI", "SA")}
    version = F.try_element_at(got, F.lit("CVSS"))
    return F.when(version.isin("3.0", "3.1"), base31(m)).when(version == "4.0", closed_form40(m))


def severity(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").otherwise("None")


def sigmoid(x: Column, clamp: float | None = None) -> Column:
    x = x if clamp is None else F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x))
    return 1 / (1 + F.exp(-x))


