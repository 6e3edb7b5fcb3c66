"""CVSS 3.0 and 3.1 scores from a vector, by the published equations. Column to Column, inside the JVM.

A vector is ``CVSS:3.x/`` and metrics as ``name:value``, in any order. It has a score if it names every base metric, each metric once, and
no value that the specification does not know; else all scores are null. Temporal and environmental metrics that are absent or X
do not weigh. 3.0 and 3.1 differ in how they round up and in the environmental impact of a changed scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The weights of the specification.
BASE = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 1.0},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES_OF_CHANGED_SCOPE = {"N": 0.85, "L": 0.68, "H": 0.5}
TEMPORAL = {
    "E": {"X": 1.0, "H": 1.0, "F": 0.97, "P": 0.94, "U": 0.91},
    "RL": {"X": 1.0, "U": 1.0, "W": 0.97, "T": 0.96, "O": 0.95},
    "RC": {"X": 1.0, "C": 1.0, "R": 0.96, "U": 0.92},
}
REQUIREMENTS = {name: {"X": 1.0, "H": 1.5, "M": 1.0, "L": 0.5} for name in ("CR", "IR", "AR")}

_MODIFIED = {f"M{name}": values for name, values in BASE.items()}
_KNOWN = "|".join(
    [f"{name}:[{''.join(values)}]" for name, values in (BASE | TEMPORAL | REQUIREMENTS).items()] + [f"{name}:[X{''.join(values)}]" for name, values in _MODIFIED.items()]
)


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in values.items()])


def _weight(value: Column, weights: dict[str, float]) -> Column:
    out = None
    for letter, weight in weights.items():
        out = F.when(value == letter, F.lit(weight)) if out is None else out.when(value == letter, F.lit(weight))
    return out


def round_up(value: Column, is_31: Column) -> Column:
    """To one decimal, upwards: 3.0 takes the ceiling of tenths, 3.1 first drops what lies behind the fifth decimal."""

    def both(v: Column) -> Column:
        fifths = F.round(v * 100000).cast("long")
        newer = F.when(fifths % 10000 == 0, fifths / 100000.0).otherwise((F.floor(fifths / 10000) + 1) / 10.0)
        return F.when(is_31, newer).otherwise(F.ceil(v * 10) / 10.0)

    return let(value, both)


def _power(value: Column, n: int) -> Column:
    return F.pow(value, F.lit(float(n)))


def _exploitability(metric: Callable[[str], Column]) -> Column:
    changed = metric("S") == "C"
    privileges = F.when(changed, _weight(metric("PR"), PRIVILEGES_OF_CHANGED_SCOPE)).otherwise(_weight(metric("PR"), BASE["PR"]))
    return F.lit(8.22) * _weight(metric("AV"), BASE["AV"]) * _weight(metric("AC"), BASE["AC"]) * privileges * _weight(metric("UI"), BASE["UI"])


def _together(impact: Column, exploitability: Column, changed: Column) -> Column:
    """Before rounding: nothing without an impact, ten at most."""
    both = F.when(changed, F.lit(1.08) * (impact + exploitability)).otherwise(impact + exploitability)
    return F.when(impact <= 0, F.lit(0.0)).otherwise(F.least(both, F.lit(10.0)))


def decoded(vector: Column) -> Column:
    """struct(version, metrics): the map of metric to value of a sound vector; null for any other."""
    name = lambda p: F.split_part(p, F.lit(":"), F.lit(1))
    value = lambda p: F.split_part(p, F.lit(":"), F.lit(2))

    def read(parts: Column) -> Column:
        names = F.transform(parts, name)
        known = F.forall(parts, lambda p: p.rlike(f"^({_KNOWN})$"))
        once = F.size(F.array_distinct(names)) == F.size(names)
        whole = F.size(F.array_intersect(names, F.array(*[F.lit(x) for x in BASE]))) == len(BASE)
        metrics = F.map_from_entries(F.transform(parts, lambda p: F.struct(name(p).alias("name"), value(p).alias("value"))))
        return F.when(known & once & whole, F.struct(F.substring(vector, 6, 3).alias("version"), metrics.alias("metrics")))

    return F.when(vector.rlike(r"^CVSS:3\.[01]/"), let(F.split(F.substr(vector, F.lit(10)), "/"), read))


def scores(decoded_vector: Column) -> Column:
    """struct(impact, exploitability, base, temporal, environmental) of what ``decoded`` gives; impact and exploitability are not rounded."""

    def weighed(d: Column) -> Column:
        """Losses, exploitability and scope, as reported and as modified locally."""
        as_reported = lambda name: F.try_element_at(d["metrics"], F.lit(name))
        stated = lambda name: F.coalesce(as_reported(name), F.lit("X"))
        locally = lambda name: F.coalesce(F.nullif(as_reported(f"M{name}"), F.lit("X")), as_reported(name))
        kept = [1 - _weight(as_reported(name), BASE[name]) for name in "CIA"]
        kept_locally = [1 - _weight(stated(f"{name}R"), REQUIREMENTS[f"{name}R"]) * _weight(locally(name), BASE[name]) for name in "CIA"]
        values = {
            "newer": d["version"] == "3.1", "changed": as_reported("S") == "C", "local_changed": locally("S") == "C",
            "lost": 1 - kept[0] * kept[1] * kept[2], "local_lost": F.least(1 - kept_locally[0] * kept_locally[1] * kept_locally[2], F.lit(0.915)),
            "exploitability": _exploitability(as_reported), "local_exploitability": _exploitability(locally),
            "dampened": _weight(stated("E"), TEMPORAL["E"]) * _weight(stated("RL"), TEMPORAL["RL"]) * _weight(stated("RC"), TEMPORAL["RC"]),
        }
        return _struct(values)

    def with_impacts(w: Column) -> Column:
        steep = F.when(w["newer"], _power(w["local_lost"] * 0.9731 - 0.02, 13)).otherwise(_power(w["local_lost"] - 0.02, 15))
        impact = F.when(w["changed"], F.lit(7.52) * (w["lost"] - 0.029) - F.lit(3.25) * _power(w["lost"] - 0.02, 15)).otherwise(F.lit(6.42) * w["lost"])
        local = F.when(w["local_changed"], F.lit(7.52) * (w["local_lost"] - 0.029) - F.lit(3.25) * steep).otherwise(F.lit(6.42) * w["local_lost"])
        return _struct({"w": w, "impact": impact, "local_impact": local})

    def rounded(x: Column) -> Column:
        w = x["w"]
        base = round_up(_together(x["impact"], w["exploitability"], w["changed"]), w["newer"])
        inner = round_up(_together(x["local_impact"], w["local_exploitability"], w["local_changed"]), w["newer"])
        return _struct({"w": w, "impact": x["impact"], "local_impact": x["local_impact"], "base": base, "inner": inner})

    def told(x: Column) -> Column:
        w = x["w"]
        environmental = F.when(x["local_impact"] <= 0, F.lit(0.0)).otherwise(round_up(x["inner"] * w["dampened"], w["newer"]))
        return _struct({"impact": x["impact"], "exploitability": w["exploitability"], "base": x["base"], "temporal": round_up(x["base"] * w["dampened"], w["newer"]), "environmental": environmental})

    def of(d: Column) -> Column:
        return F.when(d.isNotNull(), let(weighed(d), lambda w: let(with_impacts(w), lambda x: let(rounded(x), told))))

    return let(decoded_vector, of)
