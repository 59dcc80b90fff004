"""Derived variables declared as data: each is a quotient of two terms, so a new one needs no code.

A JSON text holds `{"variables": [{"name": ..., "family": ..., "desc": ..., "value": TERM, "by": TERM}, ...]}`; without `by`
the variable is its value. A term is `{"of": NAME, "as": KIND}`, where NAME is a column or another variable, `{ref}` in names stands
for the reference object, and KIND is

    own        the row's value (the default)
    total      strict sum over the (image, channel, category, object) group; `average` its strict mean
    label      strict sum over (image, object, channel), whatever the category
    reference  value of the reference object of the image and channel; `surface` of the reference surface only,
               `center` of its centre of mass
    channel    the object's value in the channel named by `"channel"`

Variables that build on the row's value of others are levels of one projection. A group value of another variable needs that
variable as a column first, so it starts a further aggregation and join. A quotient that is not finite is NULL.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.functions.columns import col
from morphotab.operators.derive import _Plan

KINDS = ("own", "total", "average", "label", "reference", "surface", "center", "channel")


@dataclass(frozen=True)
class Term:
    of: str
    kind: str = "own"
    channel: str | None = None


@dataclass(frozen=True)
class Declared:
    name: str
    value: Term
    by: Term | None = None
    family: str = ""
    desc: str = ""

    def terms(self) -> list[Term]:
        return [self.value, *([self.by] if self.by else [])]


def _term(found: dict | None, reference: str | None, name: str) -> Term | None:
    if found is None:
        return None
    kind = found.get("as", "own")
    if kind not in KINDS or (kind == "channel") != ("channel" in found):
        raise ValueError(f"{name}: a term is of one of the kinds {', '.join(KINDS)}, and a channel is named for the last one only")
    return Term(found["of"].replace("{ref}", reference or ""), kind, found.get("channel"))


def parse_variables(text: str, reference: str | None = S.NUCLEUS) -> list[Declared]:
    """The variables of a JSON text; those that need a reference object are left out without one."""
    out = []
    for v in json.loads(text)["variables"]:
        if not reference and "{ref}" in json.dumps(v):
            continue
        name = v["name"].replace("{ref}", reference or "")
        out.append(Declared(name, _term(v["value"], reference, name), _term(v.get("by"), reference, name), v.get("family", ""), v.get("desc", "")))
    names = [v.name for v in out]
    if len(set(names)) < len(names):
        raise ValueError(f"declared twice: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def read_variables(spark: SparkSession, path: str, reference: str | None = S.NUCLEUS) -> list[Declared]:
    """As parse_variables, from a file that Spark can read."""
    return parse_variables(spark.read.text(path, wholetext=True).first()[0], reference)


def in_order(variables: Sequence[Declared], names: Iterable[str]) -> list[Declared]:
    """The variables named and all that they build on, those first; a circle is an error that names it."""
    known = {v.name: v for v in variables}
    ordered: dict[str, Declared] = {}

    def add(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("declared in a circle: " + " -> ".join([*path[path.index(name) :], name]))
        if name in ordered or name not in known:
            return
        for term in known[name].terms():
            add(term.of, (*path, name))
        ordered[name] = known[name]

    for name in names:
        if name not in known:
            raise ValueError(f"not declared: {name}")
        add(name, ())
    return list(ordered.values())


def _value(plan: _Plan, term: Term, levels: dict[str, int]) -> Column:
    if term.kind == "own":
        return col(f"_q_{term.of}" if term.of in levels else term.of)
    found = {
        "total": plan.total,
        "average": plan.average,
        "label": plan.label_total,
        "reference": plan.reference_value,
        "surface": plan.surface_value,
        "center": plan.center_value,
    }
    return plan.object_value(term.of, term.channel) if term.kind == "channel" else found[term.kind](term.of)


def derive_declared(df: DataFrame, variables: Sequence[Declared], names: Iterable[str] | None = None, reference: str | None = S.NUCLEUS) -> DataFrame:
    """The table with the named variables (default: all) and those that they build on, in the order they are computed in.

    A variable whose name the table has already is not computed again. One that reads a column the table lacks is left out, as
    are those that build on it.
    """
    waiting = [v for v in in_order(variables, [v.name for v in variables] if names is None else names) if v.name not in df.columns]
    while waiting:
        plan, have, levels, later = _Plan(df, reference, None), set(df.columns), {}, []
        for v in waiting:
            if all(t.of in have or (t.kind == "own" and t.of in levels) for t in v.terms()):
                levels[v.name] = 1 + max((levels[t.of] for t in v.terms() if t.kind == "own" and t.of in levels), default=-1)
            else:
                later.append(v)
        if not levels:
            break
        plan.levels = [{} for _ in range(1 + max(levels.values()))]
        for v in waiting:
            if v.name in levels:
                below = F.lit(1.0) if v.by is None else _value(plan, v.by, levels)
                plan.quotient(v.name, _value(plan, v.value, levels), below, levels[v.name])
        df = plan.joined().select(*[col(c) for c in df.columns], *[col(f"_q_{name}").alias(name) for name in levels])
        waiting = later
    return df
