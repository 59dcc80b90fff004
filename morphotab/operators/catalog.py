"""Catalogue of the derived variables and what each of them needs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from morphotab import schema as S

INTENSITY, RATIO, DISTANCE, SHAPE, COUNT, GROUP, OTHER = (
    "Intensity variables",
    "Channel ratio variables",
    "Distance variables",
    "Shape variables",
    "Object count",
    "Group variables",
    "Other variables",
)


@dataclass(frozen=True)
class Variable:
    """A derived variable. `{ref}` in names stands for the reference object."""

    name: str
    family: str
    desc: str
    inputs: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    per_group: bool = False

    @property
    def is_norm(self) -> bool:
        return "{ref}" in self.name


_SUM_REF = "Intensity Sum Normalised per {ref}"
_MEAN_REF = "Intensity Mean Normalised per {ref}"
_STD_REF = "Intensity StdDev Normalised per {ref}"

# Names of the variables are fixed values.
CATALOG = [
    Variable(_SUM_REF, INTENSITY, "share of the reference object's total signal", (S.INTENSITY_SUM,)),
    Variable(_MEAN_REF, INTENSITY, "signal density against the reference object", (S.INTENSITY_MEAN,)),
    Variable(_STD_REF, INTENSITY, "signal spread against the reference object", (S.INTENSITY_STD,)),
    Variable("Intensity Sum Normalised by Group", INTENSITY, "share of the group's total", needs=(_SUM_REF,)),
    Variable("Intensity Mean Normalised by Group", INTENSITY, "share of the group's summed means", needs=(_MEAN_REF,)),
    Variable(
        "Intensity StdDev Normalised by Group", INTENSITY, "share of the group's summed spreads", needs=(_STD_REF,)
    ),
    Variable("Ratio of Intensity Sum", RATIO, "total signal, one channel over another", (S.INTENSITY_SUM,)),
    Variable("Ratio of Intensity Mean", RATIO, "signal density, one channel over another", (S.INTENSITY_MEAN,)),
    Variable(
        "Ratio of Intensity Sum Normalised per {ref}", RATIO, "reference share, one channel over another", needs=(_SUM_REF,)
    ),
    Variable(
        "Ratio of Intensity Sum Normalised per Group",
        RATIO,
        "group share, one channel over another",
        needs=("Intensity Sum Normalised by Group",),
    ),
    Variable("Normalized Distance to {ref}", DISTANCE, "distance in units of the centre of mass's own distance"),
    Variable("Surface Area-to-Volume Ratio", SHAPE, "area over volume", (S.AREA, S.VOLUME)),
    Variable("Volume Relative to {ref}", SHAPE, "volume against the reference surface", (S.VOLUME,)),
    Variable("Volume Relative to Group", SHAPE, "share of the group's volume", (S.VOLUME,), ("Group Volume",)),
    Variable("Object Count", COUNT, "objects of that label in the image and channel", per_group=True),
    Variable("Group Intensity Sum", GROUP, "summed signal of a group", (S.INTENSITY_SUM,), per_group=True),
    Variable("Group Intensity Mean", GROUP, "average density of a group", (S.INTENSITY_MEAN,), per_group=True),
    Variable(
        "Group Intensity Sum Relative to {ref}",
        GROUP,
        "group signal against the reference surface",
        (S.INTENSITY_SUM,),
        ("Group Intensity Sum",),
        per_group=True,
    ),
    Variable(
        "Group Intensity Mean Relative to {ref}",
        GROUP,
        "group density against the reference surface",
        (S.INTENSITY_MEAN,),
        ("Group Intensity Mean",),
        per_group=True,
    ),
    Variable("Group Volume", GROUP, "summed volume of a group", (S.VOLUME,), per_group=True),
    Variable("Group Surface Area", GROUP, "summed area of a group", (S.AREA,), per_group=True),
    Variable(
        "Group Volume Relative to {ref}",
        GROUP,
        "group volume against the reference surface",
        (S.VOLUME,),
        ("Group Volume",),
        per_group=True,
    ),
    Variable(
        "Group Surface Area-to-Volume Ratio",
        GROUP,
        "group area over group volume",
        needs=("Group Surface Area", "Group Volume"),
        per_group=True,
    ),
    Variable("Signal Density", OTHER, "reference share per volume", (S.VOLUME,), (_SUM_REF,)),
]

_BY_NAME = {v.name: v for v in CATALOG}


def named(template: str, reference: str | None) -> str:
    return template.replace("{ref}", reference or "")


def available_variables(reference: str | None, family: str | None = None) -> list[str]:
    """Names on offer; those that need a reference object are hidden without one."""
    return [
        named(v.name, reference)
        for v in CATALOG
        if (family is None or v.family == family) and (reference or not v.is_norm)
    ]


def group_variables(reference: str | None) -> list[str]:
    """The variables that are constant within an object group."""
    return [named(v.name, reference) for v in CATALOG if v.per_group and (reference or not v.is_norm)]


def with_prerequisites(names: Iterable[str], reference: str | None) -> list[str]:
    """The requested variables and everything they are computed from, prerequisites first."""
    by_display = {named(v.name, reference): v for v in CATALOG if reference or not v.is_norm}
    ordered: dict[str, None] = {}

    def add(name: str) -> None:
        if name in ordered or name not in by_display:
            return
        for need in by_display[name].needs:
            add(named(need, reference))
        ordered[name] = None

    for name in names:
        add(name)
    return list(ordered)
