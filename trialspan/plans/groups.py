"""User-defined feature groups: a frame transform that declares the columns it adds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.clean import BASELINE_G, diff_cols, fill_const, recode, RESPONSE_CODES
from ..operators.catalog import GROUP_FEATURES


@dataclass(frozen=True)
class FeatureGroup:
    name: str
    transform: Callable[[DataFrame], DataFrame]
    outputs: tuple[str, ...]


_GROUPS: dict[str, FeatureGroup] = {}


def register_group(name: str, outputs: Sequence[str], transform: Callable[[DataFrame], DataFrame] | None = None):
    """Register a group; usable as a decorator."""
    def add(fn: Callable[[DataFrame], DataFrame]):
        _GROUPS[name] = FeatureGroup(name, fn, tuple(outputs))
        return fn
    return add(transform) if transform else add


def registered() -> list[str]:
    return list(_GROUPS)


def group_outputs(names: Sequence[str]) -> list[str]:
    """Declared output columns of the groups, in order and without repeats."""
    return list(dict.fromkeys(c for n in names for c in _GROUPS[n].outputs))


def apply_groups(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Run the groups in order; a group that does not make what it declares is an error."""
    for n in names:
        group = _GROUPS[n]
        df = df.transform(group.transform)
        missing = [c for c in group.outputs if c not in df.columns]
        if missing:
            raise ValueError(f"group {n} did not produce {missing}")
    return df


def per_trial(fn, key: str, schema: str) -> Callable[[DataFrame], DataFrame]:
    """Wrap a pandas function of one bounded slice (for example trial and time block)."""
    return lambda df: df.groupBy(*key.split(",")).applyInPandas(fn, schema)


register_group("eyetracking", GROUP_FEATURES["eyetracking"], lambda df: diff_cols(
    df, "`Pupil diameter left [mm] - Tobii`", "`Pupil diameter right [mm] - Tobii`", "Pupil Difference [mm]"))
register_group("G", GROUP_FEATURES["G"], lambda df: fill_const(df, GROUP_FEATURES["G"], BASELINE_G))
register_group("cognitive", GROUP_FEATURES["cognitive"], lambda df: recode(
    df, "Correct - Cog", RESPONSE_CODES, keep_other=True))
for _name in ("ECG", "BR", "temp"):
    register_group(_name, GROUP_FEATURES[_name], lambda df: df)
