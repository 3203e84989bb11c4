"""The feature catalog: features are rows, so name rules are joins, filters and groupings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizing import attach, attach_one

# Sensor streams, patterns and aliases of the public naming contract.
STREAM_PATTERNS = {
    "ECG": ["ecg", "equivital", "hrv"],
    "HR": [r"\bhr\b", "participant_hr"],
    "BR": [r"\bbr\b"],
    "Temperature": ["temp", "temperature"],
    "Pupil": ["pupil"],
    "Centrifuge": ["centrifuge"],
    "EEG": ["eeg"],
    "Strain": ["strain"],
    "Participant": ["participant_"],
    "Demographics": ["participant_"],
}
STREAM_ALIASES = {
    "demographic": "Demographics",
    "demographics": "Demographics",
    "participant": "Participant",
    "gforce": "Centrifuge",
    "g force": "Centrifuge",
}
GROUP_ALIASES = {
    "Equivital": ["BR", "ECG", "HR", "Temperature"],
    "Demographics": ["Participant"],
    "G Force": ["Centrifuge"],
}
# Feature groups per feature set, and EEG channels per condition.
FEATURE_GROUPS = {
    "Explicit": ["ECG", "BR", "temp", "eyetracking", "G", "rawEEG", "processedEEG", "strain", "demographics"],
    "Implicit": ["ECG", "BR", "temp", "eyetracking", "rawEEG"],
}
GROUP_FEATURES = {
    "ECG": ["HR (bpm) - Equivital", "ECG Lead 1 - Equivital", "ECG Lead 2 - Equivital", "HR_instant - Equivital",
            "HR_average - Equivital", "HR_w_average - Equivital"],
    "BR": ["BR (rpm) - Equivital"],
    "temp": ["Skin Temperature - IR Thermometer (°C) - Equivital"],
    "eyetracking": ["Pupil position left X [HUCS mm] - Tobii", "Pupil position left Y [HUCS mm] - Tobii",
                    "Pupil position left Z [HUCS mm] - Tobii", "Pupil position right X [HUCS mm] - Tobii",
                    "Pupil position right Y [HUCS mm] - Tobii", "Pupil position right Z [HUCS mm] - Tobii",
                    "Pupil diameter left [mm] - Tobii", "Pupil diameter right [mm] - Tobii",
                    "Pupil Difference [mm]"],
    "G": ["magnitude - Centrifuge"],
    "cognitive": ["deviation - Cog", "RespTime - Cog", "Correct - Cog", "joystickPosMag - Cog",
                  "joystickVelMag - Cog"],
    "strain": ["Strain [0/1]"],
}
EEG_CHANNELS = {
    "shared": ["Fz", "F3", "C3", "C4", "CP1", "CP2", "T8", "TP9", "TP10", "P7", "P8"],
    "AFE": ["F4", "T7", "O1", "O2"],
    "noAFE": ["F1", "AFz", "AF4", "FT9", "FT10", "FC5", "FC3", "FC1", "FC2", "FC4", "FC6", "C5", "Cz", "CP5", "CP6",
              "P5", "P3", "P1", "Pz", "P4", "P6"],
}
EEG_BANDS = ["delta", "theta", "alpha", "beta"]
BASELINE_PREFERENCE = {0: ["v0"], 1: ["v1", "v0"], 2: ["v2", "v0"], 3: ["v7", "v5", "v1", "v0"],
                       4: ["v8", "v6", "v2", "v0"]}


def eeg_features(condition: str, processed: bool) -> list[str]:
    """Channels shared by both conditions plus those of ``condition`` (none for ``Complete``)."""
    channels = EEG_CHANNELS["shared"] + EEG_CHANNELS.get(condition, [])
    if not processed:
        return [f"{ch} - EEG" for ch in channels]
    return [f"{ch}_{band} - EEG" for ch in channels for band in EEG_BANDS]


def known_features(condition: str, feature_set: str, demographics: Sequence[str] = ()) -> dict[str, list[str]]:
    """Feature names by group for a condition filter and feature set."""
    made = {}
    for group in FEATURE_GROUPS[feature_set]:
        if group in ("rawEEG", "processedEEG"):
            made[group] = eeg_features(condition, group == "processedEEG")
        elif group == "demographics":
            made[group] = list(demographics)
        else:
            made[group] = GROUP_FEATURES[group]
    return made


def catalog_frame(spark: SparkSession, condition: str, feature_set: str,
                  demographics: Sequence[str] = ()) -> DataFrame:
    """Catalog rows (feature, group, family) for a condition filter and feature set."""
    family = {"ECG": "ECG", "rawEEG": "EEG", "processedEEG": "EEG"}
    rows = [(f, g, family.get(g, "Phys")) for g, fs in known_features(condition, feature_set, demographics).items()
            for f in fs]
    return spark.createDataFrame(rows, "feature string, grp string, family string")


def features_for(catalog: DataFrame, condition: str, feature_set: str, group: str = "grp",
                 owner: str = "owner") -> DataFrame:
    """Filter a catalog by group and owning condition (``shared``, ``AFE`` or ``noAFE``)."""
    owners = ["shared"] + ([condition] if condition in ("AFE", "noAFE") else [])
    return catalog.where(F.col(group).isin(FEATURE_GROUPS[feature_set]) & F.col(owner).isin(owners))


def normalize_streams(streams: Sequence[str] | None) -> list[str]:
    """Resolve aliases and drop repeats, keeping the order."""
    clean = [s.strip() for s in streams or [] if isinstance(s, str) and s.strip()]
    return list(dict.fromkeys(STREAM_ALIASES.get(s.lower(), s) for s in clean))


def stream_condition(streams: Sequence[str] | None, feature: str = "feature") -> Column | None:
    wanted = normalize_streams(streams)
    if not wanted:
        return None
    unknown = [s for s in wanted if s not in STREAM_PATTERNS]
    if unknown:
        raise ValueError(f"unknown streams: {unknown}; known: {sorted(STREAM_PATTERNS)}")
    patterns = dict.fromkeys(p for s in wanted for p in STREAM_PATTERNS[s])
    return reduce(lambda a, b: a | b, [F.col(feature).rlike(f"(?i){p}") for p in patterns])


def select_streams(catalog: DataFrame, streams: Sequence[str] | None, feature: str = "feature") -> DataFrame:
    """Features of the requested streams by case-insensitive patterns; no streams keeps all."""
    cond = stream_condition(streams, feature)
    return catalog if cond is None else catalog.where(cond)


def stream_columns(catalog: DataFrame, streams: Sequence[str] | None, feature: str = "feature") -> list[str]:
    """Names of the selected features; an empty selection is an error."""
    names = [r[0] for r in select_streams(catalog, streams, feature).select(feature).collect()]
    if not names:
        raise ValueError(f"no feature left for streams {streams}")
    return names


def select_streams_substring(catalog: DataFrame, streams: Sequence[str], feature: str = "feature") -> DataFrame:
    """Older rule: plain substrings; ``matches`` counts the streams a name holds."""
    lower = F.lower(F.col(feature))
    hits = sum((lower.contains(s.lower()).cast("int") for s in streams), F.lit(0))
    return catalog.withColumn("matches", hits).where("matches > 0")


def keep_unengineered(catalog: DataFrame, streams: DataFrame, feature: str = "feature",
                      stream: str = "stream") -> DataFrame:
    """Raw streams and ``<stream>_<v>`` only; derivatives go."""
    stem = F.regexp_replace(F.col(feature), r"_v[0-8]$", "")
    return (attach(catalog.withColumn("__stem", stem), streams.select(F.col(stream).alias("__stem")).distinct(),
                   ["__stem"], "left_semi").drop("__stem"))


def prefer_baseline(catalog: DataFrame, method: int, feature: str = "feature") -> DataFrame:
    """One baseline per stem by preference; methods outside 0-4 keep everything."""
    order = BASELINE_PREFERENCE.get(method)
    if order is None:
        return catalog
    parsed = catalog.select("*", F.regexp_extract(F.col(feature), r"^(.*)_(v[0-8])$", 1).alias("__stem"),
                            F.regexp_extract(F.col(feature), r"^(.*)_(v[0-8])$", 2).alias("__v"))
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("__v"))
    best = Window.partitionBy("__stem").orderBy("__rank", feature)
    return (parsed.withColumn("__rank", rank).where("__rank > 0")
            .withColumn("__k", F.row_number().over(best)).where("__k = 1").select(*catalog.columns))


def preferred_names(names: Sequence[str], method: int) -> list[str]:
    """The same choice over column names of a table, in their order; names are metadata."""
    order = BASELINE_PREFERENCE.get(method)
    if order is None:
        return list(names)
    parts = {n: re.fullmatch(r"(.*)_(v[0-8])", n) for n in names}
    rank: dict[str, int] = {}
    for m in parts.values():
        if m and m[2] in order:
            rank[m[1]] = min(rank.get(m[1], len(order)), order.index(m[2]))
    return [n for n, m in parts.items() if m and m[2] in order and rank[m[1]] == order.index(m[2])]


def parse_feature(catalog: DataFrame, feature: str = "feature") -> DataFrame:
    """Baseline, derivative order, statistic and standardization out of a name (NULL if absent)."""
    f = F.col(feature)
    part = lambda p: F.nullif(F.regexp_extract(f, p, 1), F.lit(""))
    return catalog.select(
        "*", part(r"_(v[0-8])(?=_|$)").alias("baseline"),
        F.when(f.contains("_2derivative"), 2).when(f.contains("_derivative"), 1).otherwise(0).alias("derivative"),
        part(r"_(mean|stddev|max|range|additional)(?=_|$)").alias("statistic"),
        part(r"_(s1|s2)$").alias("standardization"))


def feature_census(parsed: DataFrame) -> DataFrame:
    """Feature counts by baseline, by statistic and by standardization (long form, one pass)."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
                      for k in ("baseline", "statistic", "standardization")])
    return (parsed.select(F.inline(parts)).where("value is not null")
            .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))


def restrict_to(df: DataFrame, names: DataFrame | Sequence[str], keep: Sequence[str] = (),
                renames: Mapping[str, str] | None = None) -> DataFrame:
    """Keep only the listed features, in list order; a missing name is an error.

    Column names are metadata, so a saved list (a few thousand names) is read by the driver.
    """
    wanted = [r[0] for r in names.collect()] if isinstance(names, DataFrame) else list(names)
    wanted = [(renames or {}).get(n, n) for n in wanted]
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"features missing from the table: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *wanted]])


def restrict_catalog(catalog: DataFrame, saved: DataFrame, feature: str = "feature") -> DataFrame:
    """Catalog rows that appear in a saved selection."""
    return attach(catalog, saved.select(feature).distinct(), [feature], "left_semi")


def map_raw_to_features(features: DataFrame, raw: DataFrame, feature: str = "feature",
                        name: str = "raw", order: str = "ord") -> DataFrame:
    """The first raw name (by ``order``) contained in each feature name; NULL if none is.

    The raw names are column names of one table, so they travel as one sorted array on the
    catalog rows; no pair of names becomes a row.
    """
    listed = raw.agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("__raw"))
    first = F.get(F.filter("__raw", lambda r: F.contains(F.col(feature), r[name])), 0)
    return attach_one(features, listed).withColumn(name, first[name]).drop("__raw")


def unmatched_features(mapped: DataFrame, name: str = "raw") -> DataFrame:
    return mapped.where(F.col(name).isNull())


def alias_groups(groups: DataFrame, components: str = "components") -> DataFrame:
    """Replace each full alias subset by its display name, sorted."""
    c = F.array_distinct(components)
    for alias, parts in GROUP_ALIASES.items():
        want = F.array(*[F.lit(p) for p in parts])
        whole = F.size(F.array_except(want, c)) == 0
        c = F.when(whole, F.array_union(F.array_except(c, want), F.array(F.lit(alias)))).otherwise(c)
    return groups.withColumn(components, F.array_sort(c))


def component_matrix(groups: DataFrame, group: str = "grp", components: str = "components",
                     names: Sequence[str] | None = None) -> DataFrame:
    """Component by group 0/1 matrix (one column per group)."""
    long = groups.select(F.col(group).alias("__g"), F.explode(components).alias("component")).distinct()
    pivot = long.groupBy("component").pivot("__g", list(names) if names else None)
    return pivot.agg(F.count(F.lit(1)).cast("int")).na.fill(0)


def filter_groups(groups: DataFrame, wanted: DataFrame, components: str = "components") -> DataFrame:
    """Groups whose component set equals one of the wanted sets."""
    key = lambda df: df.withColumn("__key", F.array_join(F.array_sort(F.array_distinct(components)), "\x01"))
    return attach(key(groups), key(wanted).select("__key").distinct(), ["__key"], "left_semi").drop("__key")


def shared_features(selected: DataFrame, model: str = "model", feature: str = "feature") -> DataFrame:
    """Features selected by every model."""
    pairs = selected.select(model, feature).distinct()
    n = pairs.agg(F.countDistinct(model).alias("__n"))
    counts = pairs.groupBy(feature).agg(F.count(F.lit(1)).alias("__k"))
    return attach_one(counts, n).where("__k = __n").select(feature)


def unshared_features(selected: DataFrame, model: str = "model", feature: str = "feature") -> DataFrame:
    """Features of a model that not all models share."""
    shared = shared_features(selected, model, feature)
    return selected.select(model, feature).distinct().join(shared, feature, "left_anti")


def membership_counts(selected: DataFrame, model: str = "model", feature: str = "feature") -> DataFrame:
    """How many features belong to exactly each set of models."""
    sets = selected.groupBy(feature).agg(F.array_join(F.array_sort(F.collect_set(F.col(model).cast("string"))), "+")
                                         .alias("members"))
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))
