"""Constants of the recordings: event marks, missing-mark rules and demographic columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event marks (the onset mark is a parameter of the labelling operators).
BEGIN_GOR = "begin GOR"
END_GOR = "end GOR"
BEGIN_ROR = "begin ROR"
STRAIN = "strain during GOR"
RECOVERY = "return to consciousness"
PEAK_ROWS = 5000

# Missing marks (trial, level, add end mark, clear existing marks).
EVENT_RULES = [
    ("04-06", 6.1, False, False),
    ("06-02", 8.1, False, False),
    ("07-06", 4.6, False, False),
    ("08-02", 8.3, False, False),
    ("08-05", 4.3, True, False),
    ("08-06", 8.2, False, False),
    ("09-03", 8.7, False, False),
    ("09-05", 4.8, False, False),
    ("10-05", 3.8, False, False),
    ("10-06", 5.5, False, True),
    ("11-02", 5.5, False, False),
    ("12-03", 3.7, False, False),
    ("13-02", 7.3, False, False),
    ("13-04", 7.4, False, False),
]
END_MARK_ONLY = ["06-06"]

# Demographic columns of the source file and their feature names.
DEMOGRAPHICS = {
    "Gender code [1/0]": "participant_gender",
    "Age [yr]": "participant_age",
    "height [m]": "participant_height",
    "weight (kg)": "participant_weight",
    "BMI [kg/m^2]": "participant_BMI",
    "Blood Volume [L]": "participant_blood_volume",
    "Resting SBP (seat)": "participant_SBP_seated",
    "resting SBP (stand)": "participant_SBP_stand",
    "SBP after squat": "participant_SBP_exercise",
    "Resting DBP (seat)": "participant_DBP_seated",
    "resting DBP (stand)": "participant_DBP_stand",
    "DBP after squat": "participant_DBP_exercise",
    "Resting MAP": "participant_MAP_seated",
    "Resting MAP (stand": "participant_MAP_stand",
    "Post-Squat MAP": "participant_MAP_exercise",
    "resting HR [seated]": "participant_HR_seated",
    "resting HR (stand)": "participant_HR_stand",
    "HR after squat": "participant_HR_exercise",
    "Max (N)": "participant_max_leg_strength",
    "largest leg circ. [cm]": "participant_largest_leg_circumference",
    "lower leg volume [mL]": "participant_lower_leg_volume",
    "chest avg": "participant_skinfolds_chest_avg",
    "abd avg": "participant_skinfolds_abd_avg",
    "thigh avg": "participant_skinfolds_thigh_avg",
    "midax avg": "participant_skinfolds_midax_avg",
    "subscap avg": "participant_skinfolds_subscap_avg",
    "tri avg": "participant_skinfolds_tri_avg",
    "supra avg": "participant_skinfolds_supra_avg",
    "sum": "participant_skinfolds_sum",
    "% fat": "participant_percent_fat",
    "leg avg": "participant_leg_length",
    "arm avg": "participant_arm_length",
    "neck (MNL) avg": "participant_midline_neck_length",
    "neck (LNL) avg": "participant_lateral_neck_length",
    "torso (post) avg ": "participant_torso_length_post",
    "torso (ax) avg ": "participant_torso_length_ax",
    "head to heart avg": "participant_head_to_heart",
    "head avg": "participant_head_girth",
    "neck avg": "participant_neck_girth",
    "chest upper avg": "participant_chest_upper_girth",
    "chest under avg": "participant_chest_under_girth",
    "waist avg": "participant_waist_girth",
    "hip avg": "participant_hip_girth",
    "calf avg": "participant_calf_girth",
    "bicep flex avg": "participant_biceps_girth_flex",
    "bicep relax avg": "participant_biceps_girth_relax",
    "avg (N) flexion": "participant_neck_flexion",
    "avg (N) extens": "participant_neck_extension",
    "avg (N) Rt. Rot": "participant_neck_right_rotation",
    "avg (N) left rot": "participant_neck_left_rotation",
    "avg (N) left lat flex": "participant_neck_left_lat_flex",
    "avg (N) rt lat flex": "participant_neck_right_lat_flex",
    "pred. Vo2": "participant_pred_vo2",
}
# The thigh girth shares its source column name with the thigh skinfold.
DEMOGRAPHIC_COPIES = {"participant_thigh_girth": "participant_skinfolds_thigh_avg"}


def event_rules(spark: SparkSession) -> DataFrame:
    """Rules table for :func:`trialspan.operators.events.apply_event_rules`."""
    rows = EVENT_RULES + [(t, None, True, False) for t in END_MARK_ONLY]
    return spark.createDataFrame(rows, "trial_id string, g double, add_end boolean, clear_existing boolean")
