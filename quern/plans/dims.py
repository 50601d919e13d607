"""Task families and what each needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Number, dimension, name, key and evidence of each task family.
TASKS = [
    (1, "Executability", "Spatial Precondition", "Task_01_Spatial_Precondition", "video_clip"),
    (2, "Executability", "Affordance Precondition", "Task_02_Affordance_Precondition", "video_clip"),
    (3, "Executability", "Physical Feasibility", "Task_03_Physical_Feasibility", "video_clip"),
    (4, "Effects", "Affordance Visual Semantics", "Task_04_Affordance_Visual_Semantics", "keyframe_single"),
    (5, "Effects", "Holistic Causal Chain", "Task_05_Holistic_Causal_Chain", "keyframe_single"),
    (6, "Effects", "Spatial Postcondition", "Task_06_Spatial_Postcondition", "video_clip"),
    (7, "Effects", "Affordance Postcondition", "Task_07_Affordance_Postcondition", "video_clip"),
    (8, "Composition", "Goal Recognition", "Task_08_Goal_Recognition", "video_prefix"),
    (9, "Composition", "Macro Anchor Extraction", "Task_09_Macro_Anchor_Extraction", "video_prefix"),
    (10, "Composition", "Clip-to-Step Goal", "Task_10_Clip_to_Step_Goal", "video_clip"),
    (11, "Composition", "Action Phrase", "Task_11_Action_Phrase", "video_clip"),
    (12, "Composition", "State Evolution", "Task_12_State_Evolution", "keyframe_single"),
    (13, "Composition", "Strategic Rationale", "Task_13_Strategic_Rationale", "video_clip"),
    (14, "Composition", "Inter-Step Dependency", "Task_14_Inter_Step_Dependency", "video_clip_pair"),
    (15, "Composition", "Next Step Prediction", "Task_15_Next_Step_Prediction", "video_prefix"),
    (16, "Composition", "Middle Steps Infill", "Task_16_Middle_Steps_Infill", "video_clip_pair"),
    (17, "Composition", "Next K Steps Prediction", "Task_17_Next_K_Steps_Prediction", "video_prefix"),
    (18, "Robustness", "Bad Plan Diagnosis and Repair", "Task_18_Bad_Plan_Diagnosis_And_Repair", "video_prefix"),
    (19, "Robustness", "Counterfactual Outcome", "Task_19_Counterfactual_Outcome", "video_clip"),
    (20, "Robustness", "Failure Recovery", "Task_20_Failure_Recovery", "video_clip"),
]
NAMES = {t[0]: t[3] for t in TASKS}


def task_table(spark: SparkSession) -> DataFrame:
    """Twenty rows, fit to be broadcast."""
    return spark.createDataFrame(TASKS, "task_id int, dimension string, name string, task_name string, evidence_type string")
