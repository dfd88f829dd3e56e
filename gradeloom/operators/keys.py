"""Group keys and report columns shared by the derived tables."""

from __future__ import annotations

CONFIG = ["config_name", "config_identity"]
SOLVE = [*CONFIG, "course_id", "assignment_id"]
LADDER_CONFIG = [
    "solver_config_name",
    "solver_config_identity",
    "grading_config_name",
    "grading_config_identity",
]
LADDER_COURSE = [*LADDER_CONFIG, "course_id"]
LADDER_ASSIGNMENT = [*LADDER_COURSE, "assignment_id", "rubric_sha256"]
STUDENT = [*CONFIG, "course_id", "assignment_id", "student_id", "rubric_sha256"]
CLASS = [*CONFIG, "course_id", "assignment_id", "rubric_sha256"]
STAGE_CONFIG = ["stage", *CONFIG]
JOB_CONFIG = ["stage", "job_name", *CONFIG]
ITEM = ["item_id", "item_identity"]
REPEAT = [*CONFIG, "course_id", "assignment_id", *ITEM]
JUDGE = [*CONFIG, *ITEM]
TRIAL = ["job_name", "trial_name"]
