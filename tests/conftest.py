from __future__ import annotations

import pytest

from gradeloom import schemas
from gradeloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, 4)
    yield session


DEFAULTS = {
    "stage": "grade",
    "job_name": "J",
    "outcome": "completed",
    "late_exception": False,
    "grading_load_error": False,
    "superseded": False,
    "config_name": "judge",
    "config_identity": "id-judge",
    "course_id": "C",
    "assignment_id": "HW1",
    "rubric_sha256": "r",
    "item_identity": "I",
}


@pytest.fixture
def make_trials(spark):
    """Trials from partial rows; other columns take defaults or NULL."""

    def make(*rows: dict):
        names = schemas.TRIALS.fieldNames()
        full = [tuple({**DEFAULTS, **row}.get(n) for n in names) for row in rows]
        return spark.createDataFrame(full, schemas.TRIALS)

    return make
