"""They must equal the published contract for results to match."""

from __future__ import annotations

# Outcome taxonomy, in report order.
OUTCOMES = (
    "completed",
    "contract_failed",
    "agent_error",
    "infra_error",
    "timeout",
    "cancelled",
    "unknown",
)

# Exception class names by outcome family; other names are "unknown".
TIMEOUT_EXCEPTIONS = (
    "AgentSetupTimeoutError",
    "AgentTimeoutError",
    "EnvironmentStartTimeoutError",
    "TimeoutError",
    "VerifierTimeoutError",
)
CANCELLED_EXCEPTIONS = ("CancelledError", "KeyboardInterrupt")
AGENT_EXCEPTIONS = (
    "AgentAuthenticationError",
    "AgentSafetyRefusalError",
    "ApiConnectionClosedError",
    "ApiConnectionError",
    "ApiError",
    "ApiInternalServerError",
    "ApiKeyRejectedError",
    "ApiOverloadedError",
    "ApiProviderResourceNotFoundError",
    "ApiRateLimitError",
    "ApiResponseStalledError",
    "ApiUsageLimitError",
    "AuthenticationError",
    "ContextLengthExceededError",
    "ContextWindowExceededError",
    "ModelNotFoundError",
    "NetworkConnectionError",
    "NonZeroAgentExitCodeError",
    "NotAuthenticatedError",
    "OAuthCallbackError",
    "OutputLengthExceededError",
    "OutputTokenExceededError",
    "UnknownApiError",
)
INFRA_EXCEPTIONS = (
    "AddTestsDirError",
    "DownloadVerifierDirError",
    "HealthcheckError",
    "MemoryLimitExceededError",
    "RewardFileEmptyError",
    "RewardFileNotFoundError",
    "RuntimeRequestError",
    "SandboxBuildFailedError",
    "ServiceOperationsUnsupportedError",
    "VerifierOutputParseError",
)

# Statistics contract.
DEFAULT_SEED = 42
BOOTSTRAP_RESAMPLES = 10_000
BOOTSTRAP_CONFIDENCE = 0.95
MIN_BOOTSTRAP_CLUSTERS = 5
REPEAT_RANGE_FLAG_PCT = 20.0
REPEAT_DEVIATION_FLAG_PCT = 10.0
NEAR_TIMEOUT_FRACTION = 0.6
POINTS_TOLERANCE = 1e-9
SUMS_REL_TOLERANCE = 1e-9
SUMS_ABS_TOLERANCE = 1e-6
BASE_ADJUSTMENT_FRACTION = 0.05
WEIGHT_SUM_TOLERANCE = 0.01

# File names and hash headers.
RUN_RECORD_FILE = "aat-run.json"
TRIAL_RESULT_FILE = "result.json"
GRADING_RESULT_FILE = "grading_result.json"
JUSTIFICATION_PATH = "artifacts/app/grading_output/justification.md"
DIRECTORY_HASH_HEADER = "aat-dir-sha256-v1"
PARTS_HASH_HEADER = "aat-parts-sha256-v1"

# Upload folder, archive and assignment name patterns.
UPLOAD_FOLDER_PATTERN = (
    r"^(\d+)-(\d+)\s+-\s+(\S+)\s+(.+?)\s+-\s+([A-Z][a-z]{2})\s+(\d{1,2}),"
    r"\s+(\d{4})\s+(\d{3,4})\s+(AM|PM)$"
)
SCAN_EXPORT_PATTERN = r"^assignment_\d+_export$"
ARCHIVE_NAME_PATTERN = r"(?i)\b(homework|hw|pso|problem\s*set|exam)\s*_?\s*(\d+)\b"
ASSIGNMENT_ID_PATTERN = r"^([A-Za-z]+?)0*(\d+)$"
SERIES_ALIASES = {
    "homework": "HW",
    "hw": "HW",
    "pso": "PSO",
    "problemset": "PSO",
    "exam": "EXAM",
}
STUDENT_ID_PATTERN = r"^S(\d{3,})$"
SOLUTION_SUFFIXES = (".pdf", ".ipynb")
GRADE_COLUMN_PATTERN = (
    r"^(.+ Points Grade) <Numeric MaxPoints:([^<> ]+)"
    r"(?: (?:Weight|Category|CategoryWeight):[^<>]+)?>$"
)
RUBRIC_LINE_PATTERN = (
    r"^- `([^`]+)`\s+\((\d+(?:\.\d+)?)\s+points?(\s*,\s*bonus)?\):\s+(\S.*)$"
)

# Names a submission must not contain.
BOOKKEEPING_NAMES = (".git", "__pycache__", ".ipynb_checkpoints", ".DS_Store", "node_modules")
BOOKKEEPING_SUFFIXES = (".swp", ".swo", "~")

# Registry domains.
ASSESSMENT_TYPES = ("homework", "exam", "practice", "project", "attendance", "other")
ASSESSMENT_SCOPES = ("take_home", "online_exam", "in_person_exam", "presentation", "in_person")
AI_POLICIES = ("allowed", "not_allowed", "not_applicable")
RUBRIC_PROVENANCES = ("applied_scheme", "professor_rubric", "handout", "authored")
RESERVED_ENVIRONMENT = "grading"
EXPECTED_COURSE_ENTRIES = (
    "course.toml",
    "assignments",
    "reference_solutions",
    "rubrics",
    "syllabus",
    "intake-notes.md",
    "intake-record.json",
    "intake-pending",
)

# Document evidence thresholds.
INK_PIXEL_MAX = 247
LOW_INK_FRACTION = 0.001
SUBSTANTIAL_CONTENT_BYTES = 1024
SUBSTANTIAL_IMAGE_INK = 0.001
SCAN_IMAGE_MIN_PIXELS = 1000
PARTIAL_RENDER_RATIO = 4.0
NO_TEXT_LAYER_CHARS = 50
UNREADABLE_FLAGS = ("DAMAGED", "DISCREPANCY", "PARTIAL_RENDER")
