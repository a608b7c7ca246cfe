"""Names, limits, patterns and orders that results depend on."""

# Key columns of the tables.
MODEL_KEYS = ["tenant_id", "model_name", "version"]
RUN_KEYS = ["tenant_id", "model_name", "version", "job_id", "run_id"]

# Known statuses, in display order.
PIPELINE_STATUSES = ["draft", "active", "archived"]
JOB_STATUSES = ["pending", "running", "awaiting_approval", "success", "failed", "cancelled"]
STEP_STATUSES = ["idle", "running", "succeeded", "failed", "awaiting_approval", "approved", "rejected"]
MODEL_STAGES = ["None", "Staging", "Production", "Archived"]
MONITORING_STATUSES = ["Passed", "Failed", "Rework", "InReview", "NotStarted"]

# What may be done with a job in which status.
TERMINAL_JOB_STATUSES = ["success", "failed", "cancelled"]
STOPPABLE_JOB_STATUSES = ["running", "awaiting_approval", "pending"]
RERUNNABLE_JOB_STATUSES = ["failed", "cancelled", "success"]
RESUMABLE_JOB_STATUSES = ["failed", "cancelled"]

# Step types in the only order they may appear in.
STEP_ORDER = ["data_pipeline", "execute_model", "data_quality_check", "approval", "load_to_snowflake"]
RUNNABLE_STEP_TYPES = ["data_pipeline", "execute_model", "data_quality_check", "load_to_snowflake"]
# Step settings that must stay under the tenant's data prefix.
TENANT_URI_FIELDS = {
    "data_pipeline": ["destination_uri", "script_uri"],
    "execute_model": ["input_uri", "output_uri"],
    "data_quality_check": ["input_uri"],
}

# Stage moves that are allowed.
LEGAL_STAGE_MOVES = [
    ("None", "Staging"),
    ("Staging", "Production"),
    ("Staging", "Archived"),
    ("Production", "Archived"),
]

# Monitoring limits and the floor used inside PSI.
PSI_WARN, PSI_FAIL = 0.10, 0.25
ERROR_RATE_WARN, ERROR_RATE_FAIL = 0.05, 0.15
PSI_FLOOR = 1e-4
# How far a baseline's proportions may be from 1.
PROPORTION_SUM_RANGE = (0.99, 1.01)

# Other limits.
STEP_TIMEOUT_SECONDS = 6 * 3600
VCPU_PER_WORKER = 4
RECENT_LIMIT = 5
SEARCH_LIMIT = 8
RETENTION_DAYS = 90

# Lineage columns added to every loaded row.
RUN_ID_COLUMN = "_run_id"
LOAD_DATE_COLUMN = "_load_date"
# Our own: the file a loaded row came from.
SOURCE_FILE_COLUMN = "_source_file"

# Accepted text forms.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$]*$"
URI = r"^s3://[A-Za-z0-9._\-]+(/[A-Za-z0-9._\-/=]*)?$"
VERSION = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
TICKET = r"(?i)^(CHG|RITM|INC|REQ|TASK)\d{6,10}$"

# Units for relative times, in seconds.
TIME_UNITS = [
    ("year", 31536000),
    ("month", 2592000),
    ("week", 604800),
    ("day", 86400),
    ("hour", 3600),
    ("minute", 60),
    ("second", 1),
]

# Notes shown with a check's result.
NOTE_COLUMN_ABSENT = "column '%s' not found in scoring output — check fails"
NOTE_FIRST_RUN = "first run — no previous row count to compare"
NOTE_NO_BASELINE = "no drift baseline registered — no expected schema to compare"
NOTE_COLUMNS_MISSING = "missing expected columns: ['%s']"
