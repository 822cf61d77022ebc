"""Fixed values the results depend on.

These must equal the service this package re-implements, so they are stated
here plainly, in their natural order, in one place.
"""

# ---------------------------------------------------------------------------
# Canonical schedule columns and model features
# ---------------------------------------------------------------------------
ID = "id"
DATE = "date"
START = "start_time_by_minutes"
END = "end_time_by_minutes"
SCHEDULE_COLUMNS = [ID, DATE, START, END]

ID_ENCODED = "id_encoded"
DAY_OF_WEEK = "day_of_week"
WEEK_OF_MONTH = "week_of_month"
WEEK_OF_YEAR = "week_of_year"
MONTH = "month"
DAY_OF_YEAR = "day_of_year"
# Order matters: it is the order of the feature vector.
FEATURES = [ID_ENCODED, DAY_OF_WEEK, WEEK_OF_MONTH, WEEK_OF_YEAR, MONTH, DAY_OF_YEAR]

# ---------------------------------------------------------------------------
# Random-forest configuration
# ---------------------------------------------------------------------------
N_TREES = 100
MAX_DEPTH = 10
SEED = 42

# ---------------------------------------------------------------------------
# Text formats
# ---------------------------------------------------------------------------
# Upload date formats, tried in this order; the first that parses any row wins.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy"]
# Display format of dates in forecasts and in stored text.
DISPLAY_DATE_FORMAT = "dd/MM/yyyy"
# CSV separators, tried in this order.
CSV_SEPARATORS = [",", ";", "\t"]
# Weekday names, Monday first.
WEEKDAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
# Marker for a forecast that is not usable.
NA_VALUE = "NA"
# Text that a pandas CSV reader turns into a missing value by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# Dates a pandas timestamp can hold; others parse to missing.
MIN_DATE = "1677-09-22"
MAX_DATE = "2262-04-11"

# Default header names of an upload.
DEFAULT_COLUMN_NAMES = {"id": "ID", "date": "Date", "start_time": "Start Time",
                        "end_time": "End Time"}

# ---------------------------------------------------------------------------
# Quotas, bans, retention, sessions
# ---------------------------------------------------------------------------
DEFAULT_QUOTAS = {
    "models_per_ip": 10,
    "max_file_size_mb": 50,
    "max_entities_per_model": 10000,
    "max_data_points": 100000,
    "max_storage_per_ip_mb": 500,
    "requests_per_minute": 60,
    "train_per_hour": 5,
    "predictions_per_day": 1000,
    "ban_after_violations": 10,
    "ban_duration_hours": 24,
}
# A request without a client address counts for this one.
UNKNOWN_IP = "unknown"
# Storage reserved for a new upload: this many times its size.
UPLOAD_STORAGE_FACTOR = 3
SESSION_LIFETIME_DAYS = 365
TOKEN_LENGTH = 64
LOG_RETENTION_DAYS = 30
LOG_RETENTION_TRIGGER_ROWS = 10000
SUSPICIOUS_WARNING_VIOLATIONS = 5

# Security event types and severities.
EVENT_SESSION_CREATED = "session_created"
EVENT_SESSION_DELETED = "session_deleted"
EVENT_SESSION_ACCESSED = "session_accessed"
EVENT_MODEL_TRAINED = "model_trained"
EVENT_PREDICTION_MADE = "prediction_made"
EVENT_IP_CHANGED = "ip_changed"
EVENT_RATE_LIMIT_HIT = "rate_limit_hit"
EVENT_BANNED = "banned"
EVENT_UNBANNED = "unbanned"
SEVERITY_INFO = "INFO"
SEVERITY_WARNING = "WARNING"

# Days of a forecast window when a request names none.
DEFAULT_WINDOW_SIZE = 31
