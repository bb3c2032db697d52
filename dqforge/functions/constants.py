"""Fixed values that results depend on.

Everything in this module must equal the values the original application uses
(labels, thresholds, word lists, patterns); keep them as plain text, in
natural order, together.
"""

# ---- fixed values: rule labels (recorded in the ``rule`` column) ----------
RULE_NOT_NULL = "not null"
RULE_UNIQUE = "unique"
RULE_IN_SET = "in allowed set"
RULE_REGEX = "matches regex"
RULE_IN_RANGE = "in range"          # rendered as "in range {min}-{max}"
RULE_DATE_RANGE = "in date range"
RULE_ALL_NOT_NULL = "all not null"
RULE_UNIQUE_COMBINATION = "unique combination"
RULE_ALL_IN_SETS = "all in allowed sets"
RULE_ALL_MATCH = "all match patterns"
RULE_ALL_IN_RANGES = "all in ranges"
RULE_SIMILARITY = "levenshtein similarity"  # "levenshtein similarity (threshold: t)"
RULE_IS_BOOLEAN = "is boolean"
RULE_IS_NUMERIC = "is numeric"
RULE_IS_DATETIME = "is datetime"
RULE_LENGTH = "length"
RULE_CONTAINS = "contains"

# ---- fixed values: health bands (rate >= lower bound) ---------------------
HEALTH_BANDS = [(90, "Excellent"), (75, "Good"), (50, "Fair")]
HEALTH_FLOOR = "Poor"
# score colour band of the field summary (a different cut than health)
SCORE_COLOR_BANDS = [(90, "score-excellent"), (70, "score-good"), (50, "score-warning")]
SCORE_COLOR_FLOOR = "score-poor"
# rules counted as "passed" in tracking entries
PASSED_RULE_RATE = 90

# ---- fixed values: critical-column thresholds -----------------------------
CRITICAL_MIN_COMPLETENESS = 80
CRITICAL_MIN_DENSITY = 0.7
CRITICAL_MAX_NULL_SHARE = 0.5
CONFIDENCE_HIGH = 95
CONFIDENCE_MEDIUM = 90
CONFIDENCE_NEAR_PERFECT = 99
REASON_THRESHOLD = "Meets quality threshold"
REASON_EXCELLENT = "Excellent completeness"
REASON_HIGH = "High completeness"
REASON_NEAR_PERFECT = "Near-perfect completeness"
REASON_LOW = "Low completeness (%.1f%%)"
REASON_NULLS = "Too many null values"

# ---- fixed values: similarity distribution buckets ------------------------
SIMILARITY_BUCKETS = [("very_high", 0.9, None), ("high", 0.8, 0.9), ("medium", 0.6, 0.8),
                      ("low", 0.4, 0.6), ("very_low", None, 0.4)]

# ---- fixed values: colours of the rule bars --------------------------------
BAR_COLORS = [(90, "#28a745"), (75, "#17a2b8"), (50, "#ffc107")]
BAR_COLOR_FLOOR = "#dc3545"

# ---- fixed values: consistency scoring ------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IQR_FACTOR = 1.5
NUMERIC_CONSISTENCY_FLOOR = 70
OUTLIER_PENALTY = 2
OTHER_TYPE_CONSISTENCY = 95.0
LENGTH_DEVIATION_SHARE = 0.5
LENGTH_MIN_MEAN = 5
LENGTH_MIN_SAMPLE = 5
LENGTH_PENALTY = 0.5
CASE_MIN_ALPHA = 5
CASE_MAX_PATTERNS = 2
CASE_PENALTY = 0.1
BOOLEAN_TEXT_VALUES = ["true", "false", "1", "0"]

# ---- fixed values: history retention --------------------------------------
SNAPSHOTS_KEEP = 10
SNAPSHOT_SAMPLE_ROWS = 1000
TOP_VALUES_FOR_SETS = 20
SAMPLE_VALUES = 5
PREVIEW_ROWS = 10

# ---- fixed values: pandas' default NA tokens for CSV reads ----------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# ---- fixed values: regex presets offered for pattern rules ----------------
PATTERN_PRESETS = {
    "Email Address": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "US Phone Number": r"^\(\d{3}\)\s\d{3}-\d{4}$",
    "International Phone": r"^\+?[\d\s\-\(\)]{7,15}$",
    "ZIP Code (US)": r"^\d{5}(-\d{4})?$",
    "Postal Code (Canada)": r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$",
    "Social Security Number": r"^\d{3}-\d{2}-\d{4}$",
    "Credit Card Number": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "URL/Website": r"^https?://(?:[-\w.])+(?:\.[a-zA-Z]{2,})+(?:/[^?\s]*)?(?:\?[^#\s]*)?(?:#[^\s]*)?$",
    "IP Address": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "Date (YYYY-MM-DD)": r"^\d{4}-\d{2}-\d{2}$",
    "Date (MM/DD/YYYY)": r"^\d{2}/\d{2}/\d{4}$",
    "Time (HH:MM)": r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$",
    "Currency (USD)": r"^\$?[\d,]+\.?\d{0,2}$",
    "Alphanumeric Code": r"^[A-Za-z0-9]+$",
    "Letters Only": r"^[A-Za-z\s]+$",
    "Numbers Only": r"^\d+$",
}

# ---- fixed values: rule descriptions (report grouping) --------------------
RULE_DESCRIPTIONS = {
    "not null": "Checks for missing or empty values in the column. Ensures data completeness.",
    "unique": "Verifies that all values in the column are distinct. Identifies duplicate entries.",
    "matches regex": "Validates data format using pattern matching. Ensures values follow specific formats (emails, phone numbers, etc.).",
    "in allowed set": "Confirms values are from a predefined list of acceptable options. Enforces data consistency.",
    "in range": "Ensures numeric values fall within specified minimum and maximum bounds.",
    "in date range": "Validates that dates fall within acceptable time periods.",
    "is boolean": "Checks that values are valid boolean (True/False) data types.",
    "is numeric": "Verifies that values are valid numbers (integers or decimals).",
    "is datetime": "Ensures values are properly formatted date and time data.",
    "length": "Validates that text values meet minimum and maximum character length requirements.",
    "contains": "Checks if values contain specific required text or characters.",
    "levenshtein similarity": "Measures text similarity between two columns using Levenshtein distance. Identifies exact matches, values within similarity threshold, and potential data entry variations.",
}
DEFAULT_RULE_DESCRIPTION = "Validates data quality according to specified business rules."

# ---- fixed values: type labels --------------------------------------------
TYPE_DATETIME = "Date/Time"
TYPE_BOOLEAN = "Boolean"
TYPE_INTEGER = "Integer"
TYPE_DECIMAL = "Decimal"
TYPE_NUMERIC = "Numeric"
TYPE_TEXT = "Text/String"
TYPE_OTHER = "Other"
TYPE_UNKNOWN = "Unknown"
