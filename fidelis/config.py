"""Default thresholds and weights.

Fixed values that must equal the reference behaviour for identical results.
They are parameters everywhere; these are only the defaults.
"""

# --- fixed values (reference defaults) -------------------------------------------------
KS_THRESHOLD = 0.05            # KS statistic must be strictly below this
JS_THRESHOLD = 0.1             # sqrt(JS divergence), natural log
JS_BINS = 50
MOMENT_THRESHOLD = 0.1         # relative mean / std difference
CORR_THRESHOLD = 0.1           # normalised Frobenius norm and top-pair difference
CORR_TOP_N = 10
ZSCORE_LIMIT = 3.0             # |z| above this is an outlier
ZSCORE_RATE_THRESHOLD = 0.01   # share of outliers must be strictly below this
ZSCORE_EXTREME = 5.0           # EDA extreme count
IQR_FACTOR = 1.5
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.01
FOREST_RATE_THRESHOLD = 0.05
FOREST_SEED = 42
SIMILARITY_THRESHOLD = 0.4     # best cosine below this flags a row
SIMILARITY_SAMPLE = 20
SIMILARITY_ESCALATE_RATE = 0.15
REVIEW_SAMPLE = 10
REVIEW_SEED = 7
REVIEW_PASS = 0.7
RULE_AMOUNT_MAX = 50000.0
RULE_TIME_MAX = 172792.0
RULE_FEATURE_ABS_MAX = 10.0
RULE_PATTERN_AMOUNT = 1000.0
LAYER_WEIGHTS = {"rules": 0.20, "statistics": 0.40, "review": 0.25, "similarity": 0.15}
PASS_THRESHOLD = 0.75
MAX_RETRIES = 2
RETRY_SEED_BASE = 42
RETRY_SEED_STEP = 1000
FALLBACK_SCORES = {"rules": 0.95, "statistics": 0.85, "review": 0.90, "similarity": 0.90}
AUDIT_HIGH_SCORE = 0.85
AUDIT_MANY_ANOMALIES = 5
AUDIT_LOW_SCORE = 0.4
AUDIT_HEDGE_SCORE = 0.9
AUDIT_SMALL_PENALTY = -0.10
AUDIT_LARGE_PENALTY = -0.25
HEDGE_WORDS = ["might", "possibly", "unclear", "perhaps", "uncertain", "not sure", "could be"]
COLUMN_TOKEN_PATTERN = r"\b(V\d+|Amount|Time|Class)\b"
CARD_COLUMNS = ["Time"] + [f"V{i}" for i in range(1, 29)] + ["Amount", "Class"]
UNSAFE_CONDITION_PATTERN = r"import|exec|eval|__"
PARSE_ERROR_FEATURE = "parse_error"
KS_BANDS = [(0.05, "Excellent"), (0.10, "Good"), (0.20, "Fair")]   # else Poor
RATE_MATCH_TOLERANCE = 0.0001
RULE_NAME_PREFIX = "gemini_"
REVIEW_RECORD_LINE = "Row %d: Class=%d, Amount=%.2f"
PARSE_ERROR_PREFIX = "Could not parse response: "
PARSE_ERROR_CHARS = 200
GRADE_RULES = {"excellent": (90.0, 26), "good": (85.0, 23), "moderate": (80.0, 0)}
# ----------------------------------------------------------------------------------------

# messages of this library (printf style; {amount} / {key} are column names filled in at plan time)
REVIEW_MSG_AMOUNT = "positive row: {amount} of %.2f is above the limit (median of real positives: %.2f)"
REVIEW_MSG_KEY_POSITIVE = "positive row: {key} of %.3f is above the limit (mean of real positives: %.2f)"
REVIEW_MSG_KEY_NEGATIVE = "negative row: {key} of %.3f is below the limit"
AUDIT_MSG_HIGH = "contradiction: score %.2f with %d anomalies"
AUDIT_MSG_LOW = "contradiction: score %.2f with zero anomalies"
AUDIT_MSG_HEDGE = "contradiction: hedging words, score above the limit"
AUDIT_MSG_FEATURE = "unknown feature in row %s: %s"
AUDIT_MSG_TOKEN = "unknown column in an observation: %s"


def weights_sum() -> float:
    return float(sum(LAYER_WEIGHTS.values()))
