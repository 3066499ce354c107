"""Fixed values. They define the results and must not be tuned: names, limits, weights, formats."""

# Candidate sources of the unified retrieval, in tie-break order.
SOURCES = ("svd", "dssm", "content", "visual", "item_cf", "popular", "explore")
# Rows each source may contribute per user.
SOURCE_LIMITS = {
    "svd": 150, "dssm": 200, "content": 150, "visual": 150, "item_cf": 100, "popular": 50, "explore": 50,
}
SOURCE_MIN_CONFIDENCE = {name: 0.0 for name in SOURCES}
# Soft caps inside every window of ten served rows.
SOURCE_CAPS_AT_10 = {
    "svd": 7, "dssm": 6, "content": 4, "visual": 3, "item_cf": 3, "popular": 2, "explore": 1,
}
FEATURE_SCHEMA = "unified-seven-source-v3"

# Sources of the quota mixer, in tie-break order, and its two policies.
MIX_SOURCES = ("model", "content_profile", "item_cf", "popular", "explore")
SAFE_POLICY = "safe_svd_content_v2"
DYNAMIC_POLICY = "dynamic_confidence_v2"

# Feedback weight and disposition per event type; dwell is graded by its length.
FEEDBACK = {
    "impression": (0.0, "context"),
    "click": (1.0, "positive"),
    "like": (3.0, "positive"),
    "share": (4.0, "positive"),
    "revisit": (1.5, "positive"),
    "not_interested": (-2.0, "negative"),
}
EVENT_TYPES = ("impression", "click", "like", "dwell", "revisit", "share", "not_interested")
# What clients may send: revisit is derived, favorite is an old name of like.
CLIENT_EVENT_TYPES = ("impression", "click", "like", "favorite", "dwell", "share", "not_interested")
DWELL_MIN_MS = 750
DWELL_MAX_MS = 600_000
DWELL_SHORT_MS = 5_000
DWELL_LONG_MS = 30_000
POSITION_MAX = 9_999
ID_MAX_CHARS = 128
FEEDBACK_CAP = 6.0
AFFINITY_CAP = 4.0
# Affinity kept per user and item.
STATE_CEILING = 8.0
STATE_NOT_INTERESTED = -4.0

FEEDS = ("personalized", "popular", "explore")
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
MINUTE_MS = 60_000
MAX_RANGE_DAYS = 366
HALF_LIVES = (1.0, 7.0, 30.0)
NEGATIVES = 100
METRIC_K = 10
ALERT_METRICS = (
    "requests", "exposures", "impressions", "clicks", "likes", "ctr", "active_users", "latency_p95", "offline_items",
)
ALERT_OPERATORS = (">", ">=", "<", "<=")
ALERT_SEVERITIES = ("info", "warn", "critical")
FUSION_WEIGHTS = (0.16, 0.17, 0.175, 0.18, 0.19)
HISTORY_BOUNDS = (5, 10, 20, 50)
POPULARITY_BOUNDS = (0, 1, 2, 4, 8, 16, 32, 64)
# Scores are compared after rounding, so that the order of a distributed float sum cannot
# decide a tie; ids then decide.
SCORE_DIGITS = 9
