"""Numbers of the engine; times in milliseconds."""

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS

LATENESS_MS = 2 * MINUTE_MS
IDLE_MS = 30_000
CATCH_UP_MS = 5 * MINUTE_MS
MEMORY_MS = 26 * HOUR_MS

#: Periodic jobs: name, period, priority (smaller runs first at the same instant).
JOBS = (("recluster", MINUTE_MS, 0), ("rank", 30_000, 1), ("brief", 5 * MINUTE_MS, 2))
SELECT_K_MS = 10 * MINUTE_MS

SUMMARY_CHARS = 300
NEAR_BITS = 3
NEAR_ITEMS = 5000

PRICE_MAX_AGE_MS = 30 * MINUTE_MS
RETURN_MAX_GAP_MS = 5 * MINUTE_MS
VOL_MIN_RETURNS = 10
LOOKBACK_MIN = 120
MAX_LAG = 5

WINDOW_MS = 6 * HOUR_MS
RECENT_MS = 30 * MINUTE_MS
HALF_LIFE_MS = HOUR_MS
WEIGHTS = {"velocity": 0.30, "credibility": 0.20, "recency": 0.20, "market": 0.20, "novelty": 0.10}
EMA_ALPHA = 0.5
NOVELTY_MS = 24 * HOUR_MS
TOP_STORIES = 20
SURFACED = 10
BROAD_SHARE = 0.5
BROAD_SOURCES = 6
COVERAGE = 0.3

K_MAX = 30
MIN_POINTS = 10
MATCH_COS = 0.8
MATCH_JACCARD = 0.2
OTHER_GENERATION_JACCARD = 0.3
FRESH_FIT_MARGIN = 0.03
OUTLIER_COS = {"hashing": 0.12, "neural": 0.30}
RETIRED_MS = 26 * HOUR_MS

BRIEF_TOP = 8
BRIEF_CHANGE = 0.3
BRIEF_MAX_AGE_MS = 30 * MINUTE_MS
BRIEF_ITEMS = 8
MMR_LAMBDA = 0.7
