"""Fixed values of the workload.

These must equal the original analysis for the results to be the same:
labels, thresholds, calendar names, sampling rates and model options.  They
are stated once, here, in the order the work uses them (reports, features,
models); the modules import them from here.
"""

# --- reports ---------------------------------------------------------------
UNKNOWN = "Unknown"                 # label of a missing OS / device category / browser
MIN_CONVERSION_PCT = 1.0            # conversion reports keep groups above this percent
MIN_SESSIONS = 100                  # country and browser reports keep groups above this
TOP_COUNTRIES = 10                  # length of the bounce-rate country ranking
CAMPAIGN_NOT_SET = "(not set)"      # an undefined campaign
REVENUE_UNIT = 1_000_000            # revenue is stored as money x 10^6

# --- calendar and derived features ---------------------------------------
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKEND = ["Saturday", "Sunday"]
EVENING_FIRST_HOUR, EVENING_LAST_HOUR = 18, 23
# time-of-day buckets (first hour, last hour, name); other hours are "evening"
TIME_OF_DAY = [(0, 5, "night"), (6, 11, "morning"), (12, 17, "afternoon")]
TIME_OF_DAY_ELSE = "evening"
# time-on-site categories: 0 (or missing) is "no_time", then (upper bound
# exclusive, name), and "long" beyond the last bound
TIME_ON_SITE_ZERO = "no_time"
TIME_ON_SITE = [(60, "very_short"), (180, "short"), (600, "medium")]
TIME_ON_SITE_ELSE = "long"
MISSING_CATEGORY = ""               # default of a missing category in the feature sets
ORGANIC = "organic"                 # the medium counted as organic traffic
SAMPLE_EXTENDED = 0.1               # kept share of sessions without a transaction, set B
SAMPLE_ENRICHED = 0.05              # the same for sets C and D
SAMPLE_HISTORY = 0.05

# --- models ------------------------------------------------------------------
EVAL_FRACTION = 0.2                 # random evaluation part of the training period
THRESHOLD = 0.5                     # probability from which label 1 is predicted
LOGISTIC_MAX_ITER = 20              # default logistic model
EXTENDED_MAX_ITER = 50              # tuned logistic model
EXTENDED_L1 = 0.05
EXTENDED_L2 = 0.1
FOREST_TREES = 60
FOREST_DEPTH = 10
FOREST_SUBSAMPLE = 0.85
FOREST_MIN_SPLIT_GAIN = 0.0
FOREST_L1 = 0.05
FOREST_L2 = 0.1
FOREST_MIN_REL_PROGRESS = 0.001     # least relative fall of the held-out loss, enriched forest
FOREST_DEFAULT_REL_PROGRESS = 0.01  # the trainer's default, history forest
LINE_SEARCH_START = 0.01            # first step of the tuned logistic model's line search
