"""Values that must equal the source model's for equal results.

Everything here is data, not logic: names, thresholds, formats and patterns that
the source pipeline and its reports use, stated once so every operator reads the
same value.
"""

# ---- fixed values (must equal the source model's) --------------------------------

# benchmark results
EXEC_METRIC = "execution_time_seconds"
GEOMEAN_FLOOR = 1e-6
RUN_DATE_FORMAT = "yyyy-MM-dd HH:mm"
SF_LABEL_PREFIX = "sf"
SERIES_SF_SEPARATOR = " @ sf"
NO_SF_LABEL = "n/a"
NO_CPU_ARCH_LABEL = "unknown"
NO_MACHINE_LABEL = "unspecified"

# benchmark reports
PINNED_VERSIONS = ("v1.5.5", "v1.4.5")
RATIO_HIGH = 1.1
RATIO_LOW = 0.9
CHART_HEADROOM = 1.08
RUN_LABEL_SEPARATOR = "  -  "
SHORT_ID_CHARS = 8

# CI reports and feed
JOB_NAME_WIDTH = 60
REPO_NAME_PATTERN = r"\A[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z"
STALE_HOURS = 48
JOB_CUTOFF_DAYS = 10
BUDGET_SHARE = 0.80
MAIN_REPO_SHARE = 0.10

# extension downloads
STATS_DIR = "download-stats-weekly"
LAST_UPDATE_KEY = "_last_update"
WEEK_FIRST, WEEK_LAST = 1, 53
WEEKS_OFFERED = 52
PERIOD_LABEL_FORMAT = "%d-W%02d"
