"""Parameters shared by the registered queries and their oracle SQL."""

NS = 1_000_000_000
POINT_ID = 4242
SINCE_NS = 1705276800 * NS            # 2024-01-15T00:00:00Z
RANGE_START_NS = 1704844800 * NS      # 2024-01-10T00:00:00Z
RANGE_END_NS = 1705017600 * NS        # 2024-01-12T00:00:00Z
NOW_NS = 1705708800 * NS              # 2024-01-20T00:00:00Z
LAST_MINUTES = 1440
CUTOFF_NS = 1705320000 * NS           # 2024-01-15T12:00:00Z
IDLE_NOW_NS = 1706659200 * NS         # 2024-01-31T00:00:00Z
IDLE_TIMEOUT_NS = 86_400 * NS         # one day
IDLE_GAP_NS = 2 * 86_400 * NS
IDLE_JITTER_NS = 3600 * NS
NAMESPACE = "live"
POD = "error-42"
CONTAINER = "agent"
MIN_SEVERITY = 4
ATTR_USER = "42"
PAGE_LIMIT = 25
CURSOR_ID = 5000
DOC_LINE_MAX_BYTES = 16384
NEAR_DISTANCE = 2
ASSIGN_START = 30_000_000          # highest stored id before the batch
NODE = "node-1"
# line prefixes: the last two do not fit a BIGINT of nanoseconds
LINE_TIMES = ["2040-02-29T23:59:59.5Z", "2262-04-11T23:47:16.854775807Z", "1999-12-31T22:00:00-03:00",
              "9999-12-31T23:59:59Z", "2262-04-12T00:00:00Z"]
REQUESTS = [{"limit": "--5"}, {"minSeverity": "\u00b2"}, {"beforeId": "-5"}, {"afterId": "9223372036854775808"},
            {"startTime": "2024-01-15T00:00:00.5+02:00"}, {"startTime": "2024-W03-1T00:00:00Z"}, {"minSeverity": "+5"},
            {"endTime": "2024-01-15T00:00:00"}, {"beforeId": "4000", "afterId": "3000"}]
# times of retention jobs: cutoffs are a day before
RETENTION_RUNS = [CUTOFF_NS + 86_400 * NS, CUTOFF_NS + 86_400 * NS, CUTOFF_NS + 9 * 86_400 * NS]


def _saved() -> dict:
    """Fifty queries over every combination of fields, a third with full text."""
    from logloom.operators.query import LogQuery

    spaces, pods, boxes = ["web", "infra", "live", "trial", "meter"], ["view", "click", "purchase", "signup", "error"], ["app", "agent", "edge"]
    words = ["shard", "cache refused", "payment"]
    out = {}
    for k in range(50):
        kw = {}
        if k % 2:
            kw["namespace"] = spaces[k % 5]
        if k % 3 == 0:
            kw["pod"] = f"{pods[k % 5]}-{k}"
        if k % 5 < 2:
            kw["container"] = boxes[k % 3]
        if k % 4 == 0:
            kw["min_severity"] = 3 + k % 3
        if k % 7 == 0:
            kw |= {"start_ns": RANGE_START_NS, "end_ns": RANGE_END_NS + k * NS}
        if k % 11 == 0:
            kw["attributes"] = {"user_id": str(k + 1)}
        if k % 13 == 0:
            kw["after_id"] = 100 * k
        if k % 3 == 1:
            kw["search"] = words[k % 9 // 3]
        out[f"q{k:02d}"] = LogQuery(**kw)
    return out


SAVED = _saved()
