"""DuckDB SQL computing, from the same parquet tables, what each registered
query must return.  Written independently of the Spark code: the views are
re-derived in SQL, parsed fields are derived from the values the lines were
rendered from, search hits are spelled as the word forms of the fixed
message vocabulary."""

from __future__ import annotations

from logloom.plans import params as P

_NS = ["web", "infra", "live", "trial", "meter"]
_LABELS = ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
_SHORT = ["UNK", "TRC", "DBG", "INF", "WRN", "ERR", "FTL"]
INGEST_NS = 1706745600000000000


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


LV = f"""lv AS (
  SELECT event_id + 1 AS id,
    epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns,
    ({_list(_NS)})[user_id % 5 + 1] AS namespace,
    event_type || '-' || CAST(user_id AS VARCHAR) AS pod,
    (['app', 'agent', 'edge'])[event_id % 3 + 1] AS container,
    CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
      WHEN 'error' THEN CASE WHEN value > 100 THEN 6 ELSE 5 END ELSE 0 END AS INTEGER) AS severity,
    CASE event_type
      WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'cache warmed after restart'
                            ELSE 'template built within ' || CAST(event_id % 300 AS VARCHAR) || 'ms' END
      WHEN 'click' THEN 'visitor opened the ' || (['basket', 'filter', 'profile'])[event_id % 3 + 1] || ' panel'
      WHEN 'purchase' THEN 'payment settled within ' || CAST(event_id % 500 AS VARCHAR) || 'ms'
      WHEN 'signup' THEN 'quota nearly spent by account ' || CAST(user_id AS VARCHAR)
      WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'cache write refused by shard' ELSE 'ledger lost its cache lease' END
      ELSE event_type END AS message,
    json_extract_string(props, '$.k') AS k,
    event_id, user_id, value
  FROM events)"""

ATTRS = "concat_ws(';', CASE WHEN k IS NOT NULL THEN 'k=' || k END, 'user_id=' || CAST(user_id AS VARCHAR))"
OUT_COLS = f"id, ts_ns, namespace, pod, container, severity, message, {ATTRS} AS attrs"
LABEL = f"({_list(_LABELS)})[severity + 1]"
VTEXT = ("CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) "
         "ELSE CAST(value AS VARCHAR) END")

# expected parse of the raw view: shape by event_id % 4 (JSON, logfmt, bracket, plain)
RAWX = f"""rawx AS (
  SELECT id AS arrival, namespace, pod, 'uid-' || CAST(user_id AS VARCHAR) AS pod_uid, container,
    CASE WHEN event_id % 97 = 96 THEN {INGEST_NS} ELSE ts_ns END AS ts_ns,
    CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE severity END AS INTEGER) AS severity,
    CASE WHEN event_id % 4 = 2 THEN '[' || CASE WHEN severity = 4 THEN 'WARNING' ELSE {LABEL} END || '] ' || message
         ELSE message END AS message,
    CASE event_id % 4
      WHEN 0 THEN 'k=' || k || ';level=' || CASE WHEN event_id % 8 = 4 THEN lower({LABEL}) ELSE {LABEL} END
                  || ';user_id=' || CAST(user_id AS VARCHAR) || ';value=' || {VTEXT}
      WHEN 1 THEN 'k=' || k || ';level=' || CASE WHEN severity = 6 THEN 'panic' ELSE lower({LABEL}) END
                  || ';user_id=' || CAST(user_id AS VARCHAR)
      ELSE '' END AS attrs,
    event_id, user_id, k, value, severity AS true_severity, message AS true_message
  FROM lv)"""

# the rendered raw lines
_PREFIX = ("strftime(make_timestamp((ts_ns // 1000000000 + CASE WHEN event_id % 6 = 5 THEN 7200 ELSE 0 END) * 1000000), "
           "'%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') || "
           "CASE WHEN event_id % 6 = 5 THEN '+02:00' ELSE 'Z' END")
_BODY = (f"CASE event_id % 4 WHEN 0 THEN '{{\"level\":\"' || CASE WHEN event_id % 8 = 4 THEN lower({LABEL}) ELSE {LABEL} END "
         f"|| '\",\"msg\":\"' || message || '\",\"user_id\":' || CAST(user_id AS VARCHAR) || ',\"k\":' || coalesce(k, 'null') "
         f"|| ',\"value\":' || CAST(value AS VARCHAR) || '}}' "
         f"WHEN 1 THEN 'level=' || CASE WHEN severity = 6 THEN 'panic' ELSE lower({LABEL}) END || ' msg=\"' || message "
         f"|| '\" user_id=' || CAST(user_id AS VARCHAR) || ' k=' || coalesce(k, '') "
         f"WHEN 2 THEN '[' || CASE WHEN severity = 4 THEN 'WARNING' ELSE {LABEL} END || '] ' || message "
         f"ELSE message END")
RAWLINES = f"""rawl AS (
  SELECT id AS arrival, namespace, pod, 'uid-' || CAST(user_id AS VARCHAR) AS pod_uid, container,
    CASE WHEN event_id % 97 = 96 THEN {_BODY} ELSE {_PREFIX} || ' ' || {_BODY} END AS line,
    CASE WHEN event_id % 97 = 96 THEN {_BODY} ELSE {_BODY} END AS body,
    CASE WHEN event_id % 97 = 96 THEN {INGEST_NS} ELSE ts_ns END AS ts_ns, event_id
  FROM lv)"""

DV = f"""dv AS (
  SELECT id, ts_ns, namespace, pod, container, severity, message, k, user_id FROM lv
  UNION ALL SELECT id + 10000000, ts_ns, namespace, pod, container, 0, message, k, user_id FROM lv WHERE (id - 1) % 10 = 0
  UNION ALL SELECT id + 20000000, ts_ns + 1, namespace, pod, container, severity, message, k, user_id FROM lv WHERE (id - 1) % 25 = 0)"""

SV = f"""sv AS (
  SELECT ({_list(_NS)})[user_id % 5 + 1] AS namespace, 'pod-' || CAST(user_id AS VARCHAR) AS pod,
    'uid-' || CAST(user_id AS VARCHAR) AS pod_uid, 'main' AS container, event_id AS seq,
    CASE WHEN event_type = 'signup' AND value > 200 THEN 'deleted' ELSE 'status' END AS kind,
    event_type <> 'error' AS running, CAST(floor(event_id / 5000) AS INTEGER) AS restart_count,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(event_id / 5000) AS BIGINT) AS VARCHAR) AS container_id,
    'node-' || CAST(user_id % 3 AS VARCHAR) AS node
  FROM events)"""

EV = """ev AS (
  SELECT namespace, pod, pod_uid, container, seq, restart_count,
    CASE WHEN kind = 'deleted' THEN 'STOP'
         WHEN running AND (pk IS NULL OR pk = 'deleted' OR NOT pr OR pc <> container_id) THEN 'START'
         WHEN NOT running AND NOT (pk IS NULL OR pk = 'deleted') AND pr THEN 'STOP' END AS event
  FROM (SELECT *, lag(kind) OVER w AS pk, lag(running) OVER w AS pr, lag(container_id) OVER w AS pc
        FROM sv WINDOW w AS (PARTITION BY namespace, pod, pod_uid, container ORDER BY seq)))"""


def _with(*ctes: str) -> str:  # noqa: D103
    return "WITH " + ",\n".join(ctes) + "\n"


def _filtered(where: str, tail: str = "") -> str:
    return _with(LV) + f"SELECT {OUT_COLS} FROM lv WHERE {where} {tail}"


def _hits(where: str) -> str:
    return _with(LV) + f"SELECT id, message FROM lv WHERE {where}"


def _word(w: str) -> str:
    return f"regexp_matches(message, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"


ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ sources
ORACLE["read_logs"] = _with(LV) + f"SELECT {OUT_COLS} FROM lv"
ORACLE["get_by_id"] = _filtered(f"id = {P.POINT_ID}")
ORACLE["read_raw_lines"] = _with(LV, RAWLINES) + (
    "SELECT namespace, split_part(pod, '-', 1) AS pod, 'u0' AS pod_uid, container, row_number() OVER "
    "(PARTITION BY namespace, split_part(pod, '-', 1), container ORDER BY arrival) AS nth, line FROM rawl")
ORACLE["split_oversize"] = (f"SELECT doc_id AS arrival, octet_length(encode(text)) <= {P.DOC_LINE_MAX_BYTES} AS accepted "
                            "FROM documents")
ORACLE["since"] = _with(LV, RAWX) + f"SELECT arrival, ts_ns, severity, message, attrs FROM rawx WHERE ts_ns >= {P.SINCE_NS}"
ORACLE["project_entry"] = _with(LV) + (
    "SELECT id, CAST(json_object('id', id, 'timestamp', ts_ns, 'namespace', namespace, 'pod', pod, "
    "'container', container, 'severity', severity, 'message', message, "
    "'attrs', json_object('k', k, 'user_id', CAST(user_id AS VARCHAR))) AS VARCHAR) AS json FROM lv")
ORACLE["collect_gate"] = _filtered("namespace <> 'infra'")
ORACLE["collect_gate_include"] = _filtered("namespace IN ('live', 'trial') AND namespace NOT IN ('infra', 'trial')")
ORACLE["read_structured"] = _with(LV, RAWX) + (
    f"SELECT 'structured' AS source, id AS arrival, ts_ns, severity, message, {ATTRS} AS attrs FROM lv "
    "UNION ALL SELECT 'parsed', arrival, ts_ns, severity, message, attrs FROM rawx")

# ------------------------------------------------------------------ parser
ORACLE["parse_lines"] = _with(LV, RAWX) + "SELECT arrival, ts_ns, severity, message, attrs FROM rawx"
ORACLE["split_timestamp"] = _with(LV, RAWLINES) + "SELECT arrival, ts_ns, body FROM rawl"
ORACLE["parse_json_attrs"] = _with(LV, RAWX) + (
    f"SELECT arrival, CASE WHEN event_id % 4 <> 0 THEN '' ELSE 'k=' || k || ';level=' || CASE WHEN event_id % 8 = 4 THEN lower({LABEL.replace('severity', 'true_severity')}) "
    f"ELSE {LABEL.replace('severity', 'true_severity')} END || ';msg=' || true_message || ';user_id=' || CAST(user_id AS VARCHAR) "
    f"|| ';value=' || {VTEXT} END AS attrs FROM rawx")
ORACLE["severity_from_fields"] = _with(LV, RAWX) + (
    "SELECT arrival, CAST(CASE WHEN event_id % 4 IN (0, 1) THEN true_severity ELSE 0 END AS INTEGER) AS severity FROM rawx")
_CAP = ";".join(f"f{i:02d}={i}" for i in range(1, 13))
ORACLE["normalize_attrs"] = _with(LV) + (
    f"SELECT id AS arrival, {INGEST_NS} AS ts_ns, severity, message, "
    f"'caller=main.go;' || CASE WHEN event_id % 50 = 0 THEN '{_CAP};' ELSE '' END || 'lvl=' || lower({LABEL}) "
    "|| ';request_id=r' || CAST(event_id AS VARCHAR) || ';service=shop;span_id=s' || k "
    "|| ';trace_id=t' || CAST(event_id AS VARCHAR) || ';user_id=' || CAST(user_id AS VARCHAR) AS attrs FROM lv")
ORACLE["parse_logfmt"] = _with(LV) + (
    f"SELECT id AS arrival, {INGEST_NS} AS ts_ns, severity, message || ' \"quoted\"' || chr(9) || 'end' AS message, "
    f"'flag=off;lvl=' || lower({LABEL}) || ';path=/api/items/' || k || ';trace_id=t' || CAST(event_id AS VARCHAR) AS attrs "
    "FROM lv")
ORACLE["severity_from_pattern"] = _with(LV) + (
    "SELECT id, CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE severity END AS INTEGER) AS severity FROM lv")
_WORD = (f"CASE WHEN severity = 4 AND event_id % 2 = 0 THEN 'WARNING' WHEN severity = 6 AND event_id % 2 = 0 THEN 'PANIC' "
         f"ELSE {LABEL} END")
ORACLE["severity_of"] = _with(LV) + (
    f"SELECT id, word, CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE severity END AS INTEGER) AS severity FROM "
    f"(SELECT *, CASE event_id % 3 WHEN 0 THEN {_WORD} WHEN 1 THEN lower({_WORD}) "
    f"ELSE substr({_WORD}, 1, 1) || lower(substr({_WORD}, 2)) END AS word FROM lv)")
ORACLE["severity_label"] = _with(LV) + (
    f"SELECT id, severity, {LABEL} AS label, ({_list(_SHORT)})[severity + 1] AS short_label FROM lv")
ORACLE["to_log_entry"] = _with(LV, RAWX) + (
    "SELECT arrival, ts_ns, severity, message, CASE WHEN attrs = '' THEN 'pod_uid=' || pod_uid "
    "ELSE replace(attrs, ';user_id=', ';pod_uid=' || pod_uid || ';user_id=') END AS attrs FROM rawx")
ORACLE["strip_ansi"] = _with(LV) + "SELECT id, message FROM lv"
ORACLE["format_ts"] = _with(LV) + "SELECT id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts_text FROM lv"
ORACLE["format_rfc3339"] = _with(LV) + (
    "SELECT id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') "
    "|| 'Z' AS ts_text FROM lv")
ORACLE["text_lines"] = (
    "WITH t AS (SELECT 'documents' AS kind, doc_id AS id, coalesce(text, '') AS body FROM documents "
    "UNION ALL SELECT 'pages', page_id, coalesce(html, '') FROM pages "
    "UNION ALL SELECT 'conversations', conv_id, coalesce(text, '') FROM conversations) "
    f"SELECT kind, id, ([2214172799500000000, 9223372036854775807, 946688400000000000, {INGEST_NS}, {INGEST_NS}])[id % 5 + 1] AS ts_ns, "
    "(['2040-02-29', '2262-04-11', '2000-01-01', '2024-02-01', '2024-02-01'])[id % 5 + 1] AS log_date, "
    f"md5(CASE WHEN id % 5 < 3 THEN body ELSE ({_list(P.LINE_TIMES)})[id % 5 + 1] || ' ' || body END) AS message_md5 FROM t")
_KEPT_BY = ["true", "true", "true", "true", "ts_ns >= 1705269600500000000", "true", "severity >= 5", "true", "id < 4000 AND id > 3000"]
ORACLE["query_params"] = _with(LV) + " UNION ALL ".join(
    f"SELECT {k} AS request, count(*) AS n FROM lv WHERE {w}" for k, w in enumerate(_KEPT_BY))
ORACLE["truncate_value"] = _with(LV) + (
    "SELECT id, CASE WHEN length(pod) > 12 THEN left(pod, 11) || '…' ELSE pod END AS pod_short FROM lv")



def _saved_sql(name: str, q) -> str:
    conds = [f"{f} = '{getattr(q, f)}'" for f in ("namespace", "pod", "container") if getattr(q, f)]
    conds += [f"severity >= {q.min_severity}"] * (q.min_severity > 0)
    conds += [f"ts_ns >= {q.start_ns} AND ts_ns < {q.end_ns}"] * (q.start_ns is not None)
    conds += [f"CAST(user_id AS VARCHAR) = '{v}'" for v in q.attributes.values()]
    conds += [f"id > {q.after_id}"] * (q.after_id is not None and q.after_id > 0)
    conds += [f"contains(message, '{w}')" for w in (q.search or "").split()]
    return f"SELECT '{name}' AS query, id FROM lv WHERE {' AND '.join(conds) or 'true'}"


ORACLE["saved_queries"] = _with(LV) + " UNION ALL ".join(_saved_sql(n, q) for n, q in P.SAVED.items())

# ------------------------------------------------------------------ filters
ORACLE["query_time_range"] = _filtered(f"ts_ns >= {P.RANGE_START_NS} AND ts_ns < {P.RANGE_END_NS}")
ORACLE["query_namespace"] = _filtered(f"namespace = '{P.NAMESPACE}'")
ORACLE["query_pod"] = _filtered(f"pod = '{P.POD}'")
ORACLE["query_container"] = _filtered(f"container = '{P.CONTAINER}'")
ORACLE["query_min_severity"] = _filtered(f"severity >= {P.MIN_SEVERITY}")
ORACLE["query_attributes"] = _filtered(f"CAST(user_id AS VARCHAR) = '{P.ATTR_USER}' AND k = '38'")
ORACLE["query_search"] = _filtered("message LIKE '%write refused%'")
ORACLE["query_combined"] = _filtered(
    f"namespace = '{P.NAMESPACE}' AND severity >= 5 AND {_word('ledger')} AND ts_ns >= {P.RANGE_START_NS}",
    f"ORDER BY id DESC LIMIT {P.PAGE_LIMIT}")
ORACLE["query_logs"] = _filtered(
    "namespace = 'trial' AND k = '38' AND ts_ns >= 1704412800000000000 AND ts_ns < 1706140800000000000",
    "ORDER BY id ASC LIMIT 100")
ORACLE["query_last_minutes"] = _filtered(
    f"ts_ns >= {P.NOW_NS - P.LAST_MINUTES * 60 * P.NS} AND ts_ns < {P.NOW_NS}")

# ------------------------------------------------------------------ full text
ORACLE["tokenize"] = (
    "SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
    "(SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t "
    "FROM documents)")
ORACLE["search_term"] = _hits(_word("cache"))
ORACLE["search_phrase"] = _hits("message LIKE '%write refused%'")
ORACLE["search_and"] = _hits(f"{_word('cache')} AND {_word('lease')}")
ORACLE["search_or"] = _hits(f"{_word('warmed')} OR {_word('refused')}")
ORACLE["search_not"] = _hits(f"{_word('within')} AND NOT {_word('payment')}")
ORACLE["search_prefix"] = _hits("regexp_matches(message, '(^|[^a-z0-9])sett')")
ORACLE["search_near"] = _hits("message LIKE '%ledger lost its cache%'")
ORACLE["search_all"] = _hits(f"{_word('payment')} AND {_word('settled')}")
ORACLE["search_initial"] = _hits("message LIKE 'ledger %'")
ORACLE["query_search_postings"] = _hits(
    f"(message LIKE '%write refused%' OR {_word('cache')} AND {_word('lease')}) AND ts_ns >= {P.CUTOFF_NS}")


def _near(n: int, *phrases: str) -> str:
    """Phrases within n tokens, over a token list t."""
    at = [f"list_filter(range(1, len(t) + 1), lambda i: t[i:i + {len(p.split()) - 1}] = {_list(p.split())})" for p in phrases]
    names = [f"x{k}" for k in range(len(phrases))]
    first = "least(" + ", ".join(f"x{k} * 100 + {len(p.split())}" for k, p in enumerate(phrases)) + ")"
    tables = ", ".join(f"(SELECT unnest({a}) AS x{k})" for k, a in enumerate(at))
    last = f"greatest({', '.join(names)})"
    return f"CAST(EXISTS (SELECT 1 FROM {tables} WHERE {last} - ({first} // 100 + {first} % 100) <= {n}) AS INTEGER)"


_JOINED = "' ' || array_to_string(t, ' ') || ' '"
ORACLE["search_documents"] = (
    "WITH d AS (SELECT doc_id + 1 AS id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), "
    "lambda x: x <> '') AS t FROM documents) SELECT id, "
    "CAST(list_contains(t, 'worthless') AS INTEGER) AS m_term, "
    f"CAST(contains({_JOINED}, ' of and ') AS INTEGER) AS m_phrase, "
    "CAST(list_contains(t, 'of') AND list_contains(t, 'and') AS INTEGER) AS m_and, "
    "CAST(list_contains(t, 'von') OR list_contains(t, 'que') AS INTEGER) AS m_or, "
    "CAST(list_contains(t, 'of') AND NOT list_contains(t, 'with') AS INTEGER) AS m_not, "
    f"CAST(contains({_JOINED}, ' von') AS INTEGER) AS m_prefix, "
    f"{_near(1, 'of', 'and')} AS m_near, {_near(4, 'of', 'and', 'is')} AS m_near3, {_near(6, 'of and', 'with')} AS m_near_phrase, "
    "CAST(coalesce(t[1] = 'of', false) AS INTEGER) AS m_initial, "
    "CAST(list_contains(t, 'von') AND list_contains(t, 'und') AS INTEGER) AS m_all, 0 AS m_no_token FROM d")

ORACLE["search_near_postings"] = f"SELECT id, m_near, m_near3, m_near_phrase FROM ({ORACLE['search_documents']})"

# ------------------------------------------------------------------ dedup, writes
ORACLE["dedup_key"] = _with(LV, DV) + (
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(DISTINCT (ts_ns, namespace, pod, container, message)) AS BIGINT) AS n_keys, "
    "CAST(count(DISTINCT (ts_ns, namespace, pod, container, message)) AS BIGINT) AS n_hashes FROM dv")
_DV_OUT = f"id, ts_ns, namespace, pod, container, severity, message, {ATTRS} AS attrs"
ORACLE["dedup_first"] = _with(LV, DV) + (
    f"SELECT {_DV_OUT} FROM dv QUALIFY row_number() OVER "
    "(PARTITION BY ts_ns, namespace, pod, container, message ORDER BY id) = 1")
ORACLE["repair_table"] = _with(LV, DV) + (
    f"SELECT {_DV_OUT}, true AS indexed, CAST(contains(message, 'shard') AS INTEGER) AS m_shard FROM dv QUALIFY row_number() OVER "
    "(PARTITION BY ts_ns, namespace, pod, container, message ORDER BY id) = 1")
ORACLE["backfill_key"] = _with(LV, DV) + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_with_key FROM dv"
ORACLE["dedup_existing"] = _with(LV, DV) + (
    f"SELECT {_DV_OUT} FROM dv WHERE id % 7 = 0 UNION ALL "
    f"SELECT {_DV_OUT} FROM dv WHERE id % 7 <> 0 QUALIFY row_number() OVER "
    "(PARTITION BY ts_ns, namespace, pod, container, message ORDER BY id) = 1")
_FRESH = """fresh AS (
  SELECT * FROM dv d
  WHERE NOT EXISTS (SELECT 1 FROM lv s WHERE s.id % 2 = 1 AND s.ts_ns = d.ts_ns AND s.namespace = d.namespace
                    AND s.pod = d.pod AND s.container = d.container AND s.message = d.message)
  QUALIFY row_number() OVER (PARTITION BY ts_ns, namespace, pod, container, message ORDER BY id) = 1)"""
_STORED = """stored AS (
  SELECT id, ts_ns, namespace, pod, container, severity, message, k, user_id FROM lv WHERE id % 2 = 1
  UNION ALL SELECT id, ts_ns, namespace, pod, container, severity, message, k, user_id FROM fresh)"""
ORACLE["append_new"] = _with(LV, DV, _FRESH, _STORED) + (
    f"SELECT ts_ns, namespace, pod, container, severity, message, {ATTRS} AS attrs, count(*) OVER () AS n_ids, "
    "(SELECT max(id) FROM lv WHERE id % 2 = 1) + (SELECT count(*) FROM fresh) AS last_id FROM stored")
ORACLE["assign_ids"] = _with(LV, DV, _FRESH) + (
    f"SELECT id AS arrival, {P.ASSIGN_START} + row_number() OVER (ORDER BY id) AS id FROM fresh")

# ------------------------------------------------------------------ retention
ORACLE["retention_keep"] = _filtered(f"ts_ns >= {P.CUTOFF_NS}")
ORACLE["retention_deleted"] = _with(LV) + (
    f"SELECT CAST(sum(CASE WHEN ts_ns < {P.CUTOFF_NS} THEN 1 ELSE 0 END) AS BIGINT) AS deleted, "
    f"CAST(sum(CASE WHEN ts_ns < {P.CUTOFF_NS} THEN 0 ELSE 1 END) AS BIGINT) AS kept FROM lv")
_LAST_CUT = P.RETENTION_RUNS[-1] - 86_400 * P.NS
ORACLE["retention_stats"] = _with(LV) + (
    f"SELECT CAST({len(P.RETENTION_RUNS)} AS BIGINT) AS runs, count_if(ts_ns < {_LAST_CUT})::BIGINT AS total_deleted, "
    f"{P.RETENTION_RUNS[-1]} AS last_run_ns, CAST(NULL AS VARCHAR) AS last_error, count_if(ts_ns >= {_LAST_CUT})::BIGINT AS n_left "
    "FROM lv")

# ------------------------------------------------------------------ aggregates
ORACLE["stats"] = _with(LV) + "SELECT CAST(count(*) AS BIGINT) AS total, min(ts_ns) AS oldest_ns, max(ts_ns) AS newest_ns FROM lv"
ORACLE["stored_stats"] = _with(LV) + (
    "SELECT CAST(count(*) AS BIGINT) AS total, min(ts_ns) AS oldest_ns, max(ts_ns) AS newest_ns, "
    "array_to_string(list_sort(list(DISTINCT namespace)), ',') AS namespaces, "
    f"array_to_string(list_sort(list(DISTINCT container)), ',') AS containers FROM lv WHERE ts_ns >= {P.CUTOFF_NS}")
ORACLE["stored_search_page"] = _filtered(
    f"namespace = '{P.NAMESPACE}' AND contains(message, 'ledger') AND contains(message, 'cache')", "ORDER BY id DESC LIMIT 100")
ORACLE["list_namespaces"] = _with(LV) + "SELECT DISTINCT namespace FROM lv ORDER BY namespace"
ORACLE["list_containers"] = _with(LV) + "SELECT DISTINCT container FROM lv ORDER BY container"
ORACLE["container_stats"] = _with(LV, RAWX) + (
    f"SELECT namespace, pod, pod_uid, container, CAST(count(*) AS BIGINT) AS lines, count_if(ts_ns <> {INGEST_NS})::BIGINT AS with_time, "
    "count_if(severity >= 5)::BIGINT AS errors, max(ts_ns) AS last_ts_ns FROM rawx GROUP BY namespace, pod, pod_uid, container")
ORACLE["ingest_stats"] = _with(LV, RAWX) + (
    f"SELECT CAST(count(*) AS BIGINT) AS lines_read, count_if(ts_ns <> {INGEST_NS})::BIGINT AS with_time, "
    "count_if(attrs <> '')::BIGINT AS structured, count_if(severity >= 5)::BIGINT AS errors, "
    "count(DISTINCT (ts_ns, namespace, pod, container, message))::BIGINT AS entries, max(ts_ns) AS last_ts_ns FROM rawx")
ORACLE["page_info"] = _with(LV) + (
    f"SELECT CAST(least(count(*), {P.PAGE_LIMIT}) AS BIGINT) AS n_rows, count(*) > {P.PAGE_LIMIT} AS has_more, "
    f"CASE WHEN count(*) > {P.PAGE_LIMIT} THEN min(id) END AS next_cursor, "
    f"max(CASE WHEN rn = least((SELECT count(*) FROM lv WHERE namespace = '{P.NAMESPACE}'), {P.PAGE_LIMIT}) THEN id END) AS resume_id, "
    "CAST(-1 AS BIGINT) AS total_estimate FROM "
    f"(SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM lv WHERE namespace = '{P.NAMESPACE}' "
    f"ORDER BY id DESC LIMIT {P.PAGE_LIMIT + 1})")

# ------------------------------------------------------------------ paging
ORACLE["query_desc"] = _filtered(f"namespace = '{P.NAMESPACE}'", "ORDER BY id DESC LIMIT 100")
ORACLE["query_asc"] = _filtered(f"namespace = '{P.NAMESPACE}'", "ORDER BY id ASC LIMIT 100")
ORACLE["page"] = _filtered("severity >= 5", f"ORDER BY id DESC LIMIT {P.PAGE_LIMIT}")
ORACLE["page_after"] = _filtered(f"id > {P.CURSOR_ID}", "ORDER BY id ASC LIMIT 50")
ORACLE["page_before"] = _filtered(f"id < {P.CURSOR_ID}", "ORDER BY id DESC LIMIT 50")
ORACLE["tail_initial"] = _filtered("severity >= 5", "ORDER BY id DESC LIMIT 50")
ORACLE["entry_neighbours"] = _with(LV) + (
    "SELECT id, coalesce(lag(id) OVER (ORDER BY id DESC), id) AS prev_id, "
    "coalesce(lead(id) OVER (ORDER BY id DESC), id) AS next_id FROM "
    f"(SELECT id FROM lv WHERE namespace = '{P.NAMESPACE}' ORDER BY id DESC LIMIT 100)")

# ------------------------------------------------------------------ lifecycle
ORACLE["container_events"] = _with(SV, EV) + (
    "SELECT namespace, pod, pod_uid, container, seq, event FROM ev WHERE event IS NOT NULL")
ORACLE["container_events_node"] = _with(SV, EV.replace("FROM sv WINDOW", f"FROM sv WHERE node = '{P.NODE}' WINDOW")) + (
    "SELECT namespace, pod, pod_uid, container, seq, event FROM ev WHERE event IS NOT NULL")
ORACLE["container_restarts"] = _with(SV, EV) + (
    "SELECT namespace, pod, pod_uid, container, max(restart_count) AS max_restart_count, "
    "CAST(greatest(coalesce(sum(CASE WHEN event = 'START' THEN 1 ELSE 0 END), 0) - 1, 0) AS BIGINT) AS restarts "
    "FROM ev GROUP BY ALL")
ORACLE["active_containers"] = _with(SV, EV) + (
    "SELECT namespace, pod, pod_uid, container FROM ev WHERE event IS NOT NULL GROUP BY ALL "
    "HAVING arg_max(event, seq) = 'START'")
ORACLE["idle_containers"] = _with(LV) + (
    "SELECT namespace, pod, container, max(ts_ns) AS last_ts_ns FROM lv GROUP BY ALL "
    f"HAVING max(ts_ns) < {P.IDLE_NOW_NS - P.IDLE_TIMEOUT_NS}")
ORACLE["resume_cursors"] = _with(LV) + "SELECT namespace, pod, container, max(ts_ns) + 1 AS resume_ns FROM lv GROUP BY ALL"

# ------------------------------------------------------------------ streaming
ORACLE["tail_stream"] = _filtered("severity >= 5")
ORACLE["tail_resume"] = _filtered(f"id > {P.CURSOR_ID}", "ORDER BY id ASC LIMIT 100")
ORACLE["tail_dedup"] = _with(LV) + f"SELECT {OUT_COLS} FROM lv"
ORACLE["tail_window"] = _filtered("true", "ORDER BY id DESC LIMIT 1000")
ORACLE["ingest_stream"] = _with(LV, RAWX) + (
    "SELECT ts_ns, namespace, pod, container, severity, message, "
    "CASE WHEN attrs = '' THEN 'pod_uid=' || pod_uid "
    "ELSE replace(attrs, ';user_id=', ';pod_uid=' || pod_uid || ';user_id=') END AS attrs FROM "
    "(SELECT * FROM (SELECT * FROM rawx UNION ALL SELECT arrival + 10000000, namespace, pod, pod_uid, container, ts_ns, "
    "severity, message, attrs, event_id, user_id, k, value, true_severity, true_message FROM rawx WHERE (arrival - 1) % 10 = 0) "
    "QUALIFY row_number() OVER (PARTITION BY ts_ns, namespace, pod, container, message ORDER BY arrival) = 1)")
ORACLE["ingest_stream"] = f"SELECT *, count(*) OVER () AS n_ids, count(*) OVER () AS last_id FROM ({ORACLE['ingest_stream']})"
RAW_BYTES = ("SELECT CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM "
             "(SELECT line FROM rawl UNION ALL SELECT line FROM rawl WHERE (arrival - 1) % 10 = 0)")
ORACLE["ingest_counters"] = _with(LV, RAWX, RAWLINES) + (
    ", delivered AS (SELECT *, event_id % 97 <> 96 AS own FROM rawx UNION ALL "
    "SELECT *, event_id % 97 <> 96 FROM rawx WHERE (arrival - 1) % 10 = 0), "
    f"lines AS ({RAW_BYTES}) "
    "SELECT CAST(count(*) AS BIGINT) AS lines, (SELECT bytes FROM lines) AS bytes, 0::BIGINT AS gated, 0::BIGINT AS rejected, "
    "CAST(count(*) AS BIGINT) AS entries, count_if(own)::BIGINT AS with_time, CAST(count(*) AS BIGINT) AS with_attributes, "
    "count_if(severity >= 5)::BIGINT AS errors, max(ts_ns) AS last_ts_ns, "
    "count(DISTINCT (ts_ns, namespace, pod, container, message))::BIGINT AS inserted, "
    "(count(*) - count(DISTINCT (ts_ns, namespace, pod, container, message)))::BIGINT AS repeated FROM delivered")
_AS_TEXT = "arrival % 2 = 0 AND arrival % 97 <> 0"
ORACLE["ingest_text_and_structured"] = _with(LV, RAWX) + (
    f", t AS (SELECT * REPLACE (CASE WHEN {_AS_TEXT} THEN event_type ELSE pod END AS pod, "
    f"CASE WHEN {_AS_TEXT} THEN 'u0' ELSE pod_uid END AS pod_uid) FROM "
    "(SELECT *, split_part(pod, '-', 1) AS event_type FROM rawx)), e AS (SELECT ts_ns, namespace, pod, container, severity, message, "
    "CASE WHEN attrs = '' THEN 'pod_uid=' || pod_uid "
    "ELSE replace(attrs, ';user_id=', ';pod_uid=' || pod_uid || ';user_id=') END AS attrs FROM t "
    "QUALIFY row_number() OVER (PARTITION BY ts_ns, namespace, pod, container, message ORDER BY arrival) = 1) "
    "SELECT *, count(*) OVER () AS n_ids, count(*) OVER () AS last_id FROM e")
ORACLE["stream_dedup"] = _with(LV, DV) + "SELECT DISTINCT ts_ns, namespace, pod, container, message FROM dv"
ORACLE["container_events_stream"] = ORACLE["container_events"]

# Porter stems of the words of the log-message templates
# (numbers stay, a trailing "ms" loses its "s").
TEMPLATE_STEMS = [
    ("cache", "cach"), ("warmed", "warm"), ("after", "after"), ("restart", "restart"), ("template", "templat"),
    ("built", "built"), ("within", "within"), ("visitor", "visitor"), ("opened", "open"), ("the", "the"),
    ("basket", "basket"), ("filter", "filter"), ("profile", "profil"), ("panel", "panel"), ("payment", "payment"),
    ("settled", "settl"), ("quota", "quota"), ("nearly", "nearli"), ("spent", "spent"), ("by", "by"),
    ("account", "account"), ("write", "write"), ("refused", "refus"), ("shard", "shard"), ("ledger", "ledger"),
    ("lost", "lost"), ("its", "it"), ("lease", "leas"),
]
_STEMS = ", ".join(f"('{w}', '{s}')" for w, s in TEMPLATE_STEMS)
ORACLE["build_postings"] = _with(LV) + (
    f", stems(word, stem) AS (VALUES {_STEMS}), "
    "toks AS (SELECT id, unnest(regexp_split_to_array(lower(message), '[^a-z0-9]+')) AS tok, "
    "unnest(range(0, len(regexp_split_to_array(lower(message), '[^a-z0-9]+')))) AS pos FROM lv) "
    "SELECT coalesce(s.stem, CASE WHEN regexp_matches(tok, '^[0-9]+ms$') THEN left(tok, length(tok) - 1) ELSE tok END) "
    "AS term, id, pos FROM toks LEFT JOIN stems s ON s.word = toks.tok")
ORACLE["message_vocabulary"] = (f"SELECT token, any_value(stem) AS stem, CAST(count(*) AS BIGINT) AS n FROM (SELECT p.term AS stem, t.tok AS token FROM "
                                f"({ORACLE['build_postings']}) p JOIN (" + _with(LV) + "SELECT id, unnest(regexp_split_to_array(lower(message), "
                                "'[^a-z0-9]+')) AS tok, unnest(range(0, len(regexp_split_to_array(lower(message), '[^a-z0-9]+')))) AS pos FROM lv) t "
                                "USING (id, pos)) GROUP BY token")
ORACLE["idle_containers_stream"] = ORACLE["idle_containers"]
ORACLE["idle_events_stream"] = _with(LV) + (
    "SELECT namespace, pod, container, ts_ns AS last_ts_ns, ts_ns + " + str(P.IDLE_GAP_NS) + " AS idle_ns FROM ("
    "SELECT *, lead(ts_ns) OVER (PARTITION BY namespace, pod, container ORDER BY ts_ns) AS nxt, "
    "max(ts_ns) OVER () // 1000000 - " + str(P.IDLE_JITTER_NS // 1_000_000) + " AS mark "
    "FROM (SELECT DISTINCT namespace, pod, container, ts_ns FROM lv)) "
    f"WHERE (nxt IS NULL OR nxt - ts_ns > {P.IDLE_GAP_NS}) AND (ts_ns + {P.IDLE_GAP_NS} + 999999) // 1000000 < mark")
