"""Counters, rates, verdicts, reports and access decisions over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_packet_with_meta
from clearwake.operators.access import GATEWAY_ROUTES, access_audit, role_sufficient, with_roles
from clearwake.operators.dlq import parse_dlq, replay
from clearwake.operators.sanitize import classify_raw
from clearwake.operators.telemetry import (
    Objective,
    brain_outcomes,
    burn_rate,
    canary_verdict,
    collector_outcomes,
    counter_increase,
    error_ratio,
    exposition,
    load_gate,
    outcome_ratio,
    rolling_rate,
    sanitizer_outcomes,
    service_status,
    slo_report,
    stage_counters,
    up_latest,
)
from clearwake.plans.inputs import (
    CLASSIFIED,
    PACKETS,
    REQUESTS,
    SAMPLES,
    conversation_packets,
    event_outcomes,
    event_requests,
    event_samples,
    raw_envelopes,
)
from clearwake.plans.registry import query, table
from clearwake.plans.text_plans import PAGE_MIN_BYTES

DAY = 86_400


def stamp_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def sql_stamp(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


# -- counters ------------------------------------------------------------------------------------


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    fetches = table(spark, sf_dir, "pages").select(
        ((n % 17) == 0).alias("fetch_failed"), ((n % 17 != 0) & (n % 19 == 0)).alias("push_failed")
    )
    sanitizer = sanitizer_outcomes(classify_raw(raw_envelopes(spark, sf_dir), PAGE_MIN_BYTES))
    brain = brain_outcomes(parse_packet_with_meta(conversation_packets(spark, sf_dir)))
    return stage_counters(collector_outcomes(fetches).unionByName(sanitizer).unionByName(brain))


_COUNTERS = f"""{CLASSIFIED}, {PACKETS},
counters AS (
  SELECT 'collector' AS stage, unnest([
    {{'metric': 'collector_pages_visited_total', 'value': count(*) FILTER (page_id % 17 <> 0)}},
    {{'metric': 'collector_queue_push_errors_total', 'value': count(*) FILTER (page_id % 17 <> 0 AND page_id % 19 = 0)}},
    {{'metric': 'collector_crawl_errors_total', 'value': count(*) FILTER (page_id % 17 = 0)}},
    {{'metric': 'collector_dlq_push_total', 'value': count(*) FILTER (page_id % 17 <> 0 AND page_id % 19 = 0)}}], recursive := true) FROM pages
  UNION ALL SELECT 'sanitizer', unnest([
    {{'metric': 'sanitizer_processed_total', 'value': count(*) FILTER (outcome = 'ok')}},
    {{'metric': 'sanitizer_dropped_total', 'value': count(*) FILTER (outcome <> 'ok')}},
    {{'metric': 'sanitizer_errors_total', 'value': 0}},
    {{'metric': 'sanitizer_parse_fallbacks_total', 'value': count(*) FILTER (parse_fallback)}}], recursive := true) FROM classified
  UNION ALL SELECT 'brain', unnest([
    {{'metric': 'brain_processed_total', 'value': count(*) FILTER (quarantine IS NULL)}},
    {{'metric': 'brain_index_failures_total', 'value': count(*) FILTER (quarantine IS NOT NULL)}},
    {{'metric': 'brain_packet_parse_fallbacks_total', 'value': count(*) FILTER (fallback)}},
    {{'metric': 'brain_dlq_push_total', 'value': count(*) FILTER (quarantine IS NOT NULL)}}], recursive := true) FROM parsed_packets)"""


@query("stage_counters", f"WITH {_COUNTERS} SELECT stage, metric, value FROM counters")
def stage_counters_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir)


@query(
    "metrics_exposition",
    f"""WITH {_COUNTERS} SELECT metric, metric || ' ' || CAST(value AS VARCHAR) AS line FROM counters
UNION ALL SELECT 'collector_max_pages', 'collector_max_pages 300'""",
)
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposition(counters(spark, sf_dir), max_pages=300)


# -- rates and verdicts --------------------------------------------------------------------------


@query("metric_samples", f"WITH {SAMPLES} SELECT job, metric, count(*) AS samples, sum(value) AS total, max(value) AS top FROM samples GROUP BY ALL")
def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).groupBy("job", "metric").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.max("value").alias("top")
    )


@query(
    "counter_rate",
    f"WITH {SAMPLES} SELECT job, metric, {sql_stamp('window_start', 'window_start')}, samples, increase, round(increase / 3600, 9) AS rate FROM rates",
)
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = counter_increase(event_samples(spark, sf_dir), 3600)
    return rates.select("job", "metric", stamp_text("window_start"), "samples", "increase", F.round("rate", 9).alias("rate"))


@query(
    "error_ratio",
    f"""WITH {SAMPLES}, sides AS (
  SELECT job, window_start, sum(increase) FILTER (metric = 'brain_index_failures_total') AS failed,
         sum(increase) FILTER (metric = 'brain_processed_total') AS done FROM rates GROUP BY ALL)
SELECT job, {sql_stamp('window_start', 'ts')},
       round(CASE WHEN failed IS NULL OR done IS NULL OR done <= 0 THEN 0 ELSE failed / done END, 9) AS ratio FROM sides""",
)
def error_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_ratio(event_samples(spark, sf_dir), 3600).select("job", stamp_text("ts"), F.round("ratio", 9).alias("ratio"))


# the counters are read once a minute: windows of an hour every quarter of it have as many reads as those of a minute at 15 s
_ROLLING = f"""{SAMPLES},
windows AS (
  SELECT job, metric, s.ts AS read_at, value, time_bucket(INTERVAL '15 minutes', s.ts) + k * INTERVAL '15 minutes' AS ts
  FROM samples s, unnest([1, 2, 3, 4]) AS t(k)),
moves AS (SELECT *, lag(value) OVER (PARTITION BY job, metric, ts ORDER BY read_at, value) AS previous FROM windows),
rolling AS (
  SELECT job, metric, ts, count(*) AS samples,
         sum(CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END) AS increase
  FROM moves GROUP BY ALL)"""


@query(
    "rolling_rate",
    f"""WITH {_ROLLING} SELECT job, metric, {sql_stamp('ts', 'ts')}, samples, increase,
CASE WHEN samples > 1 THEN round(increase / 3600, 9) END AS rate FROM rolling""",
)
def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = rolling_rate(event_samples(spark, sf_dir), 3600, 900)
    return rates.select("job", "metric", stamp_text("ts"), "samples", "increase", F.round("rate", 9).alias("rate"))


@query(
    "rolling_canary",
    f"""WITH {_ROLLING}, sides AS (
  SELECT job, ts, sum(increase) FILTER (metric = 'brain_index_failures_total' AND samples > 1) AS failed,
         sum(increase) FILTER (metric = 'brain_processed_total' AND samples > 1) AS done FROM rolling GROUP BY ALL),
ratios AS (
  SELECT job || '/' || strftime(ts, '%Y-%m-%d') AS deployment, ts,
         CASE WHEN failed IS NULL OR done IS NULL OR done <= 0 THEN 0 ELSE failed / done END AS ratio FROM sides),
first_hours AS (
  SELECT * FROM (SELECT *, min(ts) OVER (PARTITION BY deployment) AS start FROM ratios) WHERE ts < start + INTERVAL '4 hours'),
spikes AS (SELECT *, min(CASE WHEN ratio > 0.3 * 3 THEN ts END) OVER (PARTITION BY deployment) AS spike_at FROM first_hours)
SELECT deployment, count(*) AS samples, round(avg(ratio), 9) AS mean_ratio,
       CASE WHEN any_value(spike_at) IS NOT NULL THEN 'ROLLBACK_SPIKE' WHEN avg(ratio) > 0.3 THEN 'ROLLBACK_AVG' ELSE 'PROMOTE' END AS verdict
FROM spikes WHERE spike_at IS NULL OR ts <= spike_at GROUP BY deployment""",
)
def rolling_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canary for each job and day, from overlapping ratios over its first four hours."""
    ratios = error_ratio(event_samples(spark, sf_dir), 3600, step_s=900)
    daily = ratios.withColumn("deployment", F.concat_ws("/", "job", F.date_format("ts", "yyyy-MM-dd")))
    verdicts = canary_verdict(daily, threshold=0.3, duration_s=4 * 3600)
    return verdicts.select("deployment", "samples", F.round("mean_ratio", 9).alias("mean_ratio"), "verdict")


_RATIOS = """
ratios AS (
  SELECT user_id % 50 AS deployment, time_bucket(INTERVAL '1 day', ts) AS ts,
         CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 0
              ELSE count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type <> 'error') END AS ratio
  FROM events GROUP BY ALL)"""


@query(
    "canary_verdict",
    f"""WITH {_RATIOS}, spikes AS (
  SELECT deployment, min(ts) AS spike_at FROM ratios WHERE ts >= TIMESTAMP '2024-01-08' AND ratio > 0.25 * 3 GROUP BY deployment),
seen AS (
  SELECT r.deployment, r.ts, r.ratio, s.spike_at FROM ratios r LEFT JOIN spikes s USING (deployment)
  WHERE r.ts < TIMESTAMP '2024-01-08' OR s.spike_at IS NULL OR r.ts <= s.spike_at)
SELECT deployment, count(*) FILTER (ts >= TIMESTAMP '2024-01-08') AS samples,
       round(coalesce(avg(ratio) FILTER (ts >= TIMESTAMP '2024-01-08'), 0), 9) AS mean_ratio,
       round(coalesce(arg_max(ratio, ts) FILTER (ts < TIMESTAMP '2024-01-08'), 0), 9) AS baseline_ratio,
       CASE WHEN deployment % 10 = 9 THEN 'ROLLBACK_UNHEALTHY' WHEN any_value(spike_at) IS NOT NULL THEN 'ROLLBACK_SPIKE'
            WHEN coalesce(avg(ratio) FILTER (ts >= TIMESTAMP '2024-01-08'), 0) > 0.25 THEN 'ROLLBACK_AVG' ELSE 'PROMOTE' END AS verdict
FROM seen GROUP BY deployment""",
)
def canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = outcome_ratio(event_outcomes(spark, sf_dir), DAY)
    verdicts = canary_verdict(
        ratios,
        threshold=0.25,
        healthy=F.col("deployment") % 10 != 9,
        baseline=F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"),
    )
    return verdicts.select(
        "deployment",
        "samples",
        F.round("mean_ratio", 9).alias("mean_ratio"),
        F.round("baseline_ratio", 9).alias("baseline_ratio"),
        "verdict",
    )


@query(
    "burn_rate",
    f"""WITH {REQUESTS}, daily AS (
  SELECT service, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS requests, avg(CAST(failed AS INT)) AS failed_rate
  FROM requests GROUP BY ALL)
SELECT service, {sql_stamp('window_start', 'window_start')}, requests, round(failed_rate, 9) AS failed_rate,
       round(failed_rate / (1 - 0.9::DOUBLE), 6) AS burn_rate,
       CASE WHEN failed_rate / (1 - 0.9::DOUBLE) > 2.0 THEN 'fail' ELSE 'pass' END AS verdict FROM daily""",
)
def burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = burn_rate(event_requests(spark, sf_dir), DAY, slo=0.9)
    return rated.select(
        "service",
        stamp_text("window_start"),
        "requests",
        F.round("failed_rate", 9).alias("failed_rate"),
        F.round("burn_rate", 6).alias("burn_rate"),
        "verdict",
    )


@query(
    "load_gate",
    f"""WITH {REQUESTS}, gate AS (
  SELECT service, count(*) AS n, avg(CAST(failed AS INT)) AS failed_rate, quantile_cont(latency_ms, 0.95) AS p95_ms,
         sum(checks_passed) / (2 * count(*)) AS checks_rate FROM requests GROUP BY service)
SELECT service, n, round(failed_rate, 9) AS failed_rate, round(p95_ms, 6) AS p95_ms, round(checks_rate, 9) AS checks_rate,
       failed_rate < 0.01 AS failed_ok, p95_ms < 500 AS p95_ok, checks_rate > 0.99 AS checks_ok,
       failed_rate < 0.01 AND p95_ms < 500 AND checks_rate > 0.99 AS passed FROM gate""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load_gate(event_requests(spark, sf_dir))
    digits = {"failed_rate": 9, "p95_ms": 6, "checks_rate": 9}
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


_SLO_OBJECTIVES = {"pipeline": Objective(0.7, 40.0), "dashboard": Objective(0.9995, 0.350)}


@query(
    "slo_report",
    f"""WITH outcomes AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'pipeline' ELSE 'dashboard' END AS service, l_shipdate AS ts,
         l_returnflag <> 'R' AS ok, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE l_discount * 4 END AS latency_s,
         CASE WHEN l_linestatus = 'O' THEN 0.7::DOUBLE ELSE 0.9995::DOUBLE END AS objective,
         CASE WHEN l_linestatus = 'O' THEN 40.0 ELSE 0.350 END AS p95_limit_s FROM lineitem),
sums AS (
  SELECT service, date_trunc('month', ts) AS month, objective, p95_limit_s, count(*) AS requests,
         count(*) FILTER (NOT ok) AS failures, count(*) FILTER (NOT ok AND day(ts) <= 10) AS early_failures,
         quantile_cont(latency_s, 0.95) AS p95_s FROM outcomes GROUP BY ALL)
SELECT service, {sql_stamp('month', 'month')}, requests, failures, early_failures, round(p95_s, 6) AS p95_s,
       round(1 - failures / requests, 9) AS availability, 1 - failures / requests >= objective AS availability_ok,
       round(p95_s, 6) < p95_limit_s AS p95_ok, round(early_failures / (requests * (1 - objective)), 4) AS early_budget_spent,
       early_failures / (requests * (1 - objective)) > 0.5 AS freeze FROM sums""",
)
def slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_line = F.col("l_linestatus") == "O"
    outcomes = table(spark, sf_dir, "lineitem").select(
        F.when(open_line, "pipeline").otherwise("dashboard").alias("service"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_returnflag") != "R").alias("ok"),
        F.when(open_line, F.col("l_quantity")).otherwise(F.col("l_discount") * 4).alias("latency_s"),
    )
    report = slo_report(outcomes, _SLO_OBJECTIVES)
    return report.select(
        "service",
        stamp_text("month"),
        "requests",
        "failures",
        "early_failures",
        F.round("p95_s", 6).alias("p95_s"),
        F.round("availability", 9).alias("availability"),
        "availability_ok",
        (F.round("p95_s", 6) < F.col("p95_limit_s")).alias("p95_ok"),
        F.round("early_budget_spent", 4).alias("early_budget_spent"),
        "freeze",
    )


@query(
    "up_latest",
    f"""WITH probes AS (SELECT 'job-' || CAST(user_id % 7 AS VARCHAR) AS job, ts, CAST(event_type <> 'error' AS INT) AS value FROM events)
SELECT job, arg_max(value, ts) AS value, {sql_stamp('max(ts)', 'ts')} FROM probes GROUP BY job""",
)
def up(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string")).alias("job"),
        "ts",
        (F.col("event_type") != "error").cast("int").alias("value"),
    )
    return up_latest(probes).select("job", "value", stamp_text("ts"))


@query(
    "service_status",
    """WITH latest AS (
  SELECT arg_max(event_type <> 'error', ts) FILTER (user_id % 2 = 0) AS gateway,
         arg_max(event_type <> 'error', ts) FILTER (user_id % 2 = 1) AS brain FROM events)
SELECT 'gateway' AS service, CASE WHEN gateway THEN 'online' ELSE 'offline' END AS health FROM latest
UNION ALL SELECT 'brain', CASE WHEN brain THEN 'online' ELSE 'offline' END FROM latest
UNION ALL SELECT 'pipeline', CASE WHEN gateway AND brain THEN 'online' ELSE 'degraded' END FROM latest
UNION ALL SELECT s, 'degraded' FROM unnest(['collector', 'sanitizer', 'storage']) AS t(s)""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "gateway").otherwise("brain").alias("service"),
        "ts",
        (F.col("event_type") != "error").alias("up"),
    )
    return service_status(probes)


# -- access --------------------------------------------------------------------------------------

_PATHS = ("/health", "/brain/health", "/auth/login", "/", "/kibana/app", "/admin/users", "/adminx", "/healthz", "index")
_USERS = (("u0", "viewer"), ("u1", "analyst"), ("u2", "admin"), ("u3", "intern"))


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: path by event, user by user id (the fifth one is not listed)."""
    n = F.col("event_id")
    paths = F.array(*(F.lit(p) for p in _PATHS))
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(paths, (n % len(_PATHS) + 1).cast("int")).alias("path"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("username"),
        (n % 4 != 0).alias("token_ok"),
    )
    rows = F.array(*(F.struct(F.lit(u).alias("username"), F.lit(r).alias("role")) for u, r in _USERS))
    return with_roles(requests, spark.range(1).select(F.inline(rows)))


_REQUESTS = f"""
requests AS (
  SELECT event_id, [{", ".join(f"'{p}'" for p in _PATHS)}][event_id % {len(_PATHS)} + 1] AS path,
         'u' || CAST(user_id % 5 AS VARCHAR) AS username, event_id % 4 <> 0 AS token_ok FROM events),
roles(username, role, level) AS (VALUES ('u0', 'viewer', 1), ('u1', 'analyst', 2), ('u2', 'admin', 3), ('u3', 'intern', 0))"""
_AUDIT = f"""WITH {_REQUESTS}, routes(prefix, is_exact, required_role, needed) AS (VALUES
  ('/health', true, NULL, 0), ('/brain/health', true, NULL, 0), ('/auth/', false, NULL, 0),
  ('/', false, 'viewer', 1), ('/kibana/', false, 'analyst', 2), ('/admin/', false, 'admin', 3)),
ranked AS (
  SELECT q.*, r.prefix, r.required_role, r.needed, row_number() OVER (
           PARTITION BY event_id ORDER BY r.is_exact DESC NULLS LAST, length(r.prefix) DESC) AS rn
  FROM requests q LEFT JOIN routes r ON CASE WHEN r.is_exact THEN q.path = r.prefix ELSE starts_with(q.path, r.prefix) END)
SELECT event_id, path, prefix AS route, k.required_role, CASE WHEN prefix IS NULL THEN 404 WHEN k.required_role IS NULL THEN 200
       WHEN NOT token_ok THEN 401 WHEN coalesce(level, 0) < needed THEN 403 ELSE 200 END AS status
FROM ranked k LEFT JOIN roles USING (username) WHERE rn = 1"""


@query("access_audit", _AUDIT)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_audit(access_requests(spark, sf_dir)).select("event_id", "path", "route", "required_role", "status")


@query("access_audit_table", _AUDIT)
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the routes as a table."""
    rows = F.array(
        *(
            F.struct(
                F.lit(r.prefix).alias("prefix"),
                F.lit(r.exact).alias("exact"),
                F.lit(r.required_role).cast("string").alias("required_role"),
            )
            for r in GATEWAY_ROUTES
        )
    )
    routes = spark.range(1).select(F.inline(rows))
    return access_audit(access_requests(spark, sf_dir), routes).select("event_id", "path", "route", "required_role", "status")


@query(
    "role_matrix",
    f"""WITH {_REQUESTS}, needs AS (
  SELECT role, coalesce(level, 0) AS level, ['viewer', 'analyst', 'admin', 'owner'][event_id % 4 + 1] AS required_role,
         [1, 2, 3, 999][event_id % 4 + 1] AS needed FROM requests LEFT JOIN roles USING (username))
SELECT coalesce(role, 'none') AS role, required_role, count(*) AS requests, count(*) FILTER (level >= needed) AS allowed
FROM needs GROUP BY ALL""",
)
def role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*(F.lit(r) for r in ("viewer", "analyst", "admin", "owner")))
    needs = access_requests(spark, sf_dir).withColumn(
        "required_role", F.element_at(wanted, (F.col("event_id") % 4 + 1).cast("int"))
    )
    return needs.groupBy(F.coalesce("role", F.lit("none")).alias("role"), "required_role").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(role_sufficient("role", "required_role")).alias("allowed")
    )


# -- dead letters --------------------------------------------------------------------------------


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as dead letters in the four produced shapes."""
    turns = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 4294967296 + F.col("turn")
    kind = key % 4
    time = F.date_format(
        F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), ((key % 100000 * 7919) % 100000).cast("int")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )

    def shape(**fields) -> F.Column:
        return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))

    text = F.col("text")
    value = (
        F.when(kind == 0, shape(error="queue down", raw_payload=text, failed_at=time))
        .when(kind == 1, shape(error="empty_raw_html", raw_payload=text))
        .when(kind == 2, shape(error="push failed", raw_payload=text, failed_queue="sanitized_text"))
        .otherwise(shape(error="index failed", payload=text, failed_at=time, traceparent="00-abc-def-01", source_url="u"))
    )
    stage = F.when(kind == 0, "collector").when(kind == 3, "brain").otherwise("sanitizer")
    return parse_dlq(turns.select(key.alias("id"), stage.alias("stage"), value.alias("value")), None, keep=("id",))


_DEAD = """
dead AS (
  SELECT conv_id * 4294967296 + turn AS id, text, (conv_id * 4294967296 + turn) % 4 AS kind,
         TIMESTAMP '2024-01-01' + to_minutes(((conv_id * 4294967296 + turn) % 100000 * 7919) % 100000) AS failed FROM conversations),
letters AS (
  SELECT id, ['collector', 'sanitizer', 'sanitizer', 'brain'][kind + 1] AS stage,
         ['queue down', 'empty_raw_html', 'push failed', 'index failed'][kind + 1] AS error, text AS payload,
         CASE WHEN kind = 2 THEN 'sanitized_text' END AS failed_queue, CASE WHEN kind IN (0, 3) THEN failed END AS failed_at,
         CASE WHEN kind = 3 THEN '00-abc-def-01' END AS traceparent, CASE WHEN kind = 3 THEN 'u' END AS source_url FROM dead)"""


@query(
    "dlq_rows",
    f"""WITH {_DEAD} SELECT id, stage, error, md5(payload) AS payload_md5, failed_queue, {sql_stamp('failed_at', 'failed_at')},
traceparent, source_url FROM letters""",
)
def dlq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = dead_letters(spark, sf_dir)
    return letters.select(
        "id", "stage", "error", F.md5("payload").alias("payload_md5"), "failed_queue", stamp_text("failed_at"), "traceparent", "source_url"
    )


@query(
    "dlq_replay",
    f"""WITH {_DEAD}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY failed_at NULLS FIRST, id) AS rn FROM letters)
SELECT id, CASE WHEN rn <= 300 THEN 'replayed' ELSE 'remaining' END AS state, md5(payload) AS payload_md5 FROM ranked""",
)
def dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest letters as packets, the rest as letters."""
    parts = replay(dead_letters(spark, sf_dir), 300)
    fed = parts.replayed.select("id", F.lit("replayed").alias("state"), F.md5("value").alias("payload_md5"))
    rest = parts.remaining.select("id", F.lit("remaining").alias("state"), F.md5("payload").alias("payload_md5"))
    return fed.unionByName(rest)
