"""Counters, rates, canary verdicts, burn rates and service reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwake.functions.text import col_of
from clearwake.operators.order_stats import quantile

# Metric names in exposition order, and the counted conditions behind them.
STAGE_METRICS = {
    "collector": (
        "collector_pages_visited_total",
        "collector_queue_push_errors_total",
        "collector_crawl_errors_total",
        "collector_dlq_push_total",
    ),
    "sanitizer": (
        "sanitizer_processed_total",
        "sanitizer_dropped_total",
        "sanitizer_errors_total",
        "sanitizer_parse_fallbacks_total",
    ),
    "brain": (
        "brain_processed_total",
        "brain_index_failures_total",
        "brain_packet_parse_fallbacks_total",
        "brain_dlq_push_total",
    ),
}
MAX_PAGES_GAUGE = "collector_max_pages"
FAILURES_METRIC = "brain_index_failures_total"
PROCESSED_METRIC = "brain_processed_total"

# Gate limits and objectives.
ERROR_THRESHOLD = 0.05
SPIKE_FACTOR = 3
SAMPLE_INTERVAL_S = 15
CANARY_DURATION_S = 120
SLO_TARGET = 0.999
BURN_RATE_LIMIT = 2.0
MAX_FAILED_RATE = 0.01
MAX_P95_MS = 500.0
MIN_CHECKS_RATE = 0.99
FREEZE_SHARE = 0.5
FREEZE_DAYS = 10


class Objective(NamedTuple):
    availability: float
    p95_s: float


# Monthly availability and p95 limits.
OBJECTIVES = {"pipeline": Objective(0.999, 120.0), "dashboard": Objective(0.9995, 0.350)}


# -- counters -----------------------------------------------------------------------------------


def sanitizer_outcomes(classified: DataFrame) -> DataFrame:
    """Classified raw packets as counted outcomes; an empty packet is dropped *and* dead-lettered."""
    return classified.select(
        F.lit("sanitizer").alias("stage"),
        (F.col("outcome") == "ok").alias("processed"),
        F.col("outcome").isin("dlq", "dropped").alias("dropped"),
        F.lit(False).alias("error"),
        F.coalesce("parse_fallback", F.lit(False)).alias("fallback"),
        F.lit(False).alias("dlq"),
    )


def brain_outcomes(parsed: DataFrame) -> DataFrame:
    """Parsed sanitized packets as counted outcomes; a quarantined one failed and is dead-lettered."""
    bad = F.col("quarantine").isNotNull()
    return parsed.select(
        F.lit("brain").alias("stage"),
        (~bad).alias("processed"),
        F.lit(False).alias("dropped"),
        bad.alias("error"),
        F.coalesce("fallback", F.lit(False)).alias("fallback"),
        bad.alias("dlq"),
    )


def collector_outcomes(fetches: DataFrame) -> DataFrame:
    """Fetch rows ``(push_failed, fetch_failed)`` as counted outcomes."""
    return fetches.select(
        F.lit("collector").alias("stage"),
        (~F.col("fetch_failed")).alias("processed"),
        F.col("push_failed").alias("dropped"),
        F.col("fetch_failed").alias("error"),
        F.lit(False).alias("fallback"),
        F.col("push_failed").alias("dlq"),
    )


_METRIC_FLAGS = {
    "collector": ("processed", "dropped", "error", "dlq"),
    "sanitizer": ("processed", "dropped", "error", "fallback"),
    "brain": ("processed", "error", "fallback", "dlq"),
}


def stage_counters(outcomes: DataFrame) -> DataFrame:
    """``stage, metric, value`` from one aggregation over outcome rows of all stages."""
    flags = ("processed", "dropped", "error", "fallback", "dlq")
    sums = outcomes.groupBy("stage").agg(*(F.count_if(F.col(f)).alias(f) for f in flags))
    named = None
    for stage, metrics in STAGE_METRICS.items():
        rows = F.array(
            *(
                F.struct(F.lit(m).alias("metric"), F.col(f).alias("value"))
                for m, f in zip(metrics, _METRIC_FLAGS[stage])
            )
        )
        hit = F.col("stage") == stage
        named = F.when(hit, rows) if named is None else named.when(hit, rows)
    return sums.select("stage", F.inline(named))


def exposition(counters: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One ``line`` of metrics text per counter, and its ``metric`` to sort by; with ``max_pages`` that gauge as well."""
    values = counters.select("metric", F.col("value").cast("long").alias("value"))
    if max_pages is not None:
        gauge = counters.sparkSession.range(1).select(F.lit(MAX_PAGES_GAUGE).alias("metric"), F.lit(max_pages).cast("long").alias("value"))
        values = values.unionByName(gauge)
    return values.select("metric", F.concat_ws(" ", "metric", F.col("value").cast("string")).alias("line"))


# -- rates --------------------------------------------------------------------------------------


MAX_SLICE_S = 60


def window_start(ts: Column | str, seconds: int) -> Column:
    return F.window(col_of(ts), f"{seconds} seconds")["start"]


SERIES = ("job", "metric")


def _step(previous: Column, current: Column) -> Column:
    """Increase from one value to the next; a drop is a restart from 0."""
    return F.when(previous.isNull(), 0.0).when(current < previous, current).otherwise(current - previous)


def _slices(samples: DataFrame, seconds: int) -> DataFrame:
    """One row per series and slice of time: its increase ``_inner``, number of samples, and ``_carry``, the increase since
    the last sample of the slice before, which began at ``_before``.

    Samples are compared within slices; between slices only the first and last value matter. So a series of any density
    is never sorted in one task: what is ordered per series is one row per slice.
    """
    within = Window.partitionBy(*SERIES, "_slice").orderBy("ts", "value")
    sliced = samples.select(*SERIES, "ts", "value", window_start("ts", seconds).alias("_slice"))
    stepped = sliced.withColumn("_step", _step(F.lag("value").over(within), F.col("value")))
    order = F.struct("ts", "value")
    per_slice = stepped.groupBy(*SERIES, "_slice").agg(
        F.sum("_step").alias("_inner"),
        F.min_by("value", order).alias("_first"),
        F.max_by("value", order).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    across = Window.partitionBy(*SERIES).orderBy("_slice")
    return per_slice.withColumns(
        {"_carry": _step(F.lag("_last").over(across), F.col("_first")), "_before": F.lag("_slice").over(across)}
    )


def counter_increase(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """Increase of each counter per window, and its per-second ``rate``; a drop is a restart from 0.

    An increase counts for the window of its later sample.
    """
    slice_s = max(s for s in range(1, MAX_SLICE_S + 1) if seconds % s == 0)
    return (
        _slices(samples, slice_s)
        .groupBy(*SERIES, window_start("_slice", seconds).alias("window_start"))
        .agg(F.sum("_n").alias("samples"), F.sum(F.col("_inner") + F.col("_carry")).alias("increase"))
        .withColumn("rate", F.col("increase") / F.lit(float(seconds)))
    )


def rolling_rate(samples: DataFrame, window_s: int = 60, step_s: int = SAMPLE_INTERVAL_S) -> DataFrame:
    """Per-second rate of each counter over the last ``window_s`` seconds, every ``step_s``: ``ts, samples, increase, rate``.

    ``ts`` is a multiple of the step; its window is from ``ts - window_s`` on and ends before ``ts``, so a sample at ``ts``
    belongs to later ones. Increases between two samples of the window count, those since a sample before it don't, and
    nothing is extrapolated to its ends. A window with one sample has a null rate, one without any no row.

    Windows overlap, samples are not copied: they are reduced to one row per slice of a step first, and these rows go to the
    ``window_s / step_s`` windows they are part of.
    """
    if step_s <= 0 or window_s % step_s:
        raise ValueError("the window must be a multiple of the step")

    def later(seconds: int) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))

    ends = F.array(*(F.col("_slice") + later(s) for s in range(step_s, window_s + 1, step_s)))
    shared = _slices(samples, step_s).withColumn("ts", F.explode(ends))
    # the step from the slice before counts where that one is in the window
    joined = F.when(F.col("_before") >= F.col("ts") - later(window_s), F.col("_carry")).otherwise(0.0)
    return (
        shared.groupBy(*SERIES, "ts")
        .agg(F.sum("_n").alias("samples"), F.sum(F.col("_inner") + joined).alias("increase"))
        .withColumn("rate", F.when(F.col("samples") > 1, F.col("increase") / F.lit(float(window_s))))
    )


def _ratio(failures: Column, others: Column, denominator: str) -> Column:
    if denominator not in ("processed", "total"):
        raise ValueError("denominator must be 'processed' or 'total'")
    below = others if denominator == "processed" else others + failures
    return F.when(failures.isNull() | below.isNull() | (below <= 0), 0.0).otherwise(failures / below)


def error_ratio(
    samples: DataFrame,
    seconds: int = 60,
    failures: str = FAILURES_METRIC,
    processed: str = PROCESSED_METRIC,
    denominator: str = "processed",
    step_s: int | None = None,
) -> DataFrame:
    """Failure rate over success rate per job and window: ``job, ts, ratio``; 0 where undefined.

    Windows follow each other and ``ts`` is their start; with ``step_s`` they are those of ``rolling_rate``, where ``ts``
    is the end.
    """
    wanted = samples.where(F.col("metric").isin(failures, processed))
    if step_s is None:
        rates = counter_increase(wanted, seconds).withColumnRenamed("window_start", "ts")
    else:
        rates = rolling_rate(wanted, seconds, step_s)
    both = rates.groupBy("job", "ts").agg(
        F.sum(F.when(F.col("metric") == failures, F.col("rate"))).alias("_failed"),
        F.sum(F.when(F.col("metric") == processed, F.col("rate"))).alias("_done"),
    )
    return both.select("job", "ts", _ratio(F.col("_failed"), F.col("_done"), denominator).alias("ratio"))


def outcome_ratio(
    outcomes: DataFrame, seconds: int = 60, key: str = "deployment", denominator: str = "processed"
) -> DataFrame:
    """The same ratio from outcome events ``(key, ts, failed)`` instead of counters."""
    both = outcomes.groupBy(key, F.window("ts", f"{seconds} seconds").alias("_w")).agg(
        F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("processed")
    )
    ratio = _ratio(F.col("failures").cast("double"), F.col("processed").cast("double"), denominator)
    return both.select(key, F.col("_w.start").alias("ts"), "failures", "processed", ratio.alias("ratio"))


def _with_key(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``found``, one row per key, where there is one; null is a key too."""
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(found.withColumnRenamed(key, "_key"), same, "left").drop("_key")


def canary_verdict(
    ratios: DataFrame,
    threshold: float = ERROR_THRESHOLD,
    key: str = "deployment",
    healthy: Column | bool = True,
    baseline: Column | bool = False,
    duration_s: int | None = None,
) -> DataFrame:
    """One verdict per deployment from its ratio samples ``(key, ts, ratio)``.

    The first sample above three times the threshold ends the observation, samples at the same time included. Otherwise the
    mean decides. ``baseline`` marks rows sampled before the switch: the newest of them is reported
    and has no say. ``healthy`` is false where the gateway did not come up after the switch. With ``duration_s`` the
    observation ends so long after its first sample, and later ones have no say; without it all samples count.
    """
    before = baseline if isinstance(baseline, Column) else F.lit(baseline)
    well = healthy if isinstance(healthy, Column) else F.lit(healthy)
    canary = ~F.col("_before")
    rows = ratios.withColumns({"_before": before, "_healthy": well})
    if duration_s is not None:
        length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(duration_s))
        starts = rows.where(canary).groupBy(key).agg((F.min("ts") + length).alias("_until"))
        rows = _with_key(rows, starts, key).where(F.col("_before") | (F.col("ts") < F.col("_until")))
    spikes = rows.where(canary & (F.col("ratio") > threshold * SPIKE_FACTOR)).groupBy(key).agg(F.min("ts").alias("_spike_at"))
    observed = _with_key(rows, spikes, key).where(
        F.col("_before") | F.col("_spike_at").isNull() | (F.col("ts") <= F.col("_spike_at"))
    )
    summary = observed.groupBy(key).agg(
        F.coalesce(F.bool_and("_healthy"), F.lit(True)).alias("_ok"),
        F.max("_spike_at").isNotNull().alias("_spiked"),
        F.max("_spike_at").alias("spike_at"),
        F.count_if(canary).alias("samples"),
        F.coalesce(F.avg(F.when(canary, F.col("ratio"))), F.lit(0.0)).alias("mean_ratio"),
        F.coalesce(F.max_by(F.col("ratio"), F.when(~canary, F.col("ts"))), F.lit(0.0)).alias("baseline_ratio"),
    )
    verdict = (
        F.when(~F.col("_ok"), "ROLLBACK_UNHEALTHY")
        .when(F.col("_spiked"), "ROLLBACK_SPIKE")
        .when(F.col("mean_ratio") > threshold, "ROLLBACK_AVG")
        .otherwise("PROMOTE")
    )
    return summary.select(key, "samples", "mean_ratio", "baseline_ratio", "spike_at", verdict.alias("verdict"))


# -- gates and reports ---------------------------------------------------------------------------


def _error_budget(slo: float) -> float:
    budget = 1.0 - slo
    if budget <= 0.0:
        raise ValueError("the SLO target must be below 1")
    return budget


def _burned(df: DataFrame, failed_rate: Column, slo: float, limit: float) -> DataFrame:
    rated = df.withColumn("failed_rate", failed_rate).withColumn(
        "burn_rate", F.col("failed_rate") / _error_budget(slo)
    )
    verdict = (
        F.when(F.col("burn_rate").isNull(), "error").when(F.col("burn_rate") > limit, "fail").otherwise("pass")
    )
    return rated.withColumn("verdict", verdict)


def burn_rate(
    requests: DataFrame, seconds: int, slo: float = SLO_TARGET, limit: float = BURN_RATE_LIMIT
) -> DataFrame:
    """Burn rate per service and window of requests ``(service, ts, failed)``."""
    grouped = requests.groupBy("service", F.window("ts", f"{seconds} seconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(F.col("failed").cast("double")).alias("_rate")
    )
    named = grouped.select("service", F.col("_w.start").alias("window_start"), "requests", "_rate")
    return _burned(named, F.col("_rate"), slo, limit).drop("_rate")


def burn_rate_of_summaries(
    summaries: DataFrame, slo: float = SLO_TARGET, limit: float = BURN_RATE_LIMIT
) -> DataFrame:
    """Burn rate per load-test summary; without a failure rate the failed checks stand in."""
    failed = F.col("metrics.http_req_failed.values.rate")
    checks = F.col("metrics.checks.values.rate")
    from_checks = F.when(checks.isNotNull(), F.greatest(F.lit(0.0), 1.0 - checks))
    return _burned(summaries, F.coalesce(failed, from_checks), slo, limit)


def load_gate(requests: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Load-test thresholds per group of requests ``(failed, latency_ms, checks, checks_passed)``."""
    rates = requests.groupBy(*keys).agg(
        F.avg(F.col("failed").cast("double")).alias("failed_rate"),
        (F.sum("checks_passed") / F.sum("checks")).alias("checks_rate"),
    )
    p95 = quantile(requests, keys, "latency_ms", 0.95, "p95_ms")
    return (
        rates.join(p95, list(keys))
        .withColumn("failed_ok", F.col("failed_rate") < MAX_FAILED_RATE)
        .withColumn("p95_ok", F.col("p95_ms") < MAX_P95_MS)
        .withColumn("checks_ok", F.col("checks_rate") > MIN_CHECKS_RATE)
        .withColumn("passed", F.col("failed_ok") & F.col("p95_ok") & F.col("checks_ok"))
    )


def slo_report(outcomes: DataFrame, objectives: Mapping[str, Objective] = OBJECTIVES) -> DataFrame:
    """Availability, exact p95 and error budget per service and month of ``(service, ts, ok, latency_s)``.

    ``freeze`` is true when the first ten days spend more than half of the month's budget.
    """

    def lookup(values: dict[str, float]) -> Column:
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return F.create_map(*pairs)[F.col("service")]

    keys = ["service", "month"]
    monthly = outcomes.withColumn("month", F.date_trunc("month", "ts"))
    early = F.dayofmonth("ts") <= FREEZE_DAYS
    sums = monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.count_if(~F.col("ok") & early).alias("early_failures"),
    )
    p95 = quantile(monthly, keys, "latency_s", 0.95, "p95_s").drop("n")
    allowed = F.col("requests") * (1.0 - F.col("objective"))
    return (
        sums.join(p95, keys, "left")
        .withColumn("objective", lookup({s: o.availability for s, o in objectives.items()}))
        .withColumn("p95_limit_s", lookup({s: o.p95_s for s, o in objectives.items()}))
        .withColumn("availability", 1.0 - F.col("failures") / F.col("requests"))
        .withColumn("availability_ok", F.col("availability") >= F.col("objective"))
        .withColumn("p95_ok", F.col("p95_s") < F.col("p95_limit_s"))
        .withColumn("early_budget_spent", F.col("early_failures") / allowed)
        .withColumn("freeze", F.col("early_budget_spent") > FREEZE_SHARE)
    )


def up_latest(samples: DataFrame) -> DataFrame:
    """Newest ``value`` per job."""
    return samples.groupBy("job").agg(
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts")
    )


# Services that are probed, and services whose state is only inferred.
PROBED_SERVICES = ("gateway", "brain")
UNPROBED_SERVICES = ("collector", "sanitizer", "storage")


def service_status(probes: DataFrame) -> DataFrame:
    """``service, health`` from probes ``(service, ts, up)``; the newest probe of a service counts.

    A service without a probe is offline. The whole flow is online only if all probed are.
    """
    latest = up_latest(probes.select(F.col("service").alias("job"), "ts", F.col("up").cast("int").alias("value")))
    flags = latest.agg(
        *(
            F.coalesce(F.max(F.when(F.col("job") == s, F.col("value"))) == 1, F.lit(False)).alias(s)
            for s in PROBED_SERVICES
        )
    )
    every = reduce(lambda a, b: a & b, (F.col(s) for s in PROBED_SERVICES))
    rows = [
        *((s, F.when(F.col(s), "online").otherwise("offline")) for s in PROBED_SERVICES),
        ("pipeline", F.when(every, "online").otherwise("degraded")),
        *((s, F.lit("degraded")) for s in UNPROBED_SERVICES),
    ]
    return flags.select(F.inline(F.array(*(F.struct(F.lit(s).alias("service"), h.alias("health")) for s, h in rows))))
