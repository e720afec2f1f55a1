"""Counters, verdicts, gates, access decisions and policy rules."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from clearwake.operators.access import Route, access_audit, role_sufficient
from clearwake.operators.policy import policy_scan
from clearwake.operators.telemetry import (
    burn_rate_of_summaries,
    canary_verdict,
    counter_increase,
    error_ratio,
    exposition,
    rolling_rate,
    service_status,
    slo_report,
    stage_counters,
    up_latest,
)
from clearwake.schemas import LOAD_SUMMARY, SAMPLES

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def samples(spark, series):
    rows = [(job, metric, at(s), float(v)) for (job, metric), points in series.items() for s, v in points]
    return spark.createDataFrame(rows, SAMPLES)


def test_counter_increase(spark):
    df = samples(
        spark,
        {
            ("a", "up"): [(0, 1), (15, 4), (45, 6), (60, 10), (75, 12), (200, 13)],
            ("a", "reset"): [(0, 100), (30, 110), (61, 5), (70, 8)],
            ("b", "once"): [(5, 7)],
        },
    )
    rows = {(r["metric"], int((r["window_start"] - T0).total_seconds())): r for r in counter_increase(df, 60).collect()}
    got = {k: r["increase"] for k, r in rows.items()}
    assert got == {("up", 0): 5, ("up", 60): 6, ("up", 180): 1, ("reset", 0): 10, ("reset", 60): 8, ("once", 0): 0}
    assert rows["up", 60]["rate"] == pytest.approx(0.1) and rows["up", 0]["samples"] == 3
    # slices inside a longer window add up to the same
    longer = {r["metric"]: r["increase"] for r in counter_increase(df, 3600).collect()}
    assert longer == {"up": 12, "reset": 18, "once": 0}


def test_error_ratio(spark):
    fail, done = "brain_index_failures_total", "brain_processed_total"
    df = samples(
        spark,
        {
            ("a", fail): [(0, 0), (30, 1)],
            ("a", done): [(0, 0), (30, 4)],
            ("zero", fail): [(0, 0), (30, 9)],
            ("zero", done): [(0, 5), (30, 5)],
            ("missing", fail): [(0, 0), (30, 9)],
        },
    )
    assert {r["job"]: r["ratio"] for r in error_ratio(df).collect()} == {"a": 0.25, "zero": 0.0, "missing": 0.0}
    assert error_ratio(df.where("job = 'a'"), denominator="total").first()["ratio"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        error_ratio(df, denominator="none")


VERDICTS = {
    "calm": ([0.0, 0.0, 0.0], "PROMOTE"),
    "exact": ([0.25], "PROMOTE"),
    "mean": ([0.3, 0.3], "ROLLBACK_AVG"),
    "spike": ([0.0, 0.8, 0.0, 0.9], "ROLLBACK_SPIKE"),
    # exactly three times the threshold is no spike
    "edge": ([0.75, 0.0, 0.0], "PROMOTE"),
}


def test_verdicts(spark):
    rows = [(d, at(15 * i), r) for d, (ratios, _) in VERDICTS.items() for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "deployment string, ts timestamp, ratio double")
    got = {r["deployment"]: r for r in canary_verdict(df, threshold=0.25).collect()}
    assert {d: r["verdict"] for d, r in got.items()} == {d: v for d, (_, v) in VERDICTS.items()}
    assert got["spike"]["samples"] == 2 and got["spike"]["spike_at"] == at(15)
    down = canary_verdict(df, threshold=0.25, healthy=F.col("deployment") != "calm").where("deployment = 'calm'")
    assert down.first()["verdict"] == "ROLLBACK_UNHEALTHY"
    # rows from before the switch have no say
    before = canary_verdict(df, threshold=0.25, baseline=F.col("deployment").isin("spike", "mean"))
    seen = {r["deployment"]: (r["verdict"], r["baseline_ratio"], r["samples"]) for r in before.collect()}
    assert seen["spike"] == ("PROMOTE", 0.9, 0) and seen["mean"] == ("PROMOTE", 0.3, 0)


def test_verdict_within_duration(spark):
    """What comes after the observation has no say: eight good samples, then a spike."""
    rows = [("late", at(15 * i), 0.0 if i < 8 else 0.9) for i in range(9)] + [("soon", at(15 * i), 0.9 if i == 7 else 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "deployment string, ts timestamp, ratio double")
    bounded = {r["deployment"]: (r["verdict"], r["samples"]) for r in canary_verdict(df, duration_s=120).collect()}
    assert bounded == {"late": ("PROMOTE", 8), "soon": ("ROLLBACK_SPIKE", 8)}
    whole = {r["deployment"]: r["verdict"] for r in canary_verdict(df).collect()}
    assert whole == {"late": "ROLLBACK_SPIKE", "soon": "ROLLBACK_SPIKE"}


def test_burn_rate_of_summaries(spark):
    def doc(failed=None, checks=None):
        wrap = lambda v: None if v is None else {"values": {"rate": v}}
        return {"metrics": {"http_req_failed": wrap(failed), "checks": wrap(checks)}}

    docs = [doc(0.001), doc(None, 0.997), doc(None, 1.5), doc(), doc(0.0021)]
    df = spark.createDataFrame([json.dumps(d) for d in docs], "string").select(F.from_json("value", LOAD_SUMMARY).alias("d")).select("d.*")
    rows = burn_rate_of_summaries(df).collect()
    assert [r["verdict"] for r in rows] == ["pass", "fail", "pass", "error", "fail"]
    assert rows[0]["burn_rate"] == pytest.approx(1.0) and rows[2]["burn_rate"] == 0.0
    with pytest.raises(ValueError):
        burn_rate_of_summaries(df, slo=1.0)


def test_slo_report_freezes_on_an_early_burn(spark):
    day = lambda d: datetime.datetime(2024, 3, d)
    rows = [("pipeline", day(3), False, 1.0)] + [("pipeline", day(20), True, 1.0)] * 999 + [("dashboard", day(20), False, 9.0)] + [("dashboard", day(4), True, 0.1)] * 9
    report = {r["service"]: r for r in slo_report(spark.createDataFrame(rows, "service string, ts timestamp, ok boolean, latency_s double")).collect()}
    assert report["pipeline"]["availability_ok"] and report["pipeline"]["freeze"] and report["pipeline"]["p95_ok"]
    assert report["pipeline"]["early_budget_spent"] == pytest.approx(1.0)
    assert not report["dashboard"]["availability_ok"] and not report["dashboard"]["freeze"] and not report["dashboard"]["p95_ok"]


def test_status(spark):
    df = spark.createDataFrame([("gateway", at(0), False), ("gateway", at(9), True), ("other", at(9), False)], "service string, ts timestamp, up boolean")
    health = {r["service"]: r["health"] for r in service_status(df).collect()}
    assert health == {"gateway": "online", "brain": "offline", "pipeline": "degraded", "collector": "degraded", "sanitizer": "degraded", "storage": "degraded"}
    both = df.unionByName(spark.createDataFrame([("brain", at(1), True)], df.schema))
    assert {r["service"]: r["health"] for r in service_status(both).collect()}["pipeline"] == "online"
    newest = up_latest(spark.createDataFrame([("j", at(1), 1.0), ("j", at(3), 0.0)], "job string, ts timestamp, value double"))
    assert newest.first()["value"] == 0.0


def test_exposition(spark):
    rows = [("sanitizer", True, False, False, True, False), ("sanitizer", False, True, False, False, True)]
    df = spark.createDataFrame(rows, "stage string, processed boolean, dropped boolean, error boolean, fallback boolean, dlq boolean")
    lines = [r["line"] for r in exposition(stage_counters(df)).orderBy("metric").collect()]
    assert lines == [
        "sanitizer_dropped_total 1",
        "sanitizer_errors_total 0",
        "sanitizer_parse_fallbacks_total 1",
        "sanitizer_processed_total 1",
    ]


def test_access(spark):
    cases = [
        ("/health", None, False, 200),
        ("/brain/health", None, False, 200),
        ("/brain/health/x", "viewer", True, 200),
        ("/auth/login", None, None, 200),
        ("/", "viewer", False, 401),
        ("/", "viewer", None, 401),
        ("/", "viewer", True, 200),
        ("/kibana/", "viewer", True, 403),
        ("/kibana/x", "analyst", True, 200),
        ("/admin/", "analyst", True, 403),
        ("/admin/", "admin", True, 200),
        ("/adminx", "viewer", True, 200),
        ("/kibana/", "intern", True, 403),
        ("/", None, True, 403),
        ("nowhere", "admin", True, 404),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, path string, role string, token_ok boolean, expected int")
    from clearwake.operators.access import GATEWAY_ROUTES

    table = spark.createDataFrame([(r.prefix, r.exact, r.required_role) for r in GATEWAY_ROUTES], "prefix string, exact boolean, required_role string")
    for routes in (GATEWAY_ROUTES, table):
        for row in access_audit(df, routes).collect():
            assert row["status"] == row["expected"], row
    odd = access_audit(df.where("id = 10").withColumn("path", F.lit("/z")), [Route("/z", "owner")]).first()
    assert odd["status"] == 403
    pairs = spark.createDataFrame([("admin", "viewer"), ("viewer", "analyst"), (None, "viewer"), ("admin", "owner")], "u string, r string")
    assert [r[0] for r in pairs.select(role_sufficient("u", "r")).collect()] == [True, False, False, False]


# -- policy --------------------------------------------------------------------------------------

SERVICES = ("elasticsearch", "redis", "neo4j", "collector-go", "sanitizer-rust", "brain-python", "dashboard-ui", "gateway")


def good_compose():
    return {"services": {s: {"image": "i:1", "restart": "always", "healthcheck": {}, "ports": ["80:80"]} for s in SERVICES}}


def good_container():
    return {
        "name": "c",
        "image": "i:1",
        "securityContext": {"runAsNonRoot": True, "privileged": False},
        "resources": {"limits": {}},
        "livenessProbe": {},
        "readinessProbe": {},
    }


def good_deployment(*containers):
    spec = {"replicas": 1, "template": {"spec": {"containers": list(containers) or [good_container()]}}}
    return {"kind": "Deployment", "metadata": {"name": "d", "namespace": "n"}, "spec": spec}


def found(spark, family, *docs):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = policy_scan(spark.createDataFrame(rows, "doc_id string, body string"), family).collect()
    return sorted((int(r["doc_id"]), r["severity"], r["rule"], r["subject"]) for r in out)


def changed(doc, path, value):
    """A copy with the value at the path replaced, or removed where it is ``...``."""
    copy = json.loads(json.dumps(doc))
    inner = copy
    for step in path[:-1]:
        inner = inner[step]
    if value is ...:
        del inner[path[-1]]
    else:
        inner[path[-1]] = value
    return copy


def test_compose_rules(spark):
    good = good_compose()
    docs = [
        good,
        changed(good, ["services", "redis", "image"], "redis:latest"),
        changed(good, ["services", "collector-go"], ...),
        changed(good, ["services", "gateway", "restart"], False),
        changed(good, ["services", "neo4j", "healthcheck"], ...),
        changed(good, ["services", "redis", "restart"], None),
        changed(good, ["services", "gateway", "ports"], []),
        changed(good, ["services", "gateway", "ports"], ...),
        changed(good, ["services", "redis"], ...),
        "not json",
    ]
    assert found(spark, "compose", *docs) == [
        (1, "warn", "latest_tag", "redis"),
        (2, "deny", "restart_policy", "collector-go"),
        (3, "deny", "restart_policy", "gateway"),
        (4, "deny", "healthcheck", "neo4j"),
        (6, "deny", "gateway_port", "gateway"),
        (8, "deny", "healthcheck", "redis"),
        (8, "deny", "restart_policy", "redis"),
        (9, "deny", "unreadable", None),
    ]


def test_kubernetes_rules(spark):
    def with_container(path, value):
        return good_deployment(changed(good_container(), path, value))

    nameless = changed(changed(good_container(), ["name"], ...), ["livenessProbe"], ...)
    bad = changed(good_container(), ["livenessProbe"], ...)
    docs = [
        good_deployment(),
        with_container(["securityContext"], ...),
        with_container(["securityContext", "runAsNonRoot"], False),
        with_container(["resources", "limits"], ...),
        with_container(["livenessProbe"], ...),
        with_container(["readinessProbe"], False),
        with_container(["securityContext", "privileged"], True),
        with_container(["image"], "i:latest"),
        changed(good_deployment(), ["metadata", "namespace"], ...),
        changed(good_deployment(), ["spec", "replicas"], 2),
        changed(good_deployment(bad), ["kind"], "Service"),
        good_deployment(bad, bad, good_container(), nameless),
        changed(good_deployment(), ["metadata"], {"namespace": "n"}),
        changed(good_deployment(), ["spec", "replicas"], "1"),
    ]
    assert found(spark, "kubernetes", *docs) == [
        (1, "deny", "non_root", "c"),
        (2, "deny", "non_root", "c"),
        (3, "deny", "resource_limits", "c"),
        (4, "deny", "liveness_probe", "c"),
        (5, "deny", "readiness_probe", "c"),
        (6, "deny", "privileged", "c"),
        (7, "deny", "latest_tag", "c"),
        (8, "deny", "namespace", "deployment"),
        (9, "warn", "disruption_budget", "d"),
        (11, "deny", "liveness_probe", "c"),
        (13, "warn", "disruption_budget", "d"),
    ]


def test_terraform_rules(spark):
    def res(kind, body, **more):
        return {"resource": {kind: {"r": {"tags": {}, **body}}, **more}}

    def policy(*statements):
        return res("aws_iam_policy", {"policy": {"Statement": list(statements)}})

    docs = [
        res("aws_security_group", {"ingress": [{"cidr_blocks": ["10.0.0.0/8", "0.0.0.0/0"]}]}),
        res("aws_security_group", {"ingress": [{"cidr_blocks": ["10.0.0.0/8"]}, {}]}),
        res("aws_s3_bucket", {}),
        res("aws_s3_bucket", {"server_side_encryption_configuration": {}}),
        res("aws_s3_bucket", {}, aws_s3_bucket_server_side_encryption_configuration={"e": {"tags": {}, "bucket": "r"}}),
        res("aws_db_instance", {"publicly_accessible": True, "storage_encrypted": True}),
        res("aws_db_instance", {"publicly_accessible": False, "storage_encrypted": False}),
        res("aws_elasticache_replication_group", {}),
        res("aws_elasticache_replication_group", {"auth_token": "t"}),
        res("aws_elasticsearch_domain", {"encrypt_at_rest": False}),
        res("aws_elasticsearch_domain", {"encrypt_at_rest": {"enabled": False}}),
        {"resource": {"aws_vpc": {"v": {}}, "aws_eip": {"e": {"tags": False}, "f": {"tags": {"a": 1}}}}},
        policy({"Effect": "Allow", "Action": ["s3:Get", "*"]}),
        policy({"Effect": "Deny", "Action": ["*"]}, {"Effect": "Allow", "Action": "*"}, {"Effect": "Allow", "Action": ["s3:*"]}),
    ]
    assert found(spark, "terraform", *docs) == [
        (0, "deny", "open_ingress", "r"),
        (2, "deny", "bucket_encryption", "r"),
        (5, "deny", "public_database", "r"),
        (6, "deny", "database_encryption", "r"),
        (7, "deny", "cache_auth", "r"),
        (9, "deny", "search_encryption", "r"),
        (11, "warn", "tags", "aws_eip.e"),
        (11, "warn", "tags", "aws_vpc.v"),
        (12, "deny", "wildcard_action", "r"),
    ]


def test_messages(spark):
    row = policy_scan(spark.createDataFrame([("d", '{"services":{"x":{"image":"a:latest"}}}')], "doc_id string, body string"), "compose")
    assert row.where("rule = 'latest_tag'").first()["message"] == "service x must not use latest tag"


def test_scan_has_no_shuffle(spark):
    df = policy_scan(spark.createDataFrame([("d", "{}")], "doc_id string, body string"), "terraform")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_rolling_rate(spark):
    """Overlapping windows against a plain count over each of them; restarts, gaps, repeated times and edges."""
    rng = random.Random(5)
    rows, value = [], 0.0
    for second in sorted(rng.sample(range(0, 900), 120)) + [60, 75, 90]:
        value = rng.choice([0.0, value + rng.randint(0, 9), value + 1.0])
        rows.append(("j", "m", at(second), value))
    rows += [("j", "other", at(0), 1.0), ("j", "other", at(59), 3.0), ("j", "other", at(60), 4.0)]
    want = {}
    for metric in ("m", "other"):
        series = sorted((t, v) for _, m, t, v in rows if m == metric)
        for end in range(15, 1000, 15):
            inside = [v for t, v in series if at(end - 60) <= t < at(end)]
            if inside:
                increase = sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))
                want[(metric, at(end))] = (len(inside), increase, increase / 60 if len(inside) > 1 else None)
    df = spark.createDataFrame(rows, "job string, metric string, ts timestamp, value double").repartition(3)
    got = {(r["metric"], r["ts"]): (r["samples"], r["increase"], r["rate"]) for r in rolling_rate(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert got[("other", at(60))] == (2, 2.0, 2.0 / 60) and got[("other", at(75))] == (2, 1.0, 1.0 / 60)
    with pytest.raises(ValueError):
        rolling_rate(df, 60, 25)
