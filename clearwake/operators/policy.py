"""Policy rules over JSON configuration documents: one row per violation.

Each family is one projection. The rules work on the arrays and objects inside a document's
VARIANT and their findings are exploded once, so a scan has no shuffle, whatever the number of
rules. A finding is listed once per document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import strict_json

# The services and stores the compose rules name, and the rule messages.
NAMED_SERVICES = (
    "elasticsearch",
    "redis",
    "neo4j",
    "collector-go",
    "sanitizer-rust",
    "brain-python",
    "dashboard-ui",
    "gateway",
)
NAMED_STORES = ("elasticsearch", "redis", "neo4j")

_FINDING = "array<struct<severity:string,rule:string,subject:string,message:string>>"


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column, path: str) -> Column:
    """A JSON string at the path, else null."""
    return F.when(F.schema_of_variant(_get(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def _is_false(value: Column) -> Column:
    return (F.schema_of_variant(value) == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean")


def _holds(value: Column) -> Column:
    """Present and not false; null, zero and empty values hold."""
    return F.coalesce(value.isNotNull() & ~_is_false(value), F.lit(False))


def _entries(value: Column, path: str) -> Column:
    """(key, value) pairs of an object, empty otherwise."""
    pairs = F.map_entries(F.try_variant_get(value, path, "map<string,variant>"))
    return F.coalesce(pairs, F.array().cast("array<struct<key:string,value:variant>>"))


def _elements(value: Column, path: str) -> Column:
    """Items of a list or values of an object, empty otherwise."""
    listed = F.try_variant_get(value, path, "array<variant>")
    mapped = F.map_values(F.try_variant_get(value, path, "map<string,variant>"))
    return F.coalesce(listed, mapped, F.array().cast("array<variant>"))


def _finding(severity: str, rule: str, subject: Column, message: str) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        subject.alias("subject"),
        F.format_string(message, subject).alias("message"),
    )


def _each(
    items: Column,
    when: Callable[[Column], Column],
    subject: Callable[[Column], Column],
    severity: str,
    rule: str,
    message: str,
) -> Column:
    """Findings for the items that break a rule and have a subject to name."""
    broken = F.filter(items, lambda x: F.coalesce(when(x), F.lit(False)) & subject(x).isNotNull())
    return F.transform(broken, lambda x: _finding(severity, rule, subject(x), message)).cast(_FINDING)


def _once(when: Column, subject: Column, severity: str, rule: str, message: str) -> Column:
    hit = F.coalesce(when, F.lit(False)) & subject.isNotNull()
    return F.when(hit, F.array(_finding(severity, rule, subject, message))).otherwise(F.array()).cast(_FINDING)


def _latest(value: Column, path: str) -> Column:
    return _string(value, path).endswith(":latest")


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(n) for n in names))


# -- families ------------------------------------------------------------------------------------


def _compose(doc: Column) -> list[Column]:
    services = _entries(doc, "$.services")

    def lacks(name: Column, path: str) -> Column:
        return ~F.exists(services, lambda s: (s["key"] == name) & _holds(_get(s["value"], path)))

    ports = _get(doc, "$.services.gateway.ports")
    no_ports = F.to_json(ports).isin("[]", "{}") | (_string(ports, "$") == "")
    return [
        _each(services, lambda s: _latest(s["value"], "$.image"), lambda s: s["key"], "warn", "latest_tag",
              "service %s must not use latest tag"),
        _each(_names(NAMED_SERVICES), lambda n: lacks(n, "$.restart"), lambda n: n, "deny", "restart_policy",
              "service %s must declare a restart policy"),
        _each(_names(NAMED_STORES), lambda n: lacks(n, "$.healthcheck"), lambda n: n, "deny", "healthcheck",
              "service %s must declare a healthcheck"),
        _once(no_ports, F.lit("gateway"), "deny", "gateway_port", "%s must expose a host port"),
    ]


def _kubernetes(doc: Column) -> list[Column]:
    deployment = F.coalesce(_string(doc, "$.kind") == "Deployment", F.lit(False))
    containers = F.when(deployment, _elements(doc, "$.spec.template.spec.containers")).otherwise(
        F.array().cast("array<variant>")
    )

    def name(c: Column) -> Column:
        return _string(c, "$.name")

    def lacking(path: str, rule: str, message: str) -> Column:
        return _each(containers, lambda c: ~_holds(_get(c, path)), name, "deny", rule, message)

    replicas = _get(doc, "$.spec.replicas")
    kind = F.schema_of_variant(replicas)
    # any string, list or object sorts above every number
    several = F.coalesce(F.try_variant_get(replicas, "$", "double") > 1, F.lit(False)) & ~kind.isin("BOOLEAN", "STRING")
    above = (kind == "STRING") | kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return [
        lacking("$.securityContext.runAsNonRoot", "non_root", "container %s must set securityContext.runAsNonRoot: true"),
        lacking("$.resources.limits", "resource_limits", "container %s must declare resource limits"),
        lacking("$.livenessProbe", "liveness_probe", "container %s must declare a livenessProbe"),
        lacking("$.readinessProbe", "readiness_probe", "container %s must declare a readinessProbe"),
        _each(containers, lambda c: _holds(_get(c, "$.securityContext.privileged")), name, "deny", "privileged",
              "container %s must not be privileged"),
        _each(containers, lambda c: _latest(c, "$.image"), name, "deny", "latest_tag",
              "container %s must not use :latest tag"),
        _once(deployment & ~_holds(_get(doc, "$.metadata.namespace")), F.lit("deployment"), "deny", "namespace",
              "%s must specify a namespace"),
        _once(deployment & (several | above), _string(doc, "$.metadata.name"), "warn", "disruption_budget",
              "deployment %s has multiple replicas but no PodDisruptionBudget referenced"),
    ]


def _terraform(doc: Column) -> list[Column]:
    def resources(kind: str) -> Column:
        return F.filter(_entries(doc, f"$.resource.{kind}"), lambda r: _holds(r["value"]))

    def key(r: Column) -> Column:
        return r["key"]

    def lacking(kind: str, path: str, rule: str, message: str) -> Column:
        return _each(resources(kind), lambda r: ~_holds(_get(r["value"], path)), key, "deny", rule, message)

    def any_element(value: Column, path: str, test: Callable[[Column], Column]) -> Column:
        return F.exists(_elements(value, path), lambda x: F.coalesce(test(x), F.lit(False)))

    def open_ingress(r: Column) -> Column:
        return any_element(r["value"], "$.ingress", lambda rule: any_element(
            rule, "$.cidr_blocks", lambda cidr: _string(cidr, "$") == "0.0.0.0/0"))

    encryptions = _elements(doc, "$.resource.aws_s3_bucket_server_side_encryption_configuration")

    def unencrypted(r: Column) -> Column:
        elsewhere = F.exists(encryptions, lambda e: F.coalesce(_string(e, "$.bucket") == r["key"], F.lit(False)))
        return ~elsewhere & ~_holds(_get(r["value"], "$.server_side_encryption_configuration"))

    def wildcard(r: Column) -> Column:
        return any_element(r["value"], "$.policy.Statement", lambda s: (_string(s, "$.Effect") == "Allow")
                           & any_element(s, "$.Action", lambda a: _string(a, "$") == "*"))

    tagged = F.flatten(F.transform(_entries(doc, "$.resource"), lambda t: F.transform(
        _entries(t["value"], "$"),
        lambda r: F.struct(F.concat_ws(".", t["key"], r["key"]).alias("key"), r["value"].alias("value")))))
    return [
        _each(resources("aws_security_group"), open_ingress, key, "deny", "open_ingress",
              "security group %s allows unrestricted ingress (0.0.0.0/0)"),
        _each(resources("aws_s3_bucket"), unencrypted, key, "deny", "bucket_encryption",
              "S3 bucket %s must enable server-side encryption"),
        _each(resources("aws_db_instance"),
              lambda r: (F.schema_of_variant(_get(r["value"], "$.publicly_accessible")) == "BOOLEAN")
              & F.try_variant_get(r["value"], "$.publicly_accessible", "boolean"),
              key, "deny", "public_database", "RDS instance %s must not be publicly accessible"),
        lacking("aws_db_instance", "$.storage_encrypted", "database_encryption",
                "RDS instance %s must enable storage encryption"),
        lacking("aws_elasticache_replication_group", "$.auth_token", "cache_auth",
                "ElastiCache cluster %s must set auth_token"),
        lacking("aws_elasticsearch_domain", "$.encrypt_at_rest", "search_encryption",
                "Elasticsearch domain %s must enable encrypt_at_rest"),
        _each(tagged, lambda r: ~_holds(_get(r["value"], "$.tags")), key, "warn", "tags",
              "%s should have tags for cost allocation and ownership"),
        _each(resources("aws_iam_policy"), wildcard, key, "deny", "wildcard_action",
              "IAM policy %s must not use wildcard (*) actions"),
    ]


FAMILIES = {"compose": _compose, "kubernetes": _kubernetes, "terraform": _terraform}


def policy_scan(manifests: DataFrame, family: str, body: str = "body", key: str = "doc_id") -> DataFrame:
    """Violations of one family's rules: ``key, severity, rule, subject, message``.

    ``body`` is JSON text, or a VARIANT. A document that can't be read (null, not JSON, or beyond the size of a VARIANT)
    can't be cleared either: it has the one violation ``unreadable``.
    """
    rules = FAMILIES[family]
    parsed = F.col(body) if manifests.schema[body].dataType.typeName() == "variant" else strict_json(body)
    docs = manifests.select(F.col(key), parsed.alias("_doc"))
    found = reduce(lambda a, b: F.concat(a, b), rules(F.col("_doc")))
    unreadable = F.array(
        F.struct(
            F.lit("deny").alias("severity"),
            F.lit("unreadable").alias("rule"),
            F.lit(None).cast("string").alias("subject"),
            F.lit("manifest cannot be read").alias("message"),
        )
    )
    found = F.when(F.col("_doc").isNull(), unreadable).otherwise(found)
    return docs.select(key, F.inline(F.array_distinct(found)))
