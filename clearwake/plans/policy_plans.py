"""Policy scans over configuration documents written from document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.operators.policy import policy_scan
from clearwake.plans.registry import query, wide_table


def _when(condition: str, text: str, other: str = "") -> Column:
    return F.when(F.expr(condition), text).otherwise(other)


def _manifest(spark: SparkSession, sf_dir: str, *parts: Column | str) -> DataFrame:
    body = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return wide_table(spark, sf_dir, "documents", "doc_id").select("doc_id", body.alias("body"))


def compose_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(
        spark,
        sf_dir,
        '{"services":{"elasticsearch":{"image":"search:',
        _when("doc_id % 2 = 0", "latest", "7.17"),
        '"',
        _when("doc_id % 3 <> 0", ',"restart":"always"'),
        _when("doc_id % 5 = 0", ',"healthcheck":false', ',"healthcheck":{"test":"x"}'),
        "},",
        _when("doc_id % 4 <> 0", '"redis":{"image":"redis:7","restart":"always","healthcheck":{}},'),
        '"neo4j":{"image":5,"restart":"no","healthcheck":null},"collector-go":{"restart":"always"},',
        '"sanitizer-rust":{"restart":"always"},"brain-python":{"restart":"always"},"dashboard-ui":{"restart":"always"},',
        '"gateway":{"restart":',
        _when("doc_id % 7 = 0", "false", "null"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN ',\"ports\":[]' WHEN 1 THEN '' ELSE ',\"ports\":[\"80:80\"]' END"),
        '},"svc-',
        F.col("lang"),
        '":{"image":"tool:latest"}}}',
    )


@query(
    "policy_compose",
    """WITH found AS (
  SELECT doc_id, 'warn' AS severity, 'latest_tag' AS rule, 'elasticsearch' AS subject FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'warn', 'latest_tag', 'svc-' || lang FROM documents
  UNION ALL SELECT doc_id, 'deny', 'restart_policy', 'elasticsearch' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'deny', 'restart_policy', 'redis' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'deny', 'restart_policy', 'gateway' FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'deny', 'healthcheck', 'elasticsearch' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'deny', 'healthcheck', 'redis' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'deny', 'gateway_port', 'gateway' FROM documents WHERE doc_id % 6 = 0)
SELECT *, CASE rule WHEN 'latest_tag' THEN 'service ' || subject || ' must not use latest tag'
  WHEN 'restart_policy' THEN 'service ' || subject || ' must declare a restart policy'
  WHEN 'healthcheck' THEN 'service ' || subject || ' must declare a healthcheck'
  ELSE 'gateway must expose a host port' END AS message FROM found""",
)
def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_scan(compose_manifests(spark, sf_dir), "compose")


def kubernetes_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(
        spark,
        sf_dir,
        '{"kind":"',
        _when("doc_id % 8 = 7", "Service", "Deployment"),
        '","metadata":{"name":"web-',
        F.col("lang"),
        '"',
        _when("doc_id % 3 <> 0", ',"namespace":"prod"'),
        '},"spec":{"replicas":',
        F.expr("CAST(doc_id % 4 AS STRING)"),
        ',"template":{"spec":{"containers":[{"name":"app-',
        F.expr("CAST(doc_id % 5 AS STRING)"),
        '","image":"app:',
        _when("doc_id % 2 = 0", "latest", "1.0"),
        '","securityContext":{"runAsNonRoot":',
        _when("doc_id % 6 = 0", "false", "true"),
        ',"privileged":',
        _when("doc_id % 9 = 0", "true", "false"),
        '},"resources":{',
        _when("doc_id % 4 <> 1", '"limits":{"cpu":"1"}'),
        '},"livenessProbe":{},"readinessProbe":',
        _when("doc_id % 5 = 2", "false", '{"path":"/"}'),
        "},",
        # the same container twice is one finding; one without a name is none
        '{"name":"side","image":"side:latest","securityContext":{"runAsNonRoot":true},"resources":{"limits":{}},"readinessProbe":1},',
        '{"name":"side","image":"side:latest","securityContext":{"runAsNonRoot":true},"resources":{"limits":{}},"readinessProbe":1},',
        '{"image":"nameless:latest"}]}}}}',
    )


@query(
    "policy_k8s",
    """WITH d AS (SELECT doc_id, lang, 'app-' || CAST(doc_id % 5 AS VARCHAR) AS app FROM documents WHERE doc_id % 8 <> 7),
found AS (
  SELECT doc_id, 'deny' AS severity, 'non_root' AS rule, app AS subject, 'container ' || app || ' must set securityContext.runAsNonRoot: true' AS message FROM d WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 'deny', 'resource_limits', app, 'container ' || app || ' must declare resource limits' FROM d WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'deny', 'liveness_probe', 'side', 'container side must declare a livenessProbe' FROM d
  UNION ALL SELECT doc_id, 'deny', 'readiness_probe', app, 'container ' || app || ' must declare a readinessProbe' FROM d WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, 'deny', 'privileged', app, 'container ' || app || ' must not be privileged' FROM d WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id, 'deny', 'latest_tag', app, 'container ' || app || ' must not use :latest tag' FROM d WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'deny', 'latest_tag', 'side', 'container side must not use :latest tag' FROM d
  UNION ALL SELECT doc_id, 'deny', 'namespace', 'deployment', 'deployment must specify a namespace' FROM d WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'warn', 'disruption_budget', 'web-' || lang,
    'deployment web-' || lang || ' has multiple replicas but no PodDisruptionBudget referenced' FROM d WHERE doc_id % 4 > 1)
SELECT * FROM found""",
)
def kubernetes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_scan(kubernetes_manifests(spark, sf_dir), "kubernetes")


def terraform_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(
        spark,
        sf_dir,
        '{"resource":{"aws_security_group":{"sg":{"tags":{},"ingress":[{"cidr_blocks":["10.0.0.0/8"]},{"cidr_blocks":["10.1.0.0/16","',
        _when("doc_id % 3 = 0", "0.0.0.0/0", "10.2.0.0/16"),
        '"]}]}},"aws_s3_bucket":{"logs":{"tags":{}',
        _when("doc_id % 4 = 1", ',"server_side_encryption_configuration":{"rule":{}}'),
        '},"data":{',
        _when("doc_id % 2 = 0", '"tags":{"a":"b"}', '"tags":false'),
        '}},"aws_s3_bucket_server_side_encryption_configuration":{"e":{"tags":{},"bucket":"',
        _when("doc_id % 5 = 0", "logs", "data"),
        '"}},"aws_db_instance":{"db":{"tags":{},"publicly_accessible":',
        _when("doc_id % 6 = 0", "true", '"true"'),
        _when("doc_id % 7 <> 0", ',"storage_encrypted":true'),
        '}},"aws_elasticache_replication_group":{"cache":{"tags":{}',
        _when("doc_id % 2 = 1", ',"auth_token":"t"'),
        '}},"aws_elasticsearch_domain":{"find":{"tags":{}',
        _when("doc_id % 9 <> 0", ',"encrypt_at_rest":{"enabled":true}'),
        '}},"aws_iam_policy":{"ops":{"tags":{},"policy":{"Statement":[{"Effect":"Deny","Action":["*"]},{"Effect":"',
        _when("doc_id % 3 = 1", "Deny", "Allow"),
        '","Action":',
        _when("doc_id % 4 = 0", '["s3:Get","*"]', '"*"'),
        "}]}}}}}",
    )


@query(
    "policy_terraform",
    """SELECT doc_id, 'deny' AS severity, 'open_ingress' AS rule, 'sg' AS subject, 'security group sg allows unrestricted ingress (0.0.0.0/0)' AS message FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'deny', 'bucket_encryption', 'logs', 'S3 bucket logs must enable server-side encryption' FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, 'deny', 'bucket_encryption', 'data', 'S3 bucket data must enable server-side encryption' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'deny', 'public_database', 'db', 'RDS instance db must not be publicly accessible' FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 'deny', 'database_encryption', 'db', 'RDS instance db must enable storage encryption' FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'deny', 'cache_auth', 'cache', 'ElastiCache cluster cache must set auth_token' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'deny', 'search_encryption', 'find', 'Elasticsearch domain find must enable encrypt_at_rest' FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id, 'warn', 'tags', 'aws_s3_bucket.data', 'aws_s3_bucket.data should have tags for cost allocation and ownership' FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 'deny', 'wildcard_action', 'ops', 'IAM policy ops must not use wildcard (*) actions' FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 4 = 0""",
)
def terraform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_scan(terraform_manifests(spark, sf_dir), "terraform")
