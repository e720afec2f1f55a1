"""Versioned document tables: migration, reads, evaluation and text features over documents."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.functions.trace import make_traceparent
from clearwake.operators.enrich import enrich_text
from clearwake.operators.index import (
    auto_migrate,
    date_histogram,
    dry_run,
    entity_counts,
    index_counts,
    label_distribution,
    merge_versions,
    migrate_single,
    nested_match,
    old_versions,
    range_filter,
    read_index,
    reindex,
    term_filter,
    text_match,
    versions,
    write_index,
)
from clearwake.operators.index_log import history
from clearwake.operators.learn import (
    fold_report,
    load_model,
    load_text_model,
    out_of_fold,
    tfidf,
    train_forest,
    train_text,
)
from clearwake.operators.quality import (
    class_counts,
    evaluate,
    failures,
    label_metrics,
    rule_predictions,
    stratified_folds,
    top_failures,
)
from clearwake.operators.ranking import bm25, read_term_index, term_index, write_term_index
from clearwake.plans.inputs import INDEXED, RULED, SEEDED, indexed_docs, moment, seeded_docs
from clearwake.plans.registry import query, table, wide_table
from clearwake.session import scratch_path

ALIAS = "documents"


# -- reads ---------------------------------------------------------------------------------------


@query("term_filter", f"WITH {INDEXED} SELECT id, risk_label, source_url FROM indexed WHERE risk_label IN ('HIGH', 'LOW')")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_filter(indexed_docs(spark, sf_dir), "risk_label", "HIGH", "LOW").select("id", "risk_label", "source_url")


@query(
    "range_filter",
    f"""WITH {INDEXED} SELECT id, risk_score FROM indexed
WHERE risk_score >= 20 AND ts >= TIMESTAMP '2024-01-01 01:00:00' AND ts < TIMESTAMP '2024-01-01 12:00:00'""",
)
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = datetime.timezone.utc
    timed = range_filter(
        indexed_docs(spark, sf_dir),
        "timestamp",
        datetime.datetime(2024, 1, 1, 1, tzinfo=utc),
        datetime.datetime(2024, 1, 1, 12, tzinfo=utc),
    )
    return range_filter(timed, "risk_score", 20).select("id", "risk_score")


@query("nested_match", f"WITH {INDEXED} SELECT id, entity_count FROM indexed WHERE list_contains(entities, 'dans|GPE')")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_match(indexed_docs(spark, sf_dir), "GPE", "dans").select("id", "entity_count")


_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"


@query(
    "text_match",
    f"""WITH {INDEXED} SELECT id, 'all' AS mode FROM indexed WHERE list_has_all({_WORDS}, ['the', 'password'])
UNION ALL SELECT id, 'any' FROM indexed WHERE list_has_any({_WORDS}, ['login', 'nicht'])""",
)
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed_docs(spark, sf_dir)
    every = text_match(index, ["The", "password"]).select("id", F.lit("all").alias("mode"))
    return every.unionByName(text_match(index, ["login", "nicht"], every=False).select("id", F.lit("any").alias("mode")))


@query(
    "ranked_match",
    f"""WITH {INDEXED}, words AS (SELECT id, {_WORDS} AS w FROM indexed),
queries AS (
  SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM benchmark),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words WHERE len(w) > 0),
postings AS (SELECT id, len(w) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM words) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score
  FROM queries JOIN postings USING (term) JOIN dfs USING (term), totals GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM scores)
SELECT query_id, CAST(place AS INTEGER) AS rank, id, round(score, 6) AS score FROM ranked WHERE place <= 10""",
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item, from a stored index of the items' words."""
    path = scratch_path(spark, "terms")
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    write_term_index(term_index(indexed_docs(spark, sf_dir), only=queries), path)
    return bm25(read_term_index(spark, path), queries).withColumn("score", F.round("score", 6))


@query(
    "date_histogram",
    f"WITH {INDEXED} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, risk_label, count(*) AS documents FROM indexed GROUP BY ALL",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = date_histogram(indexed_docs(spark, sf_dir), "hour")
    return found.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query("label_distribution", f"WITH {INDEXED} SELECT schema_version, risk_label, count(*) AS documents FROM indexed GROUP BY ALL")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_distribution(indexed_docs(spark, sf_dir))


@query(
    "entity_counts",
    f"""WITH {INDEXED}, mentions AS (SELECT id, unnest(entities) AS entity FROM indexed)
SELECT split_part(entity, '|', 2) AS type, split_part(entity, '|', 1) AS text, count(*) AS mentions, count(DISTINCT id) AS documents
FROM mentions GROUP BY entity""",
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_counts(indexed_docs(spark, sf_dir))


# -- versions ------------------------------------------------------------------------------------


def versioned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents in three overlapping versions, each scored under its own model version."""
    n = F.col("doc_id")
    parts = {"v1": n % 3 != 1, "v2": n % 3 != 2, "v3": n % 3 == 0}
    docs = seeded_docs(spark, sf_dir).withColumns(
        {"id": n.cast("string"), "traceparent": make_traceparent("doc_id"), "source_url": F.col("source")}
    )
    return {
        version: enrich_text(
            docs.where(part),
            model_version=f"model-{version}",
            schema_version=version,
            now=moment(n, "MINUTE"),
            keep=("id",),
        )
        for version, part in parts.items()
    }


@query(
    "index_counts",
    "SELECT v AS schema_version, count(*) AS documents FROM documents, unnest(['v1', 'v2', 'v3']) AS t(v) "
    "WHERE CASE v WHEN 'v1' THEN doc_id % 3 <> 1 WHEN 'v2' THEN doc_id % 3 <> 2 ELSE doc_id % 3 = 0 END GROUP BY v",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = versioned(spark, sf_dir)
    return index_counts(parts["v1"].unionByName(parts["v2"]).unionByName(parts["v3"]))


@query(
    "reindex",
    f"""WITH {SEEDED}, {RULED}
SELECT CAST(doc_id AS VARCHAR) AS id, 'v2' AS schema_version, CASE WHEN doc_id % 3 <> 1 THEN 'model-v1' ELSE 'model-v2' END AS model_version,
       risk_score, CASE doc_id % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'kept' ELSE 'created' END AS change FROM ruled""",
)
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = versioned(spark, sf_dir)
    moved = reindex(parts["v1"], parts["v2"], "v2")
    changes = moved.created.select("id", F.lit("created").alias("change")).unionByName(
        moved.updated.select("id", F.lit("updated").alias("change"))
    )
    return moved.target.join(changes, "id", "left").select(
        "id", "schema_version", "model_version", "risk_score", F.coalesce("change", F.lit("kept")).alias("change")
    )


_MERGED = f"""WITH {SEEDED}, {RULED}
SELECT CAST(doc_id AS VARCHAR) AS id, 'v3' AS schema_version, CASE WHEN doc_id % 3 <> 2 THEN 'model-v2' ELSE 'model-v1' END AS model_version,
       risk_score, risk_label FROM ruled"""


@query("merge_versions", _MERGED)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = versioned(spark, sf_dir)
    out = merge_versions([("v1", parts["v1"]), ("v2", parts["v2"])], parts["v3"], "v3")
    return out.select("id", "schema_version", "model_version", "risk_score", "risk_label")


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> str:
    root = scratch_path(spark, "index")
    parts = versioned(spark, sf_dir)
    for name in names:
        write_index(parts[name], root, name, f"model-{name}", ALIAS)
    return root


@query("auto_migrate", _MERGED)
def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge through stored versions and the alias."""
    root = _stored(spark, sf_dir, "v1", "v2", "v3")
    auto_migrate(spark, root, ALIAS, "v3", "model-v3")
    out = read_index(spark, root, alias=ALIAS)
    return out.select("id", "schema_version", "model_version", "risk_score", "risk_label")


@query(
    "migrate_single",
    f"""WITH {SEEDED}, {RULED}
SELECT CAST(doc_id AS VARCHAR) AS id, 'v2' AS schema_version, CASE WHEN doc_id % 3 <> 1 THEN 'model-v1' ELSE 'model-v2' END AS model_version,
       risk_score FROM ruled""",
)
def migrated_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, sf_dir, "v1", "v2")
    migrate_single(spark, root, ALIAS, "v1", "v2", "model-v2")
    return read_index(spark, root, alias=ALIAS).select("id", "schema_version", "model_version", "risk_score")


@query(
    "index_writers",
    f"""WITH {SEEDED}, {RULED}
SELECT CAST(doc_id AS VARCHAR) AS id, risk_label, md5(text) AS content_md5, 'v1' AS schema_version, 5 AS log_entries FROM ruled""",
)
def written_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers at once, of overlapping parts of the documents: every change is in the log, every document is one row."""
    root = scratch_path(spark, "index")
    n = F.col("doc_id")
    docs = seeded_docs(spark, sf_dir).withColumns(
        {"id": n.cast("string"), "traceparent": make_traceparent("doc_id"), "source_url": F.col("source")}
    )
    rows = enrich_text(docs, model_version="m", schema_version="v1", now=moment(n, "MINUTE"), keep=("id",))
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(write_index, rows.where(F.col("id").cast("long") % 5 != i), root, "v1", "m", ALIAS) for i in range(4)]
        for job in jobs:
            job.result()
    entries = history(spark, root).count()
    return read_index(spark, root, alias=ALIAS).select(
        "id", "risk_label", F.md5("content").alias("content_md5"), "schema_version", F.lit(entries).alias("log_entries")
    )


@query("index_scan", f"WITH {SEEDED}, {RULED} SELECT CAST(doc_id AS VARCHAR) AS id, risk_label, md5(text) AS content_md5 FROM ruled WHERE doc_id % 3 <> 2")
def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, sf_dir, "v1", "v2")
    return read_index(spark, root, "v2").select("id", "risk_label", F.md5("content").alias("content_md5"))


@query(
    "old_versions",
    "SELECT 'v1' AS version, count(*) FILTER (doc_id % 3 <> 1) AS documents FROM documents "
    "UNION ALL SELECT 'v2', count(*) FILTER (doc_id % 3 <> 2) FROM documents",
)
def old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration's dry run: what each version but the current one holds."""
    root = _stored(spark, sf_dir, "v1", "v2", "v3")
    return dry_run(spark, root, "v3").join(old_versions(versions(spark, root), "v3").select("version"), "version")


# -- evaluation ----------------------------------------------------------------------------------


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled cases; every 13th label is wrong."""
    n = F.col("doc_id")
    hits = n % 9
    right = F.when(hits >= 5, "CRITICAL").when(hits >= 2, "HIGH").when(hits >= 1, "MEDIUM").otherwise("LOW")
    return seeded_docs(spark, sf_dir).select(
        n.alias("id"),
        F.concat(F.lit("case-"), F.lpad(n.cast("string"), 12, "0")).alias("name"),
        "text",
        F.array().cast("array<struct<text:string,type:string>>").alias("entities"),
        F.when(n % 13 == 0, "UNKNOWN").otherwise(right).alias("expected_label"),
    )


_CASES = f"""{SEEDED}, {RULED},
cases AS (
  SELECT doc_id AS id, 'case-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, risk_score AS score, risk_label AS predicted,
         CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN' WHEN doc_id % 9 >= 5 THEN 'CRITICAL' WHEN doc_id % 9 >= 2 THEN 'HIGH'
              WHEN doc_id % 9 >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS expected_label FROM ruled)"""


@query(
    "eval_accuracy",
    f"""WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (predicted = expected_label) AS correct,
round(avg(CAST(predicted = expected_label AS INT)), 9) AS accuracy, avg(CAST(predicted = expected_label AS INT)) >= 0.9 AS passed FROM cases""",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(cases(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "top_failures",
    f"""WITH {_CASES} SELECT name, expected_label AS expected, predicted AS actual, score FROM cases
WHERE predicted <> expected_label ORDER BY name LIMIT 5""",
)
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_failures(failures(cases(spark, sf_dir)))


_METRICS = """, names AS (SELECT DISTINCT expected AS label FROM pairs UNION SELECT DISTINCT predicted FROM pairs),
sums AS (
  SELECT label, count(*) FILTER (expected = label AND predicted = label) AS tp, count(*) FILTER (expected <> label AND predicted = label) AS fp,
         count(*) FILTER (expected = label AND predicted <> label) AS fn, count(*) FILTER (expected <> label AND predicted <> label) AS tn
  FROM names, pairs GROUP BY label)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) AS false_positive_rate FROM sums"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "false_positive_rate")})


@query("label_metrics", f"WITH {_CASES}, pairs AS (SELECT expected_label AS expected, predicted FROM cases){_METRICS}")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rule_predictions(cases(spark, sf_dir))
    return _rounded(label_metrics(scored.select(F.col("expected_label").alias("expected"), "predicted")))


@query(
    "quality_metrics",
    f"WITH pairs AS (SELECT quality AS expected, doc_id % 2 AS predicted FROM documents JOIN labels USING (doc_id)){_METRICS}",
)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(
        label_metrics(joined.select(F.col("quality").cast("long").alias("expected"), (F.col("doc_id") % 2).alias("predicted")))
    )


@query(
    "class_counts",
    f"""WITH {_CASES}, sizes AS (SELECT expected_label AS label, count(*) AS n FROM cases GROUP BY 1)
SELECT label, n, (SELECT min(n) FROM sizes) AS smallest, least((SELECT min(n) FROM sizes), 3) AS folds FROM sizes""",
)
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(cases(spark, sf_dir))


@query("stratified_folds", f"WITH {_CASES} SELECT id, expected_label, ntile(3) OVER (PARTITION BY expected_label ORDER BY id) AS fold FROM cases")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_folds(cases(spark, sf_dir), 3).select("id", "expected_label", "fold")


# -- models --------------------------------------------------------------------------------------

_TERMS = r"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 5000),
weights AS (
  SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term))"""


@query(
    "tfidf_weights",
    f"WITH {_TERMS} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weights",
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf(wide_table(spark, sf_dir, "documents", "doc_id"), "doc_id").withColumn("weight", F.round("weight", 6))


def clean_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cases`` without wrong labels."""
    return cases(spark, sf_dir).where("expected_label <> 'UNKNOWN'")


_CLEAN = f"{_CASES}, clean AS (SELECT id, expected_label FROM cases WHERE expected_label <> 'UNKNOWN')"


@query("forest_fit", f"WITH {_CLEAN} SELECT id, expected_label, expected_label AS ml_label FROM clean")
def forest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored forest, trained on labels that follow from the features, gives every row its label; rows without text none."""
    labelled = clean_cases(spark, sf_dir)
    blank = labelled.withColumns({"id": F.col("id") + F.lit(1 << 40), "text": F.lit(None).cast("string")})
    path = scratch_path(spark, "forest")
    train_forest(labelled.unionByName(blank)).save(path)
    predicted = load_model(path).transform(labelled.unionByName(blank))
    return predicted.select("id", "expected_label", "ml_label").where((F.col("id") < F.lit(1 << 40)) | F.col("ml_label").isNotNull())


@query(
    "text_fit",
    """WITH marked AS (SELECT doc_id AS id, ['low', 'mid', 'top'][1 + doc_id % 3] AS expected_label FROM documents)
SELECT id, expected_label, expected_label AS ml_label FROM marked""",
)
def text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored text model, trained on texts that name their class, gives every row its label."""
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, "low").when(n % 3 == 1, "mid").otherwise("top")
    marked = table(spark, sf_dir, "documents").select(
        n.alias("id"),
        F.concat_ws(" ", *[F.concat(F.lit("class"), name)] * 12, F.substring("source", 1, 4)).alias("text"),
        F.array().cast("array<struct<text:string,type:string>>").alias("entities"),
        name.alias("expected_label"),
    )
    path = scratch_path(spark, "text-model")
    train_text(marked).save(path)
    return load_text_model(spark, path).transform(marked).select("id", "expected_label", "ml_label")


@query(
    "out_of_fold",
    f"""WITH {_CLEAN}
SELECT id, expected_label, ntile(3) OVER (PARTITION BY expected_label ORDER BY id) AS fold, expected_label AS ml_label, 1.0 AS fold_accuracy
FROM clean""",
)
def folded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row predicted by the forest that has not seen its fold, with that fold's accuracy."""
    found = out_of_fold(clean_cases(spark, sf_dir), 3)
    report = fold_report(found).select("fold", F.round("accuracy", 9).alias("fold_accuracy"))
    return found.join(F.broadcast(report), "fold").select("id", "expected_label", "fold", "ml_label", "fold_accuracy")


@query("forest_predict")
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest trained on the labelled documents, applied to them."""
    labelled = cases(spark, sf_dir)
    predicted = train_forest(labelled).transform(labelled)
    return predicted.select("id", "expected_label", "ml_label")


@query("text_predict")
def text_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text classifier trained on the labelled documents, applied to them."""
    labelled = cases(spark, sf_dir)
    return train_text(labelled).transform(labelled).select("id", "expected_label", "ml_label", "confidence")
