"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative models count hashed byte 5-grams and repeated words: one over labelled good documents, one over all. The
logarithm of their ratio, centred on the target, rates a document by its mean and by its worst passage, each
in units of what held-out good documents reach. Documents are then sampled without replacement: Gumbel
noise is added to the logarithm of the weight, and the k largest sums are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table
from clearwake.session import cut_lineage

GRAM = 5
BUCKET_BITS = 17
BUCKETS = (1 << BUCKET_BITS) + 1  # the last one counts words equal to the word before
#: At most about so many labelled rows are used, chosen by a hash of the id; one in ``HELD_OUT`` sets the limits.
LABELLED_ROWS = 200_000
HELD_OUT = 4
#: Counts that a bucket is thought to have besides its own, in proportion to the models' sizes.
SMOOTHING = 20
#: 5-grams of a passage.
PASSAGE = 8
#: This share of held-out good documents may lie beyond a limit; limits are then widened by ``MARGIN``.
LOSS = 0.002
MARGIN = 1.2
#: A document at the limit has a weight of exp(-SCALE).
SCALE = 40.0
SEED = 20
_CHUNK = 512
_UNIT = 1 << 20


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of all 5-grams in order, and the rows of repeated words."""
    raw, offsets = wa.text_bytes(texts)
    packed = np.zeros(len(raw), np.uint64)
    for k in range(GRAM):
        packed[: max(0, len(raw) - k)] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.diff(offsets)
    # no 5-gram starts in the last four bytes of a row
    inside = np.ones(len(raw), bool)
    for k in range(1, GRAM):
        inside[offsets[1:][sizes >= k] - k] = False
    buckets = (wa.mix(packed[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    del packed
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), np.maximum(0, sizes - GRAM + 1))
    words = wa.split_words(raw, offsets, wa.NOT_SPACE)
    word_row = words.row_of
    same = (words.codes[1:] == words.codes[:-1]) & (word_row[1:] == word_row[:-1])
    return buckets, row, word_row[1:][same], sizes


def sampled_labels(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """``doc_id, good, held`` of at most about ``most`` labelled documents; ids with unclear labels are left out.

    A document is good if its quality is 1 and it isn't toxic.
    """
    step = max(1, -(-labels.count() // most))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    chosen = labels.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(step)) == 0))
    return chosen.groupBy("doc_id").agg(F.min(good).alias("good"), F.max(good).alias("other")).where(
        F.col("good") == F.col("other")
    ).select("doc_id", "good", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(HELD_OUT)) == 0).alias("held"))


def ngram_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the rows with ``target`` and of all rows. Tasks send vectors, which are summed in parts."""
    schema = pa.schema([("chunk", pa.int32()), ("target", pa.binary()), ("raw", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                buckets, row, same, sizes = _grams(part.column("text"))
                chosen = np.asarray(part.column("target").fill_null(False).to_numpy(zero_copy_only=False), bool)
                for counts, mask in ((raw, np.ones(len(sizes), bool)), (target, chosen)):
                    counts += np.bincount(buckets[mask[row]], minlength=BUCKETS)
                    counts[-1] += mask[same].sum()
        starts = range(0, BUCKETS, _CHUNK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(starts)), pa.int32()),
                *(pa.array([v[a : a + _CHUNK].tobytes() for a in starts], pa.binary()) for v in (target, raw)),
            ],
            schema=schema,
        )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0, 0]
        for batch in batches:
            for i, name in enumerate(("target", "raw")):
                for value in batch.column(name).to_pylist():
                    total[i] = total[i] + np.frombuffer(value, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), *(pa.array([t.tobytes()], pa.binary()) for t in total)],
            schema=schema,
        )

    out = "chunk int, target binary, raw binary"
    # as many rows as a vector has parts
    rows = docs.select("text", "target").mapInArrow(count, out).groupBy("chunk").applyInArrow(add, out).collect()
    if not rows:
        return np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    rows.sort(key=lambda r: r["chunk"])
    return tuple(np.frombuffer(b"".join(bytes(r[n]) for r in rows), np.int64) for n in ("target", "raw"))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed log of target over raw per bucket, 0 on average over the target, in whole units."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS, np.int64)
    share = target.sum() / raw.sum()
    ratio = np.log((target + SMOOTHING * share) / (share * (raw + SMOOTHING)))
    ratio -= (target * ratio).sum() / target.sum()
    return np.round(ratio * _UNIT).astype(np.int64)


def rate(docs: DataFrame, ratios: np.ndarray, keep: tuple[str, ...], within: str | None = None) -> DataFrame:
    """The ``keep`` columns, ``gram_mean`` (per 5-gram) and ``gram_worst`` (mean of the worst passage); both 0 at most for a
    text without 5-grams. Sums are of whole numbers, so they don't depend on how rows are grouped. ``within`` names a
    struct in ``keep`` that holds the text."""
    columns = list(keep) if within else list(dict.fromkeys([*keep, "text"]))
    out = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["gram_mean double", "gram_worst double"]
    )
    schema = to_arrow_schema(StructType.fromDDL(out))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            texts = pc.struct_field(batch.column(within), "text") if within else batch.column("text")
            for first, last in wa.slices(texts):
                part = batch.slice(first, last - first)
                buckets, row, same, sizes = _grams(texts.slice(first, last - first))
                upto = np.concatenate([[0], np.cumsum(ratio[buckets])])
                ends = np.searchsorted(row, np.arange(len(sizes) + 1))
                total = upto[ends[1:]] - upto[ends[:-1]]
                total += ratio[-1] * np.bincount(same, minlength=len(sizes))
                worst = np.zeros(len(sizes), np.int64)
                if len(row) >= PASSAGE:
                    sums = upto[PASSAGE:] - upto[:-PASSAGE]
                    whole = row[PASSAGE - 1 :] == row[: len(sums)]
                    np.minimum.at(worst, row[: len(sums)][whole], sums[whole])
                grams = np.maximum(1, np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).cast(schema.field(c).type) for c in keep),
                        pa.array(total / grams / _UNIT),
                        pa.array(worst / PASSAGE / _UNIT),
                    ],
                    schema=schema,
                )

    return docs.select(*columns).mapInArrow(run, out)


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, found by counting in ever narrower ranges."""
    if k <= 0:
        return None
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above, bins = 0, 1024
    while low < high:
        width = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - F.lit(low)) / F.lit(width))))
        inside = rows.where(F.col(column).between(low, high))
        found = {
            r["bin"]: r
            for r in inside.groupBy(place.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .collect()
        }
        for i in sorted(found, reverse=True):
            if above + found[i]["n"] >= k:
                low, high = found[i]["low"], found[i]["high"]
                break
            above += found[i]["n"]
    return low


@dataclass
class Model:
    ratios: np.ndarray
    mean_limit: float
    worst_limit: float
    #: the k-th largest sampling key; None keeps everything
    threshold: float | None


def _excess() -> Column:
    """How far a document is below the target, 1 at the limit."""
    return F.greatest(
        F.col("gram_mean") / F.col("mean_limit"), F.col("gram_worst") / F.col("worst_limit"), F.lit(0.0)
    )


def with_keys(rated: DataFrame, mean_limit: float, worst_limit: float, seed: int = SEED) -> DataFrame:
    """``rated`` with ``log_weight`` and ``sampling_key``, the former plus Gumbel noise from a hash of the id."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    weighted = rated.withColumns({"mean_limit": F.lit(mean_limit), "worst_limit": F.lit(worst_limit)}).withColumn(
        "log_weight", -SCALE * _excess()
    )
    return weighted.withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(uniform))).drop(
        "mean_limit", "worst_limit"
    )


def fit(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[Model, DataFrame]:
    """The model, and the rated documents (``doc_id, gram_mean, gram_worst, log_weight, sampling_key``).

    ``k`` documents are sampled; by default as many as lie within the limits. Without good labelled documents, for
    training and held out, everything is kept.
    """
    known = F.broadcast(sampled_labels(labels))  # LABELLED_ROWS bounds it
    marked = docs.select("doc_id", "text").join(known, "doc_id", "left")
    target, raw = ngram_counts(marked.withColumn("target", F.col("good") & ~F.col("held")))
    ratios = log_ratios(target, raw)
    rated = cut_lineage(rate(marked.select("doc_id", "text", "good", "held"), ratios, ("doc_id", "good", "held")))
    limits = rated.where(F.col("good") & F.col("held")).agg(
        F.percentile_approx("gram_mean", LOSS, 100_000), F.percentile_approx("gram_worst", LOSS, 100_000)
    ).first()
    if not target.sum() or limits[0] is None:
        return Model(ratios, -1.0, -1.0, None), with_keys(rated.drop("good", "held"), -1.0, -1.0, seed)
    # a limit of 0 would forbid what is as good as the target
    mean_limit, worst_limit = (min(MARGIN * x, -1e-3) for x in limits)
    keyed = with_keys(rated.drop("good", "held"), mean_limit, worst_limit, seed)
    wanted = keyed.where(F.col("log_weight") >= -SCALE).count() if k is None else k
    threshold = kth_largest(keyed, "sampling_key", min(wanted, rated.count()))
    return Model(ratios, mean_limit, worst_limit, float("inf") if threshold is None else threshold), keyed


def _sampled(model: Model) -> Column:
    return F.lit(True) if model.threshold is None else F.col("sampling_key") >= F.lit(model.threshold)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs``, all columns. Rows of equal key at the edge are all taken.

    A null or empty text has log weight 0 and is as likely as the target.
    """
    model, _ = fit(docs, labels, k)
    plain = docs.select(F.struct(*docs.columns).alias("row"), "doc_id")
    # ratings are made anew rather than joined: texts stay where they are
    rated = rate(plain, model.ratios, ("row", "doc_id"), within="row")
    return with_keys(rated, model.mean_limit, model.worst_limit).where(_sampled(model)).select("row.*")


def verdicts(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``doc_id, log_weight, sampling_key, sampled`` of every row."""
    model, keyed = fit(docs, labels, k)
    return keyed.select("doc_id", "log_weight", "sampling_key", _sampled(model).alias("sampled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
