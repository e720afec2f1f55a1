"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared window by window.

One dictionary is trained on ordinary passages, one on passages that make documents toxic. A window of four words is
compressed with the ordinary dictionary alone and with both; the bytes that the toxic one saves are the window's gain.
Labels belong to whole documents, most of whose words are harmless, so the toxic dictionary is trained on words that
stand in clearly more toxic than ordinary training documents; near copies among these count once. Documents that trained
neither dictionary then calibrate the rest: how much more often a gain occurs in toxic documents (its evidence), and which
sum of evidence means which probability.

Words are runs of ASCII letters, digits and everything beyond ASCII, with A-Z lower-cased. Whole texts are scored, in
segments of 1 MiB; a window that is repeated within a segment counts once. A null or empty text has no window, no evidence
and the score that goes with that. Equal texts have equal scores, whatever their ids; repeated rows are each scored.
Columns of the input that are named like the operator's own are kept apart. Without labelled documents of both kinds
every score is the share of toxic ones (0.5 if there are none at all). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table

#: Words of a window, and the bytes after which a longer one is cut.
WINDOW = 4
WINDOW_BYTES = 256
SEGMENT_BYTES = 1 << 20
#: Bounds of the sample that the model is fitted on: labelled rows, bytes of text per label, and bytes of one text.
LABELLED_ROWS = 50_000
TRAINING_BYTES = 8 << 20
LONGEST_TRAINING_TEXT = 1 << 20
#: One of so many training documents calibrates; the others train the dictionaries.
CALIBRATION = 3
ORDINARY_BYTES = 240 << 10
#: A word is toxic training text if it stands in so many toxic documents, so many standard deviations and times more often
#: than in all of them and in ordinary ones.
LEAST_DOCUMENTS, DEVIATIONS, TIMES = 3, 5.0, 6.0
#: Gains are counted between these, in bytes.
LOW_GAIN, HIGH_GAIN = -4, 12
#: Windows by which a gain's evidence is drawn to none.
PRIOR_WINDOWS = 20.0
#: Evidence beyond these doesn't change a probability.
LEAST_EVIDENCE, MOST_EVIDENCE = -10.0, 30.0
THRESHOLD = 0.7

# short matches would rebuild any word from syllables, so a match has six bytes at least: a word and its spaces
_PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=21, hash_log=18, chain_log=16, search_log=4, min_match=6, target_length=1, strategy=zstandard.STRATEGY_FAST,
    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
)
_FOLD = bytes(wa.LOWER[b] if wa.ALNUM[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, segment by segment; a segment ends where a word does."""
    begin = 0
    while begin < len(text):
        end = begin + SEGMENT_BYTES
        while end < len(text) and wa.ALNUM[text[end]] and end < begin + 2 * SEGMENT_BYTES:
            end += 1
        yield text[begin:end].translate(_FOLD).split()
        begin = end


def windows(words: Sequence[bytes]) -> list[bytes]:
    """The different windows of consecutive words, in order."""
    joined = (b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW))
    return list(
        dict.fromkeys(w[i : i + WINDOW_BYTES] for w in joined for i in range(0, len(w), WINDOW_BYTES))
    )


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    #: for each gain from ``LOW_GAIN`` to ``HIGH_GAIN``
    evidence: tuple[float, ...]
    slope: float
    offset: float

    def __getstate__(self) -> dict:
        """Compressors are made anew where the model arrives."""
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    @cached_property
    def _compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        # both have the ordinary part at the same distance
        return _compressor(self.ordinary + b"\n" * len(self.toxic)), _compressor(self.ordinary + self.toxic)

    def gains(self, parts: Sequence[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        plain, both = (c.compress for c in self._compressors)
        return np.fromiter((len(plain(w)) - len(both(w)) for w in parts), np.int64, len(parts))

    def rate(self, text: bytes) -> tuple[float, int, bytes]:
        """Sum of evidence, number of windows and the window of most evidence."""
        total, count, best, worst = 0.0, 0, 0.0, b""
        per_gain = np.array(self.evidence)
        for words in words_of(text):
            parts = windows(words)
            found = per_gain[_slot(self.gains(parts))]
            total, count = total + float(found.sum()), count + len(parts)
            if len(parts) and found.max() > best:
                best, worst = float(found.max()), parts[int(found.argmax())]
        return total, count, worst

    def probability(self, evidence: float | np.ndarray) -> np.ndarray:
        clipped = np.clip(evidence, LEAST_EVIDENCE, MOST_EVIDENCE)
        return 1.0 / (1.0 + np.exp(-(self.slope * clipped + self.offset)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=_PARAMETERS)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=_PARAMETERS)


def _slot(gains: np.ndarray) -> np.ndarray:
    return np.clip(gains, LOW_GAIN, HIGH_GAIN) - LOW_GAIN


# -- fitting -------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is none of them, as it has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS, most_bytes: int = TRAINING_BYTES
) -> list[tuple[bytes, bool, bool]]:
    """Text, label and fold (true: calibrates) of a bounded sample of labelled documents that aren't held out.

    Ids with unclear labels, and texts above ``LONGEST_TRAINING_TEXT``, are left out.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    step = max(1, -(-usable.count() // most_rows))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(step)) == 0)
    clear = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = clear.where(F.col("toxic") == F.col("other")).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    size = F.octet_length("text")
    # LABELLED_ROWS bounds what is broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(size <= LONGEST_TRAINING_TEXT)
    totals = {r["toxic"]: r["bytes"] for r in marked.groupBy("toxic").agg(F.sum(size).alias("bytes")).collect()}
    fine = 1 << 20
    share = F.when(F.col("toxic"), F.lit(_share(totals.get(True), most_bytes, fine))).otherwise(
        F.lit(_share(totals.get(False), most_bytes, fine))
    )
    sampled = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(fine)) < share)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATION)) == 0
    rows = sampled.select("doc_id", F.encode("text", "UTF-8").alias("text"), "toxic", fold.alias("fold")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    return [(bytes(r["text"]), r["toxic"], r["fold"]) for r in rows]


def _share(total: int | None, most: int, of: int) -> int:
    return of if not total else min(of, max(1, of * most // total))


def without_near_copies(texts: Sequence[bytes]) -> list[list[bytes]]:
    """Words of the texts; of texts that share a minimum hash of their word triples, the first."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = [w for segment in words_of(text) for w in segment]
        codes = wa.hash_values(pa.array(words, pa.large_binary())) if words else np.zeros(0, np.uint64)
        starts = np.arange(max(1, len(codes) - 2)) if len(codes) else np.zeros(0, np.int64)
        triples = wa.window_hashes(codes, starts, min(3, max(1, len(codes))))
        least = [(seed, int(wa.mix(triples ^ np.uint64(seed)).min())) for seed in (1, 2, 3)] if len(triples) else []
        if not any(x in seen for x in least):
            kept.append(words)
        seen.update(least)
    return kept


def toxic_words(toxic: Sequence[Sequence[bytes]], ordinary: Sequence[Sequence[bytes]]) -> set[bytes]:
    """Words that stand in clearly more toxic than ordinary documents."""
    inside, outside = (Counter(w for words in part for w in set(words)) for part in (toxic, ordinary))
    n1, n0 = len(toxic), len(ordinary)
    out = set()
    for word, count in inside.items():
        share = (count + outside[word]) / (n1 + n0)
        deviation = (n1 * share * (1 - share)) ** 0.5
        if (
            count >= LEAST_DOCUMENTS
            and count - n1 * share > DEVIATIONS * deviation
            and count * n0 > TIMES * outside[word] * n1
        ):
            out.add(word)
    return out


def _dictionary(samples: Sequence[bytes], size: int, segment: int, match: int) -> bytes:
    """A trained dictionary; of too few samples to train on, these themselves."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=segment, d=match).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    toxic_texts, ordinary_texts = without_near_copies(toxic), without_near_copies(ordinary)
    passages = [w for words in ordinary_texts for w in windows(words)]
    chosen = toxic_words(toxic_texts, ordinary_texts)
    marks = [b" %b " % w for words in toxic_texts for w in words if w in chosen]
    groups = [b"".join(marks[i : i + 8]) for i in range(0, len(marks), 8)]
    size = max(512, 3 * sum(len(w) for w in set(marks)))
    return (
        _dictionary(passages, ORDINARY_BYTES, 64, 8) if passages else b"",
        _dictionary(groups, size, 24, 6) if groups else b"",
    )


def gain_evidence(toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, ...]:
    """Log of how much more often each gain occurs in toxic documents, given how often it does in both."""
    usual = (ordinary + 1.0) / (ordinary + 1.0).sum()
    seen = (toxic + PRIOR_WINDOWS * usual) / (toxic.sum() + PRIOR_WINDOWS)
    return tuple(float(x) for x in np.log(seen / usual))


def logistic_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton steps with a slight pull to zero."""
    design = np.column_stack([x, np.ones(len(x))])
    pull = np.diag([1e-3, 1e-6])
    line = np.zeros(2)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ line, -30, 30)))
        slope = design.T @ (y - p) - pull @ line
        curve = (design * (p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(curve, slope)
        line = line + np.clip(step, -5.0, 5.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(line[0]), float(line[1])


def fit_rows(rows: Sequence[tuple[bytes, bool, bool]]) -> Model:
    """The model of ``training_rows``."""
    bins = HIGH_GAIN - LOW_GAIN + 1
    kinds = Counter((toxic, fold) for _, toxic, fold in rows)
    if not all(kinds[k] for k in ((True, False), (False, False), (True, True), (False, True))):
        share = (sum(t for _, t, _ in rows) + 0.5) / (len(rows) + 1.0)
        return Model(b"", b"", (0.0,) * bins, 0.0, float(np.log(share / (1 - share))))
    train = {kind: [t for t, toxic, fold in rows if toxic is kind and not fold] for kind in (True, False)}
    dictionaries = Model(*train_dictionaries(train[True], train[False]), (0.0,) * bins, 0.0, 0.0)
    counts = {kind: np.zeros(bins) for kind in (True, False)}
    seen = []
    for text, toxic, fold in rows:
        if fold:
            parts = [w for words in words_of(text) for w in windows(words)]
            found = np.bincount(_slot(dictionaries.gains(parts)), minlength=bins)
            counts[toxic] += found
            seen.append((found, toxic))
    evidence = gain_evidence(counts[True], counts[False])
    sums = np.clip([f @ np.array(evidence) for f, _ in seen], LEAST_EVIDENCE, MOST_EVIDENCE)
    line = logistic_line(sums, np.array([t for _, t in seen], float))
    return Model(dictionaries.ordinary, dictionaries.toxic, evidence, *line)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_rows(training_rows(docs, labels))


# -- scoring -------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``score``, ``evidence``, ``n_windows`` and ``worst_window`` of every row.

    ``worst_window`` is the window with the most evidence for toxicity, null if there is none.
    """
    source = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    out = (
        f"row {source.schema['row'].dataType.simpleString()}, score double, evidence double, "
        "n_windows bigint, worst_window string"
    )
    schema = to_arrow_schema(StructType.fromDDL(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = shared.value
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                raw, offsets = wa.text_bytes(part.column("text"))
                data = raw.tobytes()
                rated = [rater.rate(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                sums = np.array([r[0] for r in rated])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").cast(schema.field("row").type),
                        pa.array(rater.probability(sums)),
                        pa.array(sums),
                        pa.array([r[1] for r in rated], pa.int64()),
                        pa.array([r[2].strip().decode("utf-8", "replace") or None for r in rated], pa.string()),
                    ],
                    schema=schema,
                )

    return source.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
