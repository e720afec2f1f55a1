"""Quality rules whose limits follow each language and source.

Counts per document are turned into whole-number measures. A quantile sketch per language and source counts
documents per rounded value (five leading bits kept), so sketches merge by adding counts and give the same
limits however the data is split. Limits are then joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table
from clearwake.session import cut_lineage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A line that recurs in a text of fewer lines counts as in a text of so many.
FEW_LINES = 10
#: A limit lies so many spreads beyond the upper (or lower) quartile ...
SPREADS = 4
#: ... where a spread is the distance of the quartiles, but at least this, in thousandths: (measure, least spread, lower limit too).
MEASURES = (
    ("symbol_rate", 60, False),
    ("dup_line_rate", 60, False),
    ("repeat_rate", 60, False),
    ("upper_rate", 40, False),
    ("word_length", 1000, True),
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """``COUNTS`` of each text, one array per count."""
    raw, offsets = wa.text_bytes(texts)
    words = wa.split_words(raw, offsets, wa.NOT_SPACE)
    lines = wa.split_words(raw, offsets, wa.NOT_NEWLINE)
    inside = np.concatenate([[0], np.cumsum(wa.NOT_SPACE[raw])])
    worded = inside[lines.end] > inside[lines.begin]
    line_row = lines.row_of[worded]
    n_lines = np.bincount(line_row, minlength=len(texts))
    keys = np.unique(line_row * (len(lines.vocabulary) + 1) + lines.codes[worded])
    distinct = np.bincount(keys // (len(lines.vocabulary) + 1), minlength=len(texts))
    covered = np.zeros(len(words.codes) + 1, np.int64)
    starts = wa.windows(words, REPEAT_WINDOW)
    if len(starts):
        ranks = wa.window_ranks(words, starts, REPEAT_WINDOW)
        twice = starts[np.bincount(ranks)[ranks] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    return [
        words.counts,
        wa.per_row(wa.NOT_SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
        wa.per_row(_SYMBOL[raw], offsets),
        n_lines,
        n_lines - distinct,
        wa.per_row(repeated, words.rows),
        wa.per_row(_UPPER[raw], offsets),
    ]


def count_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The ``keep`` columns and ``COUNTS``. A null text counts as empty."""
    columns = list(dict.fromkeys([*keep, "text"]))
    out = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in COUNTS]
    )
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                counts = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).cast(schema.field(c).type) for c in keep),
                        *(pa.array(c.astype(np.int64)) for c in counts),
                    ],
                    schema=schema,
                )

    return docs.select(*columns).mapInArrow(run, out)


def _rate(part: str, whole: str) -> Column:
    """Thousandths, rounded down; 0 of nothing."""
    return F.coalesce(F.expr(f"{part} * 1000 div nullif({whole}, 0)"), F.lit(0)).cast("long")


def with_measures(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumns(
        {
            "base_failed": failed,
            "symbol_rate": _rate("n_symbols", "n_words"),
            "dup_line_rate": _rate("n_dup_lines", f"greatest(n_lines, {FEW_LINES})"),
            "repeat_rate": _rate("n_repeat_words", "n_words"),
            "upper_rate": _rate("n_upper", "word_chars"),
            "word_length": _rate("word_chars", "n_words"),
        }
    )


def _rounded(value: str) -> str:
    """SQL for a value with only its five leading bits; the same in both dialects."""
    shift = f"greatest(length(bin({value})) - 5, 0)"
    return f"(({value} >> {shift}) << {shift})"


def sketches(measured: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``keys, measure, value, n``: how many documents round to the value. Sketches of parts merge by adding ``n``."""
    stacked = ", ".join(f"'{m}', {m}" for m, _, _ in MEASURES)
    return (
        measured.selectExpr(*keys, f"stack({len(MEASURES)}, {stacked}) as (measure, exact)")
        .selectExpr(*keys, "measure", f"cast({_rounded('exact')} as bigint) as value")
        .groupBy(*keys, "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketch: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per ``keys``: ``<measure>_most`` and, where there is one, ``<measure>_least``."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})
    # the smallest value that a quarter (three quarters) of the documents don't exceed
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("value"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("value"))).alias("high"),
    )
    columns = []
    for name, least, both in MEASURES:
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(least))
        own = F.col("measure") == name
        columns.append(F.max(F.when(own, F.col("high") + SPREADS * spread)).alias(f"{name}_most"))
        if both:
            columns.append(F.max(F.when(own, F.col("low") - SPREADS * spread)).alias(f"{name}_least"))
    return quartiles.groupBy(*keys).agg(*columns)


def judge(measured: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``measured`` with ``kept``: false if ``base_failed`` or beyond a limit of its group."""
    other = found.select(
        *(F.col(k).alias(f"_{k}") for k in keys), *(c for c in found.columns if c not in keys)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    fine = ~F.col("base_failed")
    for name, _, both in MEASURES:
        fine = fine & (F.col(name) <= F.col(f"{name}_most"))
        if both:
            fine = fine & (F.col(name) >= F.col(f"{name}_least"))
    return measured.join(other, same, "left").select(*measured.columns, fine.alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts and measures, ``base_failed`` and ``kept`` of every row.

    A null or empty text has no words and fails. A null language or source is a group of its own. Repeated rows
    count as often as they occur. An empty table gives no rows.
    """
    measured = cut_lineage(with_measures(count_documents(docs)))
    return judge(measured, limits(sketches(measured)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS exact FROM measured" for m, _, _ in MEASURES)
    most = ", ".join(
        f"max(high + {SPREADS} * greatest(high - low, {s})) FILTER (measure = '{m}') AS {m}_most"
        + (f", max(low - {SPREADS} * greatest(high - low, {s})) FILTER (measure = '{m}') AS {m}_least" if both else "")
        for m, s, both in MEASURES
    )
    fine = " AND ".join(f"{m} <= {m}_most" + (f" AND {m} >= {m}_least" if both else "") for m, _, both in MEASURES)
    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windowed AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windowed QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM split LEFT JOIN repeats USING (doc_id)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) AS symbol_rate,
         coalesce(n_dup_lines * 1000 // greatest(n_lines, {FEW_LINES}), 0) AS dup_line_rate,
         coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeat_rate,
         coalesce(n_upper * 1000 // nullif(word_chars, 0), 0) AS upper_rate,
         coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS word_length
  FROM counted),
sketch AS (
  SELECT lang, source, measure, {_rounded("exact")} AS value, count(*) AS n
  FROM (SELECT lang, source, measure, CAST(exact AS BIGINT) AS exact FROM ({stacked})) GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY value) AS upto,
         sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM sketch),
quartiles AS (
  SELECT lang, source, measure, min(value) FILTER (4 * upto >= total) AS low, min(value) FILTER (4 * upto >= 3 * total) AS high
  FROM ranked GROUP BY ALL),
limits AS (SELECT lang, source, {most} FROM quartiles GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept
FROM measured m JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""


SQL = _sql()
