"""Similar documents by the Jaccard similarity of word 5-shingles, at least 0.8, through signature trees.

Equal shingle sets are one class. Two similar sets share one of the first fifth of their shingles in any common
order (the prefix), so the classes that share a prefix shingle meet in a cell. Cells with the same smallest class are one, as
texts that share a passage share many shingles. Shingles frequent in a bounded sample come
last in the order, which keeps cells small. Signature trees run inside blocks of cells:

1. Classes with an equal minimum hash are joined in blocks with their sets, which links most groups of near copies.
2. Cells that still hold several components are searched with bitmaps only. First each class and foreign component
   gives one pair, and after these are verified and merged, cells that held back others give all pairs left.

Pairs inside one component are never made, so a group of copies costs as much as its size. Cells of any size are cut into blocks,
and blocks that a tree can't tell apart meet pair by pair; no cell is held in one task, and none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import signature_tree as tree
from clearwake.llm import word_arrays as wa
from clearwake.llm.components import components
from clearwake.plans.registry import table
from clearwake.session import cut_lineage

SHINGLE = 5
#: Documents whose shingles are counted to find frequent ones, and the count from which one is frequent.
SAMPLE_DOCS, FREQUENT = 4_000, 12
ROUNDS = 2
#: Classes of one block; a larger cell is cut.
BLOCK = 1_024
#: Rows that one call works on, about; small blocks go together.
BUNDLE_ROWS = 2_000
#: Up to so many wanted classes are broadcast to the texts; beyond, both are joined by shuffle.
BROADCAST_CLASSES = 300_000
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text starts."""
    raw, offsets = wa.text_bytes(texts)
    words = wa.split_words(raw, offsets, wa.NOT_SPACE, wa.LOWER)
    hashes, counts = words.hashes(), words.counts
    starts = wa.windows(words, SHINGLE)
    rows, shingles = [words.row_of[starts]], [wa.window_hashes(hashes, starts, SHINGLE)]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        rows.append(short)
        shingles.append(wa.window_hashes(hashes, words.rows[short], size))
    row, shingle = np.concatenate(rows), np.concatenate(shingles)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first, last in wa.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            yield part, *shingle_sets(part.column("text"))


def _longs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values.view(np.int64))).cast(
        pa.list_(pa.int64())
    )


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many sampled documents have. They only order shingles; results don't depend on them."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    schema = pa.schema([("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shingles, bounds in _batches(batches):
            yield pa.RecordBatch.from_arrays([_longs(shingles, bounds)], schema=schema)

    sampled = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(step)) == 0).select("text")
    counted = sampled.mapInArrow(run, "shingles array<bigint>").select(F.explode("shingles").alias("shingle")).groupBy(
        "shingle"
    ).agg(F.count(F.lit(1)).alias("n"))
    # at most the shingles of the sample by FREQUENT
    found = counted.where(F.col("n") >= FREQUENT).select("shingle").toArrow()
    return np.sort(np.asarray(found.column("shingle").combine_chunks()).astype(np.int64).view(np.uint64))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest`` of every row; the digest of an empty set is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles, bounds in _batches(batches):
            digests = [_digest(shingles[a:b]) if a < b else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(digests, pa.binary())],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary"
    )


def of_classes(docs: DataFrame, wanted: DataFrame, make, fields: str) -> DataFrame:
    """What ``make`` gives for the set of each class in ``wanted`` (``doc_id, digest`` and more, which are kept).

    Sets are computed anew from the texts, which costs less than storing them all. Rows that repeat an id and
    its text give their class more than once.
    """
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    keep = [c for c in wanted.columns if c not in ("doc_id", "digest")]
    out = ", ".join([f"{c} {wanted.schema[c].dataType.simpleString()}" for c in keep] + [fields])
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles, bounds in _batches(batches):
            sets = [shingles[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            # an id may stand for several texts
            own = [i for i, d in enumerate(part.column("digest").to_pylist()) if len(sets[i]) and _digest(sets[i]) == d]
            made = [make(sets[i]) for i in own]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c).cast(schema.field(c).type).take(pa.array(own, pa.int64())) for c in keep),
                    *(pa.array([m[k] for m in made], f.type) for k, f in enumerate(list(schema)[len(keep) :])),
                ],
                schema=schema,
            )

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")
    return found.select("text", "digest", *keep).mapInArrow(run, out)


def class_features(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``node, n, prefix, lows, bits`` of every class: size, first shingles, minimum hashes and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(own: np.ndarray) -> tuple:
        common, length = shared.value, len(own) - -(-4 * len(own) // 5) + 1
        late = np.zeros(len(own), bool)
        if len(common):
            late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        rare = own[~late]
        first = rare if len(rare) >= length else np.concatenate([rare, own[late]])
        lows = np.array([wa.mix(own ^ seed).min() for seed in _SEEDS[:ROUNDS]], np.uint64)
        return len(own), first[:length].view(np.int64), lows.view(np.int64), tree.bitmap(own).tobytes()

    return of_classes(docs, classes, make, "n bigint, prefix array<bigint>, lows array<bigint>, bits binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


_EDGES = "a bigint, b bigint"
_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, list]]]:
    """The blocks of a bundle: whole-number columns as arrays, binary ones as 64-bit words; one row per node."""
    bundle = pa.Table.from_batches(list(batches))
    whole = {n: np.asarray(bundle.column(n).combine_chunks()) for n in bundle.column_names if bundle.schema.field(n).type != pa.binary()}
    binary = {n: bundle.column(n).combine_chunks() for n in bundle.column_names if n not in whole}
    order = np.lexsort([whole["node"], *(whole[k] for k in reversed(keys))])
    changes = np.zeros(len(order), bool)
    for k in keys:
        changes[1:] |= whole[k][order][1:] != whole[k][order][:-1]
    for rows in np.split(order, np.flatnonzero(changes)):
        # a class may come more than once
        rows = rows[np.concatenate([[True], whole["node"][rows][1:] != whole["node"][rows][:-1]])]
        if len(rows) > 1:
            yield (
                {n: v[rows] for n, v in whole.items()},
                {n: [np.frombuffer(v[i].as_buffer(), np.uint64) for i in rows.tolist()] for n, v in binary.items()},
            )


def _edges(found: list[tuple[int, int]]) -> list[pa.Array]:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return [pa.array(pairs.min(1, initial=2**62)), pa.array(pairs.max(1, initial=-1))]


def _link_bundle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block, verified on the sets; only those that join two groups."""
    found = []
    for numbers, words in _blocks(batches, ["round", "low", "block"]):
        nodes, sets = numbers["node"].tolist(), words["shingles"]
        group = np.arange(len(nodes))
        root = tree.build(np.array([len(x) for x in sets]), [tree.bitmap(x) for x in sets])
        for left, right, _ in tree.pairs(root, root, group):
            for i, j in zip(left.tolist(), right.tolist()):
                if group[i] != group[j] and similar(sets[i], sets[j]):
                    found.append((nodes[i], nodes[j]))
                    group[group == group[j]] = group[i]
    wa.release()
    yield pa.RecordBatch.from_arrays(_edges(found), schema=_EDGE_SCHEMA)


_CANDIDATES = "a bigint, b bigint, cell bigint"


def _candidates(best_only: bool):
    """Pairs ``a, b`` of a block (one cell part, or two of them) that bitmaps and sizes allow. With ``best_only`` one for
    each class and foreign component; a cell that holds back others is named in a row of its own."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        fuller = set()
        for numbers, words in _blocks(batches, ["cell", "low", "high"]):
            nodes, sizes, side, bits = numbers["node"].tolist(), numbers["n"], numbers["side"], words["bits"]
            group = np.unique(numbers["component"], return_inverse=True)[1]
            roots = []
            for one in np.unique(side).tolist():
                chosen = np.flatnonzero(side == one)
                roots.append(_placed(tree.build(sizes[chosen], [bits[i] for i in chosen]), chosen))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            seen = 0
            for left, right, bound in tree.pairs(roots[0], roots[-1], group):
                seen += len(left)
                for i, j, most in zip(left.tolist(), right.tolist(), bound.tolist()):
                    if not best_only:
                        found.append((nodes[i], nodes[j]))
                        continue
                    # of equal chances the smaller node, so that the outcome doesn't hang on the order
                    for x, y in ((i, j), (j, i)):
                        place, value = (x, int(group[y])), (most, -nodes[y], y)
                        if place not in best or best[place] < value:
                            best[place] = value
            chosen_pairs = {(min(x, y), max(x, y)) for (x, _), (_, _, y) in best.items()}
            found += [(nodes[x], nodes[y]) for x, y in chosen_pairs]
            if best_only and len(chosen_pairs) < seen:
                fuller.add(int(numbers["cell"][0]))
        found = list(set(found))
        wa.release()
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.concat_arrays([x, pa.nulls(len(fuller), pa.int64())]) for x in _edges(found)),
                pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(sorted(fuller), pa.int64())]),
            ],
            schema=schema,
        )

    return run


def _placed(root: tree.Node, chosen: np.ndarray) -> tree.Node:
    """The tree with members numbered as in the whole block."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.members = chosen[node.members]
        stack += node.children
    return root


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return of_classes(docs, wanted, lambda own: (own.tobytes(),), "shingles binary")


def _check_bundle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among the pairs (``node, partners``) of some groups."""
    sets: dict[int, np.ndarray] = {}
    partners: dict[int, list[int]] = {}
    for batch in batches:
        for node, others, shingles in zip(*(batch.column(c) for c in ("node", "partners", "shingles"))):
            sets[node.as_py()] = np.frombuffer(shingles.as_buffer(), np.uint64)
            partners[node.as_py()] = others.as_py() or []
    kept = [(a, b) for a, others in partners.items() for b in others if similar(sets[a], sets[b])]
    sets.clear()
    wa.release()
    yield pa.RecordBatch.from_arrays(_edges(kept), schema=_EDGE_SCHEMA)


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("left"), batch.column("right")
        kept = [
            (a[i], b[i])
            for i in range(batch.num_rows)
            if similar(*(np.frombuffer(side[i].as_buffer(), np.uint64) for side in (left, right)))
        ]
        yield pa.RecordBatch.from_arrays(_edges(kept), schema=_EDGE_SCHEMA)


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The links among the pairs. Each set is sent once to its group of connected pairs; pairs of groups too large
    for one call are joined with their sets one by one."""
    groups = cut_lineage(components(pairs))
    small = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= BLOCK)
    inside = groups.join(small, "component", "left").select("node", F.when(F.col("size").isNotNull(), F.col("component")).alias("component"))
    few = inside.where(F.col("component").isNotNull())
    # within such a group, so BLOCK at most
    partners = (
        pairs.withColumnRenamed("a", "node").join(few.select("node"), "node", "left_semi")
        .groupBy("node").agg(F.collect_list("b").alias("partners"))
    )
    grouped = few.join(partners, "node", "left").join(classes, "node")
    grouped = cut_lineage(grouped)
    checked = (
        _sets(docs, grouped)
        .groupBy(_bundle(["component"], 4 * grouped.count()))
        .applyInArrow(_check_bundle, _EDGES)
    )
    large = cut_lineage(inside.where(F.col("component").isNull()).select("node").join(classes, "node"))
    if large.limit(1).count():
        sets = cut_lineage(_sets(docs, large))
        sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b"
        )
        checked = checked.unionByName(sided.select("a", "b", "left", "right").mapInArrow(_check_pairs, _EDGES))
    return checked.distinct()


def _bundle(keys: list[str], rows: int) -> F.Column:
    """A number that puts about ``BUNDLE_ROWS`` rows together and keeps blocks whole."""
    return F.pmod(F.xxhash64(*keys), F.lit(max(64, -(-rows // BUNDLE_ROWS)))).alias("bundle")


def _first_blocks(lows: DataFrame) -> DataFrame:
    """``round, low, block, node``: classes with an equal minimum hash, in parts of about ``BLOCK``."""
    sizes = lows.groupBy("round", "low").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    parts = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    return lows.join(sizes, ["round", "low"]).select(
        "round", "low", F.pmod(F.xxhash64("node"), parts).cast("int").alias("block"), "node"
    )


def _cell_candidates(cells: DataFrame, bits: DataFrame, labels: DataFrame, best_only: bool) -> DataFrame:
    """``_candidates`` of the cells that hold several components, over all blocks."""
    placed = cells.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("cell").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members")
    ).where(F.col("least") != F.col("most"))
    parts = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    split = placed.join(mixed, "cell").select(
        "cell", "node", "component", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("block")
    )
    # each part meets itself and every other part of its cell
    met = split.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "cell",
        "node",
        "component",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    return (
        met.join(bits, "node")
        .groupBy(_bundle(["cell", "low", "high"], cells.count()))
        .applyInArrow(_candidates(best_only), _CANDIDATES)
    )


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row features, and ``digest, component_id`` of every class."""
    narrow = docs.select("doc_id", "text")
    rows = cut_lineage(set_digests(narrow)).withColumn("node", F.monotonically_increasing_id())
    classes = cut_lineage(
        rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "node")).alias("first"))
        .select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.node").alias("node"))
    )
    leading = cut_lineage(class_features(narrow, classes, frequent_shingles(narrow)))
    sharing = Window.partitionBy("shingle")
    cells = (
        leading.select("node", F.explode("prefix").alias("shingle"))
        .select("node", F.min("node").over(sharing).alias("cell"), F.max("node").over(sharing).alias("last"))
        .where(F.col("cell") < F.col("last"))
        .select("cell", "node")
        .distinct()
    )
    # members without any other of a size that allows a link leave their cell
    by_size = Window.partitionBy("cell").orderBy("n", "node")
    near = (4 * F.col("n") <= 5 * F.lag("n").over(by_size)) | (4 * F.lead("n").over(by_size) <= 5 * F.col("n"))
    cells = cut_lineage(
        cells.join(leading.select("node", "n"), "node").withColumn("near", near).where("near").select("cell", "node")
    )
    bits = leading.select("node", "n", "bits")
    lows = leading.select("node", F.posexplode("lows").alias("round", "low"))
    blocks = _first_blocks(lows).groupBy("node").agg(F.collect_list(F.struct("round", "low", "block")).alias("places"))
    placed = cut_lineage(classes.join(blocks, "node"))
    edges = cut_lineage(
        _sets(narrow, placed)
        .select("node", "shingles", F.inline("places"))
        .groupBy(_bundle(["round", "low", "block"], 4 * placed.count()))
        .applyInArrow(_link_bundle, _EDGES)
        .distinct()
    )
    labels = components(edges)
    for best_only in (True, False):
        found = cut_lineage(_cell_candidates(cells, bits, labels, best_only))
        pairs = cut_lineage(found.where(F.col("cell").isNull()).select("a", "b").distinct())
        more = cut_lineage(_verify(narrow, pairs, classes))
        if more.limit(1).count():
            edges = cut_lineage(edges.unionByName(more).distinct())
            labels = components(edges)
        fuller = found.where(F.col("cell").isNotNull()).select("cell").distinct()
        if not fuller.limit(1).count():
            break
        cells = cells.join(fuller, "cell", "left_semi")
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows, cut_lineage(named.join(smallest, "component").select("digest", "component_id"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    The component of a document is named by the smallest doc_id that links reach. A null or empty text, or one without words,
    has no shingles and its own id as component. Repeated rows are one class. A null id is linked with nothing and
    has no component. Shingles count as equal if their 64-bit hashes are.
    """
    rows, named = linked(docs)
    own = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return own.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows with a null id all stay."""
    found = similar_documents(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(kept)
    single = docs.join(kept.where(F.col("n") == 1), "doc_id", "left_semi")
    repeated = docs.join(kept.where(F.col("n") > 1), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
