"""Balanced contiguous shards: the smallest capacity that a greedy cut can keep.

Equal texts form one atomic group. Groups are ordered by the digest of their text, which spreads
them evenly and needs no sampling. A capacity is feasible if filling shards greedily, in that
order, needs no more than the wanted number of shards. The smallest feasible one is found
by search over prefix sums that stay in Spark; only the cut positions, and a bounded number
of prefix sums around them, reach the driver. As shards are ranges of digests, a row finds its shard by
comparison with the cut digests, without a join.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwake.plans.registry import table
from clearwake.session import cut_lineage

SHARDS = 16
#: Capacities that one round over the stored prefix sums tries.
CANDIDATES = 16
#: Prefix sums near the cuts are brought to the driver when at most so many are left.
LOCAL_SUMS = 100_000
#: Groups that one window orders; digests give at most 16 ** 4 windows.
WINDOW_GROUPS = 50_000
SLOT_ROWS = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest``. A null text has size 1 and a digest of its own."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("")).alias("digest"),
    )


def prefix_sums(rows: DataFrame) -> DataFrame:
    """One row per group in digest order: ``digest, bytes, upto`` (bytes up to and with it)."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    digits, count = 2, rows.count()
    while digits < 4 and count > WINDOW_GROUPS * 16**digits:
        digits += 1
    groups = groups.withColumn("bucket", F.substring("digest", 1, digits))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16 ** 4 rows
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).select(
        "bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(F.broadcast(totals), "bucket").select(
        "digest", "bytes", (F.col("offset") + F.sum("bytes").over(inside)).alias("upto")
    )


def _cuts(sums: DataFrame, capacities: Sequence[int], shards: int, total: int) -> list[list[int]]:
    """Greedy cut positions for several capacities, one small aggregation per shard."""
    found: list[list[int]] = [[] for _ in capacities]
    reached = [0] * len(capacities)
    for _ in range(shards):
        limits = [r + c for r, c in zip(reached, capacities)]
        picks = [
            F.max(F.when(F.col("upto") <= limit, F.col("upto"))).alias(f"c{i}") for i, limit in enumerate(limits)
        ]
        near = sums.where((F.col("upto") >= min(reached)) & (F.col("upto") <= max(limits)))
        row = near.agg(*picks).first()
        reached = [max(r, row[f"c{i}"] or 0) for i, r in enumerate(reached)]
        for one, position in zip(found, reached):
            one.append(position)
        if all(r == total for r in reached):
            break
    return [[*one, *[one[-1]] * (shards - len(one))] for one in found]


def smallest_cuts(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cut positions."""
    top = sums.agg(F.max("upto").alias("total"), F.max("bytes").alias("largest")).first()
    if top["total"] is None:
        return 0, [0] * shards
    total, largest = int(top["total"]), int(top["largest"])
    low, high = max(largest, -(-total // shards)), total // shards + largest + 1
    # where cut j can lie for capacities from low to high
    floor = [max(0, (j + 1) * (low - largest)) for j in range(shards)]
    ceiling = [min(total, (j + 1) * high) for j in range(shards)]
    while True:
        near = F.col("upto") == total
        for a, b in zip(floor, ceiling):
            near = near | F.col("upto").between(a, b)
        kept = sums.where(near).select("upto")
        if low == high or kept.limit(LOCAL_SUMS + 1).count() <= LOCAL_SUMS:
            break
        step = max(1, (high - low) // CANDIDATES)
        tried = [c for c in (low + step * i for i in range(CANDIDATES)) if c < high]
        for capacity, cuts in zip(tried, _cuts(sums, tried, shards, total)):
            if cuts[-1] == total:
                high, ceiling = capacity, cuts
                break
            low, floor = capacity + 1, cuts
    if low == high:
        return low, _cuts(sums, [low], shards, total)[0]
    known = sorted(r["upto"] for r in kept.collect())

    def greedy(capacity: int) -> list[int]:
        cuts, reached = [], 0
        for _ in range(shards):
            at = bisect_right(known, reached + capacity)
            reached = max(reached, known[at - 1] if at else 0)
            cuts.append(reached)
        return cuts

    while low < high:
        middle = (low + high) // 2
        if greedy(middle)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low, greedy(low)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row with its shard and its place there.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the bytes of the
    text plus 1. Rows of equal texts share a shard; a null text is a group apart from the
    empty one. Repeated rows and rows without an id are kept, each with a slot of its own. Slots follow
    a hash of the id, so no group is ordered in one task. An empty table gives no rows.
    """
    rows = cut_lineage(sized(docs))
    sums = cut_lineage(prefix_sums(rows))
    _, cuts = smallest_cuts(sums, shards)
    edges = [r["digest"] for r in sums.where(F.col("upto").isin(sorted(set(cuts)))).orderBy("upto").collect()]
    shard = F.lit(0)
    for edge in edges[:-1]:
        shard = shard + (F.col("digest") > edge).cast("int")
    salts = max(64, -(-rows.count() // SLOT_ROWS))
    placed = rows.withColumns(
        {"shard": shard, "salt": F.pmod(F.xxhash64("doc_id", "digest"), F.lit(salts))}
    )
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "digest")
    return placed.withColumn("rank", F.row_number().over(order)).join(offsets, ["shard", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)
