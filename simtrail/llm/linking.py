"""Shared pieces of the near-duplicate operators.

``counter_table``  a fixed-width table of hashed counts, summed over the cluster
``bloom``          a fixed-width filter of the keys that a later scan should pass on
``star_pairs``     every member of a bucket with the bucket's most central member
``open_members``   what the stars left apart: members of buckets with several components
``dealt``          those members in groups of two bounded blocks, for comparison across components
``components``     connected components by alternating stars
``merged``         components after some more links between components
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from simtrail.session import discard, materialize

CHUNK = 8192
# Edges that a task turns into stars at a time.
STARRED_EDGES = 1 << 20


def chunk_rows(counts: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """A counter table, or the part of one from counter ``first`` on, as rows (chunk number, its counters)."""
    parts = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array((used + first // CHUNK).astype(np.int32)),
            pa.array([parts[i].astype(counts.dtype.newbyteorder("<")).tobytes() for i in used], pa.binary()),
        ],
        ["chunk", "counts"],
    )


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            # Counters of any width; their sums have 64 bits.
            got = np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)
            if chunk in held:
                held[chunk] += got
            else:
                held[chunk] = got
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            ["chunk", "counts"],
        )


def counter_table(chunks: DataFrame, width: int) -> np.ndarray:
    """Sum of all chunk rows: ``width`` counters on the driver, whatever the data.

    Chunks are hash-dealt and summed as a stream; a task holds no more than
    the sums of its own chunks.
    """
    summed = chunks.repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    out = np.zeros(width, np.int64)
    for row in summed.toLocalIterator():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return out


def _bits_of(width: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, dtype=bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits[bloom_slots(h, width)] = True
        yield chunk_rows(np.packbits(bits).view("<i8"))

    return fill


def bloom_slots(h: np.ndarray, width: int) -> np.ndarray:
    """Two slots a hash, one after another."""
    m = np.uint64(width - 1)
    return np.concatenate([(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7) & m, (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(9) & m]).astype(np.int64)


def _or_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            got = np.frombuffer(raw, "<i8")
            held[chunk] = held[chunk] | got if chunk in held else got
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            ["chunk", "counts"],
        )


BLOOM_BITS = 1 << 23


def bloom(hashes: DataFrame, width: int = BLOOM_BITS) -> np.ndarray:
    """Bloom filter (1 MB at the default width) of a one-column table of hashes.

    Its size is fixed, so it may always be broadcast; on more keys than it
    has room for it passes more rows, and the exact join that follows every
    use drops them.
    """
    chunks = hashes.mapInArrow(_bits_of(width), "chunk int, counts binary")
    merged = chunks.repartition("chunk").mapInArrow(_or_chunks, "chunk int, counts binary")
    words = np.zeros(width // 64, np.int64)
    for row in merged.toLocalIterator():
        words[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return words.view(np.uint8)


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    slots = bloom_slots(h, len(bits) * 8)
    hit = (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
    return (hit[: len(h)] & hit[len(h) :]).astype(bool)


def centrality(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, score): the sizes of all buckets of each member."""
    return members.select("bucket", "id").join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("score"))


def star_pairs(members: DataFrame, sizes: DataFrame, also: list[str] | None = None, keep=None) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's most central member.

    ``members``: (bucket, id, columns of ``also``); ``sizes``: (bucket, n).
    The member whose buckets are largest in all is the most central one: in a
    group of near copies that is a text with few changes, to which most others
    are similar.  At most one pair a member and bucket, so a bucket that holds
    a third of all rows stays linear.  ``keep`` is a condition on the columns
    ``also`` of both sides (prefixes ``a_`` and ``b_``).  ``members`` that carry
    their ``score`` already are not joined with it (``sizes`` is not read then).
    """
    also = also or []
    scored = members
    if "score" not in members.columns:
        scored = members.join(centrality(members, sizes), "id")
    lead = scored.groupBy("bucket").agg(
        F.max(F.struct("score", (-F.col("id")).alias("least"), *also)).alias("lead")
    )
    pairs = members.join(lead, "bucket").select(
        (-F.col("lead.least")).alias("a"),
        F.col("id").alias("b"),
        *[F.col(f"lead.{c}").alias(f"a_{c}") for c in also],
        *[F.col(c).alias(f"b_{c}") for c in also],
    )
    pairs = pairs.where("a != b")
    if keep is not None:
        pairs = pairs.where(keep)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with ``comp``, ``main`` (the bucket's most frequent component) and ``n``, of buckets with several components.

    Members that the first pass linked together are not compared again; what
    is left is written once.
    """
    own = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = own.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mains = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("n"))
        .where("comps > 1")
        .select("bucket", F.col("m.comp").alias("main"), "n")
    )
    return materialize(own.join(mains, "bucket"), "open-buckets")


def dealt(members: DataFrame, block_size: int) -> DataFrame:
    """``open_members`` dealt to groups (bucket, lo, hi) of two blocks, so that all pairs of different components meet.

    Members of a bucket's main component need not meet each other: they lie in
    blocks of their own, and only the blocks of the other members (``rest``)
    are joined with every block.  So a bucket that is one component but for r
    members makes about (r / block + 1) copies of each row, not n / block.
    """
    outside = F.col("comp") != F.col("main")
    rest = members.where(outside).groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_size).alias("__rest"))
    placed = members.join(rest, "bucket")
    mains = F.ceil((F.col("n") - 1) / block_size)  # at least one member is outside
    own = F.pmod(F.xxhash64("id"), F.when(outside, F.col("__rest")).otherwise(F.greatest(mains, F.lit(1))))
    # Blocks 0 .. rest - 1 hold the members outside, later ones the main component.
    block = F.when(outside, own).otherwise(own + F.col("__rest"))
    last = F.when(outside, F.col("__rest") + F.greatest(mains, F.lit(1)) - 1).otherwise(F.col("__rest") - 1)
    return (
        placed.withColumns({"block": block, "__last": last})
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), "__last")))
        .withColumns({"lo": F.least("block", "__other"), "hi": F.greatest("block", "__other")})
        .drop("__rest", "__last", "__other", "main", "n")
    )


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after ``links`` (ca, cb) between components; ids without a label are their own."""
    more = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    up = more.select(F.col("node").alias("comp"), F.col("comp").alias("__up"))
    moved = labels.join(up, "comp", "left").select("node", F.coalesce("__up", "comp").alias("comp"))
    # Components of one node have no label yet.
    return moved.unionByName(more.join(labels, "node", "left_anti"))


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: edges (u, v) as stars around the least node of whatever they connect, some of a task's edges at a time."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        edges = np.concatenate([np.empty((2, 0), np.int64), *held], axis=1)
        nodes, at = np.unique(edges, return_inverse=True)
        u, v = at.reshape(edges.shape)
        least = np.arange(len(nodes))
        while True:
            before = least.copy()
            low = np.minimum(least[u], least[v])
            for end in (u, v):
                np.minimum.at(least, least[end], low)
            least = least[least]
            if (least == before).all() and (least[u] == least[v]).all():
                break
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("u", "v")]))
        if sum(x.shape[1] for x in held) > STARRED_EDGES:
            yield stars()
            held = []
    yield stars()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): ``comp`` is the least node of each connected component.

    What a task's edges connect becomes a star first; edges that one task may
    hold (``STARRED_EDGES``) are done with that.  For more, alternating
    large-star and small-star steps; every round is written to
    the shared checkpoint folder, so a lost executor never replays earlier
    rounds.  All nodes with an edge are
    returned, the least ones too.
    """
    def labels_of(stars: DataFrame) -> DataFrame:
        roots = stars.select("v", F.col("v").alias("comp")).distinct()
        return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)

    def written(table: DataFrame) -> tuple[DataFrame, dict]:
        """The edges, written, and their number and sums, observed by the same job."""
        state = Observation()
        table = table.mapInArrow(_starred, "u long, v long").observe(
            state,
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("x"),
            F.sum(F.hash("u", "v").cast("long")).alias("s"),
        )
        return materialize(table, "edges"), state.get

    now, seen = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if not seen.get("n"):
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))

    if seen["n"] <= STARRED_EDGES:
        stars = materialize(now.coalesce(1).mapInArrow(_starred, "u long, v long"), "edges")
        discard(now)
        return labels_of(stars)

    for _ in range(max_rounds):
        # Large star: every larger neighbour is linked to the least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")
        # Small star: every node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before = now
        now, state = written(small)
        discard(before)
        if state == seen:
            return labels_of(now)
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
