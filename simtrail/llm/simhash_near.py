"""Operator 11: near-duplicate documents by SimHash, joined on segment bit counts.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
``SHINGLE``-word shingles.  Fingerprints link at ``MAX_BITS`` or fewer
differing bits; a component is everything reachable over links.

* Equal fingerprints are one node from the start (its id is the least doc_id),
  pre-aggregated in salted groups, so a third of all rows with one fingerprint
  are a handful of rows of the first shuffle.
* Embedding: a fingerprint is cut into 2-bit segments, each mapped to its bit
  count.  One changed bit moves one count by one, so the Manhattan distance of
  two count vectors is at most the number of differing bits.
* Grid range join: the segments form ``MAX_BITS // 3 + 1`` parts.  Of two
  linked fingerprints at least one part lies within a Manhattan distance of
  two.  In every part a fingerprint goes to its own grid cell and to the cells
  one count away; two vectors within a distance of two meet in a cell between
  them.  Cells are sorted and compared inside a task, exactly (differing bits).
* A cell gives the edges of a spanning forest, never all its pairs.  Members of
  a cell above ``CELL`` fingerprints are dealt out again in blocks, two blocks
  to a group, so no task holds more than two blocks of one cell.
* The components of the edges come from alternating stars over the cluster.

Defined results: null and word-less texts have fingerprint zero and link like
any other; rows that repeat a document are all returned; rows without doc_id
link like others, but a component's id is the least doc_id in it, null if
there is none; an empty table gives no rows.  Other columns are ignored.
doc_ids lie below 2^62.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm.linking import components
from simtrail.session import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SALTS = 64
# Fingerprints of one cell that a task compares; a block of a larger cell is half as long.
CELL = 1 << 15
SMALL = 64
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NO_ID = 1 << 62
_U = np.uint64


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, about a megabyte at a time."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: bits set in over half of the hashes of its shingles."""
    ones, n, tail, hashed = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for words in _words((text or "").encode()):
        words = tail + words
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts, line = (ends - lens).tolist(), b" ".join(words)
        ends = ends[shingle - 1 :].tolist()
        for first in range(0, len(ends), 1 << 16):
            spans = zip(starts[first : first + (1 << 16)], ends[first : first + (1 << 16)])
            h = np.array([hashed(line[a:b], seed) for a, b in spans], np.uint64)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if n == 0:
        return hashed(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _scan(shingle: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return scan


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, salt) of every row, written once; ``fp`` holds the 64 bits as a signed number."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_scan(shingle, seed), "doc_id long, fp long")
    return materialize(out.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "simhash")


def parts_of(max_bits: int) -> list[tuple[int, int]]:
    """(first segment, end) of each part: one of them is within a distance of two whenever all are within ``max_bits``."""
    n = max_bits // 3 + 1
    edges = [32 * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each, in one 64-bit number."""
    return fps - ((fps >> _U(1)) & _U(0x5555555555555555))


def _cells(max_bits: int):
    """Task function: every fingerprint with its grid cells, by part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            counts = segment_counts(fps)
            for part, (first, end) in enumerate(parts_of(max_bits)):
                mask = (1 << 2 * end) - (1 << 2 * first)
                own = (counts & _U(mask)) >> _U(2 * first)
                cell, of = [own], [np.arange(len(fps))]
                for i in range(end - first):
                    one, here = _U(1 << 2 * i), (own >> _U(2 * i)) & _U(3)
                    up, down = np.flatnonzero(here < 2), np.flatnonzero(here > 0)
                    cell += [own[up] + one, own[down] - one]
                    of += [up, down]
                of = np.concatenate(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(of), part, np.int32)),
                        pa.array(np.concatenate(cell).view(np.int64)),
                        pa.array(fps[of].view(np.int64)),
                        batch.column("id").take(pa.array(of)),
                    ],
                    ["part", "cell", "fp", "id"],
                )

    return deal


def _starred(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node reachable from each of ``n`` nodes over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _forest(fps: np.ndarray, first: int, end: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tree edges of the members ``first`` .. ``end``: a member reached once is not compared again."""
    left = np.arange(first, end)
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if near.any():
                got = left[near]
                left = left[~near]
                reached += got.tolist()
                yield np.full(len(got), at), got


def linked(starts: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that connect whatever links inside each group; groups begin at ``starts``."""
    ends = np.append(starts[1:], len(fps))
    size = ends - starts
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = (size > 1) & (size <= SMALL)
    at = np.repeat(starts[small], size[small]) + np.concatenate([np.arange(n) for n in size[small]] or [np.empty(0, np.int64)])
    end = np.repeat(ends[small], size[small])
    step, pairs = 1, []
    while len(at):
        inside = at + step < end
        at, end = at[inside], end[inside]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        pairs.append((near, near + step))
        step += 1
    if pairs:
        label = _starred(len(fps), np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        a.append(label[moved])
        b.append(moved)
    for i in np.flatnonzero(size > SMALL):
        for x, y in _forest(fps, int(starts[i]), int(ends[i]), max_bits):
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


_FOUND = "a long, b long, part int, cell long, block int, fp long"


def _close(keys: list[str], max_bits: int, limit: int):
    """Task function over rows sorted by ``keys``: edges (a, b); members of groups above ``limit`` with their block instead."""

    def edges(rows: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        a, b = linked(starts, rows["fp"].view(np.uint64), max_bits)
        a, b = rows["id"][a], rows["id"][b]
        n, out = len(a), [np.minimum(a, b), np.maximum(a, b)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, out), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
            ["a", "b", "part", "cell", "block", "fp"],
        )

    def members(rows: dict[str, np.ndarray], before: int) -> pa.RecordBatch:
        n = len(rows["id"])
        block = ((before + np.arange(n)) // max(limit // 2, 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["id"]), pa.nulls(n, pa.int64()), pa.array(rows["part"]), pa.array(rows["cell"]), pa.array(block), pa.array(rows["fp"])],
            ["a", "b", "part", "cell", "block", "fp"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dealt = None, 0  # rows of the last group; members of it already given out
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            n = len(rows["id"])
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                new[1:] |= rows[k][1:] != rows[k][:-1]
            starts = np.append(0, np.flatnonzero(new))
            if dealt:  # the group at the front is too large
                cut = int(starts[1]) if len(starts) > 1 else n
                yield members({c: v[:cut] for c, v in rows.items()}, dealt)
                dealt = 0 if cut < n else dealt + cut
                rows, starts = {c: v[cut:] for c, v in rows.items()}, starts[1:] - cut
            if len(starts) > 1:
                whole = {c: v[: starts[-1]] for c, v in rows.items()}
                sizes = np.diff(starts)
                for i in np.flatnonzero(sizes > limit):
                    yield members({c: v[starts[i] : starts[i + 1]] for c, v in whole.items()}, 0)
                kept = np.repeat(sizes <= limit, sizes)
                sizes = sizes[sizes <= limit]
                if len(sizes):
                    yield edges({c: v[kept] for c, v in whole.items()}, np.cumsum(sizes) - sizes)
            if len(starts):
                held = {c: v[starts[-1] :] for c, v in rows.items()}
                if len(held["id"]) > limit:
                    yield members(held, 0)
                    dealt = len(held["id"])
                    held = None
            else:
                held = None
        if held is not None and len(held["id"]):
            yield edges(held, np.zeros(1, np.int64))

    return scan


def links(groups: DataFrame, max_bits: int = MAX_BITS, limit: int = CELL) -> DataFrame:
    """(a, b): edges that connect all ``groups`` (fp, id; distinct fingerprints) within ``max_bits`` differing bits."""
    dealt = groups.mapInArrow(_cells(max_bits), "part int, cell long, fp long, id long")
    keys = ["part", "cell"]
    found = materialize(
        dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_close(keys, max_bits, limit), _FOUND), "simhash-cells"
    )
    edges = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("part", "cell", "block", "fp", F.col("a").alias("id"))
    if not large.isEmpty():
        blocks = large.groupBy(*keys).agg(F.max("block").alias("last"))
        other = F.explode(F.sequence(F.lit(0), "last")).alias("other")
        pairs = large.join(blocks, keys).select("*", other).select(
            *keys, "fp", "id", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
        )
        keys = [*keys, "lo", "hi"]
        more = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_close(keys, max_bits, max(2 * limit, 2)), _FOUND)
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def with_components(docs: DataFrame, *, max_bits: int = MAX_BITS, shingle: int = SHINGLE, limit: int = CELL) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    fps = fingerprints(docs, shingle)
    salted = fps.groupBy("fp", "salt").agg(F.min("doc_id").alias("id"))
    unnamed = F.lit(_NO_ID) + F.shiftrightunsigned("fp", 2)
    groups = salted.groupBy("fp").agg(F.min("id").alias("id")).select("fp", F.coalesce("id", unnamed).alias("id"))
    groups = materialize(groups, "simhash-groups")
    found = components(links(groups, max_bits, limit))
    classes = groups.join(found, groups["id"] == found["node"], "left").select("fp", F.coalesce("comp", "id").alias("comp"))
    # The class of a fingerprint goes to each of its salted groups, then to their rows.
    classes = salted.select("fp", "salt").join(classes, "fp")
    return fps.join(classes, ["fp", "salt"]).select("doc_id", "fp", F.when(F.col("comp") < _NO_ID, F.col("comp")).alias("component_id"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    out = with_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
