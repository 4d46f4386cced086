"""Operator 10: repeated byte strings, by previous factors within runs of equal suffixes.

A byte is repeated if a string of ``LENGTH`` bytes covers it that also starts
anywhere else in the corpus (the same document included; strings never cross
documents).  ``keep_first=True`` spares the first occurrence in (doc_id,
position) order and so removes only positions whose longest previous factor
reaches ``LENGTH``; the query removes every occurrence.

Suffix order over a whole corpus would need one sort of all positions, so
suffixes are first dealt into groups that hold everything they can match:

1. Winnowing: of the hashes of all ``LENGTH / 2``-byte grams, the least of
   every run that a ``LENGTH``-byte string spans is an anchor (rightmost on
   ties).  Equal strings hold an equal anchor at the same place.  About one
   position in a hundred is an anchor: (gram hash, hash of the context of up
   to ``LENGTH / 2`` bytes before and ``LENGTH`` from the anchor).
2. Only grams that occur twice go on.  Anchors with equal contexts are equal
   all through: counted, never compared.
3. Where a gram has different contexts, one of each is fetched and the
   suffixes that start before the anchor are ordered, truncated to ``LENGTH``
   bytes: suffixes that share them stand together as one run, in order of
   position.  The previous smaller position of all but a run's first is in the
   run: only those have a previous factor of that length.  The order of
   different runs does not matter for factors of that length, so runs are
   hash groups, and neighbours in a run are compared byte by byte before
   anything is marked.  Equal strings start equally far before their anchor, so
   a few such distances are ordered at a time and memory stays bounded.
4. A gram with more than ``GROUP_LIMIT`` different contexts (a passage common
   to very many documents) is not put in one task: its suffixes' ``LENGTH``-byte
   strings are counted across the cluster instead, by 128-bit hashes.  The
   result is the same.
5. Marked intervals are merged per document and cut out.

Defined results: null and empty texts have 0 bytes; texts shorter than
``LENGTH`` bytes stay whole; repeated rows are copies of each other; rows
without doc_id come first in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.linking import bloom, in_bloom
from simtrail.session import bound_batches, materialize

LENGTH = 400
GROUP_LIMIT = 4_000
# Contexts are taken in by about so many bytes, their suffixes ordered so many at a time.
CONTEXT_BYTES = 1 << 20
SUFFIXES = 1 << 17
# Text at a time: about 150 bytes of working memory a byte.
BLOCK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_2 = 0xC2B2AE3D27D4EB4F | 1
_VALUES = tv.mix64(np.arange(11, 267, dtype=np.uint64) * _U(0xA0761D6478BD642F))


class RollingHash:
    """Hashes of any span of a byte array in constant time each, after one pass."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data) + 1
        up = np.full(n, _U(base))
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:-1], dtype=np.uint64)])
        down = np.full(n, _U(pow(base, -1, 1 << 64)))
        down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tv.mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every ``size``-byte window."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        return tv.mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(grams: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Rightmost least gram of every valid run of ``width`` grams (a run is named by its start)."""
    out, step = [], 1 << 19
    for lo in range(0, len(valid), step):
        hi = min(lo + step, len(valid))
        if not valid[lo:hi].any():
            continue
        part = grams[lo : hi + width - 1]
        n = len(part)
        # The low 20 bits number the positions downwards, so a minimum is the rightmost one.
        key = (part & ~_U((1 << 20) - 1)) | (_U((1 << 20) - 1) - np.arange(n, dtype=np.uint64))
        padded = np.full(-(-n // width) * width, ~_U(0))
        padded[:n] = key
        table = padded.reshape(-1, width)
        forward = np.minimum.accumulate(table, axis=1).ravel()
        backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        runs = np.arange(hi - lo)[valid[lo:hi]]
        least = np.minimum(backward[runs], forward[runs + width - 1])
        out.append(np.unique(_U((1 << 20) - 1) - (least & _U((1 << 20) - 1))).astype(np.int64) + lo)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def document_keys(ids: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit key of each row from its doc_id and its bytes; equal rows share it."""
    raw = np.zeros(len(off) - 1, np.uint64)
    for first, end, d, o in tv.blocks(data, off, BLOCK_BYTES):
        filled = np.diff(o) > 0
        raw[first:end][filled] = tv.span_hashes(d, o[:-1][filled], o[1:][filled])
    known = np.asarray(ids.is_valid())
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return tv.mix64(raw * _U(31) + tv.mix64(own * _U(2) + known.astype(np.uint64)))


def _anchor_rows(length: int):
    half = length // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            for first, end, d, o in tv.blocks(data, off, BLOCK_BYTES):
                ids = batch.column("doc_id").slice(first, end - first)
                sizes = np.diff(o)
                keys = document_keys(ids, d, o)
                roll = RollingHash(d)
                grams = roll.windows(half)
                doc_end = np.repeat(o[1:], sizes)
                runs = max(len(d) - length + 1, 0)
                valid = np.arange(runs) + length <= doc_end[:runs]
                at = anchors(grams, length - half + 1, valid)
                row = np.searchsorted(o, at, side="right") - 1
                left = np.minimum(at - o[row], half)
                right = np.minimum(o[row + 1] - at, length)
                context = roll.spans(at - left, at + right) ^ (left * 1024 + right).astype(np.uint64) * _U(_BASE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tv.signed(grams[at])),
                        pa.array(tv.signed(tv.mix64(context))),
                        ids.take(pa.array(row)),
                        pa.array(tv.signed(keys[row])),
                        pa.array(at - o[row]),
                        pa.array(left.astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                    ],
                    ["fp", "ctx", "doc_id", "k", "at", "left", "right"],
                )

    return scan


def _texts_of(bits):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            keys = document_keys(batch.column("doc_id"), data, off)
            use = pa.array(np.flatnonzero(in_bloom(table, keys) & (np.diff(off) > 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tv.signed(keys)).take(use), batch.column("text").take(use)], ["k", "text"]
            )

    return fetch


_CONTEXT = "fp long, copies long, m long, doc_id long, k long, at long, left int, bytes binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["fp", "copies", "m", "doc_id", "at", "left", "right"]
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column("text")[i].as_py().encode()
            k, wanted = batch.column("k")[i], batch.column("wanted")[i].values
            for lo in range(0, len(wanted), 4096):
                rows = dict(zip(names, wanted.slice(lo, 4096).flatten(), strict=True))
                at, left, right = (rows[c].to_numpy(zero_copy_only=False).tolist() for c in ("at", "left", "right"))
                cut = pa.array([raw[x - y : x + z] for x, y, z in zip(at, left, right, strict=True)], pa.binary())
                columns = [rows["fp"], rows["copies"], rows["m"], rows["doc_id"], pa.array([k.as_py()] * len(cut), pa.int64()), rows["at"], rows["left"], cut]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "copies", "m", "doc_id", "k", "at", "left", "bytes"])


def has_previous_factor(ranks: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of given names (equal: they share the whole length) at corpus positions ``place``:

    (an earlier position shares the length, any other position does).  In
    suffix order, ties by position, the previous smaller position of an entry
    within its run is the next lower one of the run; the run's first has none.
    A position that is listed twice (under two anchors) is one position.
    """
    by = np.lexsort((place, ranks))
    r, p = ranks[by], place[by]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(r)))
    low, high = np.repeat(p[first], size), np.repeat(p[first + size - 1], size)
    earlier, other = np.empty(len(r), bool), np.empty(len(r), bool)
    earlier[by] = p > low
    other[by] = high > low
    return earlier, other


def exact_names(data: np.ndarray, at: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes at places of ``data``, equal only for equal bytes.

    ``names`` are hashes; neighbours in a run of equal ones are compared, and
    a run that holds different bytes is named anew by its bytes.
    """
    by = np.argsort(names, kind="stable")
    same = np.flatnonzero(names[by][1:] == names[by][:-1])
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    wrong = set()
    for lo in range(0, len(same), 8192):
        i = same[lo : lo + 8192]
        unequal = (windows[at[by[i]]] != windows[at[by[i + 1]]]).any(axis=1)
        wrong.update(names[by[i[unequal]]].tolist())
    if wrong:
        kinds, names = np.unique(names, return_inverse=True)
        for i in np.searchsorted(kinds, np.array(sorted(wrong), kinds.dtype)).tolist():
            members = np.flatnonzero(names == i)
            own: dict[bytes, int] = {}
            fresh = [own.setdefault(windows[x].tobytes(), len(own)) for x in at[members].tolist()]
            names[members] = np.where(np.array(fresh) == 0, i, int(names.max()) + np.array(fresh))
    return names


def _marks(table: pa.Table, length: int, keep_first: bool) -> pa.RecordBatch:
    """Repeated intervals of a block of whole groups of contexts."""
    column = table.column("bytes").combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off -= off[0]
    left = table.column("left").to_numpy().astype(np.int64)
    count = np.minimum(left, np.diff(off) - length) + 1
    at, copies = table.column("at").to_numpy(), table.column("copies").to_numpy()
    fp = table.column("fp").to_numpy()
    doc_id = table.column("doc_id")
    known = np.asarray(doc_id.combine_chunks().is_valid())
    ids = doc_id.fill_null(0).to_numpy().astype(np.int64)
    # Corpus positions: documents in (doc_id, key) order, then the byte.
    k = table.column("k").to_numpy()
    by = np.lexsort((k, ids, known))
    new = np.concatenate([[False], (k[by][1:] != k[by][:-1]) | (ids[by][1:] != ids[by][:-1])])
    document = np.empty(len(left), np.int64)
    document[by] = np.cumsum(new)
    hashes = RollingHash(data).windows(length)
    first, last = np.full(len(left), -1, np.int64), np.full(len(left), -1, np.int64)
    # Distance of a suffix from its anchor: equal strings have an equal one.
    far, step = int(left.max(initial=0)) + 1, max(SUFFIXES // max(len(left), 1), 1)
    for low in range(0, far, step):
        # The suffixes that start ``low`` .. ``low + step - 1`` bytes before the anchor.
        begin = np.maximum(left - (low + step - 1), 0)
        end = np.minimum(left - low + 1, count)
        n = np.maximum(end - begin, 0)
        if not n.any():
            continue
        ctx = np.repeat(np.arange(len(left)), n)
        inner = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n) + begin[ctx]
        place = off[ctx] + inner
        # A run is of one gram and one distance.
        names = hashes[place] ^ tv.mix64(fp[ctx].view(np.uint64) + (left[ctx] - inner).astype(np.uint64))
        earlier, other = has_previous_factor(
            exact_names(data, place, names, length), (document << 40)[ctx] + (at - left)[ctx] + inner
        )
        hit = np.flatnonzero(earlier if keep_first else other | (copies[ctx] > 1))
        if len(hit):
            which, start = np.unique(ctx[hit], return_index=True)
            stop = np.append(start[1:], len(hit)) - 1
            low_hit, high_hit = inner[hit][start], inner[hit][stop]
            first[which] = np.where(first[which] < 0, low_hit, np.minimum(first[which], low_hit))
            last[which] = np.maximum(last[which], high_hit)
    # One interval a context: all its strings hold the anchor, so they overlap.
    which = np.flatnonzero(last >= 0)
    begin = (at - left)[which]
    return pa.RecordBatch.from_arrays(
        [pa.array(k[which]), pa.array(begin + first[which]), pa.array(begin + last[which] + length)], ["k", "start", "end"]
    )


def _group_marks(length: int, keep_first: bool):
    """Task function over contexts sorted by gram: whole groups, about ``CONTEXT_BYTES`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(CONTEXT_BYTES // (length + length // 2), 1)
        held: pa.Table | None = None

        def whole(last: bool) -> int:
            """Rows of whole groups up to the limit, or of the first group alone; 0 if it may go on."""
            fp = held.column("fp").to_numpy()
            ends = np.flatnonzero(fp[1:] != fp[:-1]) + 1
            if last:
                ends = np.append(ends, len(fp))
            if not len(ends):
                return 0
            return int(ends[ends <= limit][-1]) if ends[0] <= limit else int(ends[0])

        for batch in batches:
            for lo in range(0, batch.num_rows, limit):
                more = pa.Table.from_batches([batch.slice(lo, limit)])
                held = more if held is None else pa.concat_tables([held, more])
                while held.num_rows >= limit and (cut := whole(False)):
                    yield _marks(held.slice(0, cut).combine_chunks(), length, keep_first)
                    held = held.slice(cut)
        while held is not None and held.num_rows:
            cut = whole(True)
            yield _marks(held.slice(0, cut).combine_chunks(), length, keep_first)
            held = held.slice(cut)

    return run


def _string_rows(length: int):
    """Every string of a context that holds its anchor: (two hashes, place), a hundred contexts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = batch.slice(lo, 100)
                pieces = rows.column("bytes").to_pylist()
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                left, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("left", "at"))
                n = np.minimum(left, sizes - length) + 1
                ctx = np.repeat(np.arange(len(pieces)), n)
                inner = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
                raw = np.frombuffer(b"".join(pieces), np.uint8)
                place = np.repeat(np.cumsum(sizes) - sizes, n) + inner
                take = pa.array(ctx)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(tv.signed(RollingHash(raw, b).windows(length)[place])) for b in (_BASE, _BASE_2)],
                        rows.column("doc_id").take(take),
                        rows.column("k").take(take),
                        pa.array((at - left)[ctx] + inner),
                        rows.column("copies").take(take),
                    ],
                    ["h", "h2", "doc_id", "k", "start", "copies"],
                )

    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(k, start, end): repeated byte intervals by document key; intervals may overlap."""
    if length % 2 or not 16 <= length <= 1000:
        raise ValueError("length: an even number of bytes from 16 to 1000")
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(
        texts.mapInArrow(
            _anchor_rows(length), "fp long, ctx long, doc_id long, k long, at long, left int, right int"
        ),
        "anchors",
    )
    twice = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    shared = materialize(rows.join(twice, "fp"), "shared-anchors")
    place = F.struct("doc_id", "k", "at", "left", "right")
    contexts = materialize(
        shared.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("rep")), "contexts"
    )
    # Equal contexts: repeated all through.
    alike = shared.join(contexts.where("copies > 1"), ["fp", "ctx"])
    if keep_first:
        alike = alike.where(~place.eqNullSafe(F.col("rep")))
    whole = alike.select("k", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))
    # Different contexts of one gram: compared as suffixes, one of each.
    groups = contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("m"), F.min("copies").alias("least")).where("m > 1")
    if not keep_first:
        groups = groups.where("least = 1")  # else every context is marked already
    open_ = materialize(contexts.join(groups.drop("least"), "fp").select("fp", "copies", "m", "rep.*"), "open-contexts")
    bits = spark.sparkContext.broadcast(bloom(open_.select("k")))
    wanted = open_.groupBy("k").agg(
        F.collect_list(F.struct("fp", "copies", "m", "doc_id", "at", "left", "right")).alias("wanted")
    )
    found = texts.mapInArrow(_texts_of(bits), "k long, text string").dropDuplicates(["k"])
    cut = materialize(found.join(wanted, "k").select("k", "text", "wanted").mapInArrow(_cut_contexts, _CONTEXT), "cut-contexts")
    small = (
        cut.where(F.col("m") <= GROUP_LIMIT).repartition("fp").sortWithinPartitions("fp")
        .mapInArrow(_group_marks(length, keep_first), "k long, start long, end long")
    )
    spans = whole.unionByName(small)
    hot = cut.where(F.col("m") > GROUP_LIMIT)
    if not hot.isEmpty():
        strings = hot.mapInArrow(_string_rows(length), "h long, h2 long, doc_id long, k long, start long, copies long")
        # A string under two anchors is one string.
        strings = strings.groupBy("h", "h2", "doc_id", "k", "start").agg(F.max("copies").alias("copies"))
        least = F.struct("doc_id", "k", "start")
        counted = strings.groupBy("h", "h2").agg(F.sum("copies").alias("n"), F.min(least).alias("first")).where("n > 1")
        marked = strings.join(counted, ["h", "h2"])
        if keep_first:
            marked = marked.where(~least.eqNullSafe(F.col("first")))
        spans = spans.unionByName(marked.select("k", "start", (F.col("start") + length).alias("end")))
    return spans


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        sha = batch.column("sha").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if sha[i] is not None:
                out["n_removed"].append(0)
                out["n_spans"].append(0)
                out["kept_sha256"].append(sha[i])
                out["kept"].append(None)
                continue
            raw = (batch.column("text")[i].as_py() or "").encode()
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for s in merged for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["n_spans"], pa.int64()),
                pa.array(out["kept_sha256"], pa.string()),
                pa.array(out["kept"], pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _documents(bits):
    """Rows whose key may have a span carry their text on; all others only its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            keys = document_keys(batch.column("doc_id"), data, off)
            hit = in_bloom(table, keys)
            raw = memoryview(data)
            sha = [
                None if h else hashlib.sha256(raw[a:b]).hexdigest()
                for h, a, b in zip(hit.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)
            ]
            text = pa.compute.if_else(pa.array(hit), batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tv.signed(keys)), batch.column("doc_id"), pa.array(np.diff(off)), pa.array(sha, pa.string()), text],
                ["k", "doc_id", "n_bytes", "sha", "text"],
            )

    return run


def without_repeats(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the remaining bytes of documents that lost some (others: null).
    """
    spark: SparkSession = docs.sparkSession
    spans = materialize(repeated_spans(docs, length=length, keep_first=keep_first), "repeated-spans")
    bits = spark.sparkContext.broadcast(bloom(spans.select("k")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A document's own intervals: their number is bounded by its length.
    by_doc = spans.distinct().groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = texts.mapInArrow(_documents(bits), "k long, doc_id long, n_bytes long, sha string, text string")
    joined = rows.where("sha is null").join(by_doc, "k", "left")
    clean = rows.where("sha is not null").withColumn("spans", F.lit(None).cast("array<struct<start: long, end: long>>"))
    columns = ["doc_id", "n_bytes", "sha", "text", "spans"]
    both = joined.select(*columns).unionByName(clean.select(*columns))
    return both.mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs).drop("kept")
