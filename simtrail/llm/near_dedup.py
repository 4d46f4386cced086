"""Operator 1: near-duplicate documents by consistent weighted sampling.

A document is its set of five-word shingles (ASCII lower-cased words of
letters and digits; shorter documents are one shingle), each weighted by
term frequency times a normalised inverse document frequency

    idf = 2 - ln(df) / ln(N)        (1 for a shingle of all N documents, 2 for a rare one)

so that the shingles of a large group of copies still count.  ``df`` is
counted over all documents in a count-mean-min table of fixed width.

1. One scan sums the document frequencies.
2. One scan draws ``bands * rows`` improved consistent weighted samples a
   document (argmin over its shingles of ``ln c - r (t - beta + 1)``,
   ``t = floor(ln w / r + beta)``); the samples of a band are one bucket key.
3. Documents with the same words collapse to their least doc_id.
4. Buckets give candidate pairs: every member with its bucket's most central
   member, verified, and linked to components.
5. Buckets that still hold several components are compared in full, in blocks
   of bounded size: pairs of different components whose ``FINE`` further
   samples agree nearly as often as the similarity asks (four standard errors
   below it) are candidates too; nothing else of a bucket is written out.
6. Every candidate is verified by the weighted Jaccard similarity of the whole
   texts.  Connected components give the class: the least doc_id.

Defined results: null, empty and word-less texts have no shingle and are
their own class (word-less non-empty texts with equal bytes share one);
rows that repeat a doc_id are one document (rows without doc_id are each
returned with a null class); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.linking import (
    CHUNK,
    bloom,
    chunk_rows,
    components,
    counter_table,
    dealt,
    in_bloom,
    merged,
    open_members,
    star_pairs,
)
from simtrail.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
DF_WIDTH = 1 << 19
# Samples of the finer comparison, the first of them used as a quick test; members of a block.
FINE = 512
QUICK = 64
BLOCK_MEMBERS = 2048
_U = np.uint64
_POOL = 1 << 16


def features(data: np.ndarray, off: np.ndarray, k: int):
    """Sorted distinct shingles of each row: (48-bit hash, count, row offsets)."""
    words, word_off = tv.word_hashes(data, off)
    hashes, rows = tv.grams(words, word_off, k)
    key = (rows.astype(np.uint64) << _U(48)) | (hashes >> _U(16))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    starts = np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << _U(48))
    return key & _U((1 << 48) - 1), counts, starts


def _df_chunks(k: int, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + CHUNK, np.int64)
        for batch in batches:
            data, off = tv.text_bytes(batch.column(0))
            for _, _, d, o in tv.blocks(data, off):
                hashes, _, starts = features(d, o, k)
                total[:width] += np.bincount((hashes & _U(width - 1)).astype(np.int64), minlength=width)
                total[width] += int((np.diff(starts) > 0).sum())
        yield chunk_rows(total)

    return count


def idf_table(texts: DataFrame, k: int = SHINGLE_WORDS, width: int = DF_WIDTH) -> np.ndarray:
    """float32 idf of each hash slot, from the document frequencies of all rows of ``text``."""
    counts = counter_table(texts.select("text").mapInArrow(_df_chunks(k, width), "chunk int, counts binary"), width + CHUNK)
    docs, counts = max(int(counts[width]), 1), counts[:width].astype(np.float64)
    # Count-mean-min: what the other shingles are expected to add is taken off.
    df = np.clip(counts - (counts.sum() - counts) / (width - 1), 1, docs)
    return (2 - np.log(df) / np.log(max(docs, 2))).astype(np.float32)


def sampling_tables(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pools of the draws of the sampling scheme: r, ln c (both Gamma(2, 1)) and beta."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2, 1, _POOL).astype(np.float32)
    return r, np.log(rng.gamma(2, 1, _POOL)).astype(np.float32), rng.random(_POOL).astype(np.float32)


def weighted_samples(hashes, weights, starts, n_samples: int, pools, seed: int = 11) -> np.ndarray:
    """(rows, n_samples) sample ids; rows without features are 0.

    Two rows share sample i with a probability of their weighted Jaccard
    similarity.
    """
    r_pool, c_pool, b_pool = pools
    filled = np.flatnonzero(np.diff(starts) > 0)
    out = np.zeros((len(starts) - 1, n_samples), np.uint64)
    mult = np.random.default_rng(seed).integers(1, 1 << 63, size=n_samples, dtype=np.uint64) * _U(2) + _U(1)
    begin = 0
    while begin < len(filled):  # runs of rows with about 32k features stay in cache
        end = max(begin + 1, int(np.searchsorted(starts[filled + 1], starts[filled[begin]] + 32768, side="right")))
        end = min(end, len(filled))
        rows = filled[begin:end]
        lo, hi = starts[rows[0]], starts[rows[-1] + 1]
        h, log_w = hashes[lo:hi], np.log(weights[lo:hi])
        at = starts[rows] - lo
        lens = np.diff(np.append(at, hi - lo))
        for i in range(n_samples):
            slot = ((h * mult[i]) >> _U(48)).astype(np.int32)
            r = r_pool[slot]
            beta = b_pool[slot]
            t = np.floor(log_w / r + beta)
            log_a = c_pool[slot] - r * (t - beta + 1)
            least = np.minimum.reduceat(log_a, at)
            hit = np.flatnonzero(log_a == np.repeat(least, lens))
            hit = hit[np.searchsorted(hit, at)]
            out[rows, i] = tv.mix64(h[hit] ^ (t[hit].astype(np.int64).view(np.uint64) << _U(48)) ^ mult[i])
        begin = end
    return out


def _signatures(idf, k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = sampling_tables()
        table = idf.value
        mask = _U(len(table) - 1)
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for first, end, d, o in tv.blocks(data, off):
                words, word_off = tv.word_hashes(d, o)
                raw = tv.span_hashes(d, o[:-1], o[1:]) if (np.diff(o) > 0).all() else _whole(d, o)
                n_words = np.diff(word_off)
                hashes, counts, starts = features(d, o, k)
                weights = counts.astype(np.float32) * table[(hashes & mask).astype(np.int64)]
                samples = weighted_samples(hashes, weights, starts, bands * rows, pools)
                shape = samples.reshape(len(o) - 1, bands, rows)
                keys = np.zeros((len(o) - 1, bands), np.uint64)
                for j in range(rows):
                    keys = tv.mix64(keys * _U(31) + shape[:, :, j])
                keys = tv.mix64(keys + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                has = n_words > 0
                # Equal word sequences, or equal bytes where there is no word.
                fp1 = np.where(has, tv.row_hashes(words, word_off, 1), raw)
                fp2 = np.where(has, tv.row_hashes(words, word_off, 2), tv.mix64(raw + _U(5)))
                flat = pa.array(tv.signed(keys[has].ravel()))
                list_off = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(np.diff(o)),
                        pa.array(tv.signed(fp1)),
                        pa.array(tv.signed(fp2)),
                        pa.ListArray.from_arrays(pa.array(list_off), flat),
                    ],
                    ["doc_id", "n_words", "n_bytes", "fp1", "fp2", "bands"],
                )

    return sign


def _only(bits):
    """Task function: (doc_id, text) of the rows whose doc_id may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(in_bloom(table, ids)))

    return run


def _sketches(idf, bits, k: int):
    """Task function: ``FINE`` one-byte samples of the documents in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools, table = sampling_tables(), idf.value
        mask = _U(len(table) - 1)
        for batch in _only(bits)(batches):
            data, off = tv.text_bytes(batch.column("text"))
            for first, end, d, o in tv.blocks(data, off):
                hashes, counts, starts = features(d, o, k)
                weights = counts.astype(np.float32) * table[(hashes & mask).astype(np.int64)]
                samples = (weighted_samples(hashes, weights, starts, FINE, pools, seed=13) >> _U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array([x.tobytes() for x in samples], pa.binary())],
                    ["id", "sketch"],
                )

    return run


def _block_pairs(similarity: float):
    """Task function over rows sorted by (bucket, lo, hi): pairs of different components that may be similar."""
    least = [similarity * n - 4 * (similarity * (1 - similarity) * n) ** 0.5 for n in (QUICK, FINE)]

    def pairs_of(group: pa.Table) -> pa.RecordBatch:
        bucket, lo, hi = (group.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
        ids, comp, block = (group.column(c).to_numpy() for c in ("id", "comp", "block"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), FINE)
        quick = np.ascontiguousarray(sketch[:, :QUICK])
        keys = np.array(group.column("bands").to_pylist(), np.int64)
        out = []
        for x in range(len(ids)):
            if block[x] != lo:
                continue
            near = np.flatnonzero((comp != comp[x]) & ((block == hi) if lo != hi else (np.arange(len(ids)) > x)))
            near = near[(quick[near] == quick[x]).sum(axis=1) >= least[0]]
            near = near[(sketch[near] == sketch[x]).sum(axis=1) >= least[1]]
            # Documents that share several buckets meet in the first one only.
            near = near[keys[x][np.argmax(keys[near] == keys[x], axis=1)] == bucket] if len(near) else near
            out += [(ids[x], ids[y], comp[x], comp[y]) for y in near]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and tuple(key[a]) != now:
                    yield pairs_of(pa.concat_tables(held).combine_chunks())
                    held = []
                now = tuple(key[a])
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield pairs_of(pa.concat_tables(held).combine_chunks())

    return run


def _whole(data, off) -> np.ndarray:
    """Hash of each row's bytes; 0 for empty rows."""
    out = np.zeros(len(off) - 1, np.uint64)
    filled = np.diff(off) > 0
    out[filled] = tv.span_hashes(data, off[:-1][filled], off[1:][filled])
    return out


def jaccard(a_hash, a_weight, a_off, b_hash, b_weight, b_off) -> np.ndarray:
    """Weighted Jaccard similarity of row i of both sides (features sorted in rows)."""
    rows = len(a_off) - 1

    def keys(h, off):
        return (np.repeat(np.arange(rows, dtype=np.uint64), np.diff(off)) << _U(48)) | h

    ka, kb = keys(a_hash, a_off), keys(b_hash, b_off)
    at = np.searchsorted(kb, ka)
    same = (at < len(kb)) & (kb[np.minimum(at, max(len(kb) - 1, 0))] == ka) if len(kb) else np.zeros(len(ka), bool)
    low = np.minimum(a_weight[same], b_weight[at[same]]).astype(np.float64)
    both = np.bincount((ka[same] >> _U(48)).astype(np.int64), weights=low, minlength=rows)
    total = tv.row_sums(a_weight.astype(np.float64), a_off) + tv.row_sums(b_weight.astype(np.float64), b_off)
    return both / np.maximum(total - both, 1e-9)


def _verify(idf, k: int, least: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        mask = _U(len(table) - 1)
        for batch in batches:
            (da, oa), (db, ob) = tv.text_bytes(batch.column("text_a")), tv.text_bytes(batch.column("text_b"))
            row = 0
            while row < batch.num_rows:
                end = int(np.searchsorted(oa + ob, oa[row] + ob[row] + 2 * tv.BLOCK_BYTES, side="right")) - 1
                end = min(max(end, row + 1), batch.num_rows)
                sides = []
                for d, o in ((da, oa), (db, ob)):
                    h, n, starts = features(d[o[row] : o[end]], o[row : end + 1] - o[row], k)
                    sides += [h, n.astype(np.float32) * table[(h & mask).astype(np.int64)], starts]
                sim = jaccard(*sides)
                keep = sim >= least
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("a").slice(row, end - row).filter(pa.array(keep)),
                        batch.column("b").slice(row, end - row).filter(pa.array(keep)),
                        pa.array(sim[keep]),
                    ],
                    ["a", "b", "similarity"],
                )
                row = end

    return check


def near_duplicates(
    docs: DataFrame,
    *,
    k: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    df_width: int = DF_WIDTH,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` (doc_id, text).

    classes: doc_id, class_id (least doc_id of the component), rep_id (least
    doc_id with the same words), n_words.  links: verified pairs (a, b,
    similarity) between different texts, as used for the components.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(texts, k, df_width))
    signed = materialize(
        texts.mapInArrow(
            _signatures(idf, k, bands, rows),
            "doc_id long, n_words long, n_bytes long, fp1 long, fp2 long, bands array<long>",
        ),
        "near-signatures",
    )
    known = signed.where("doc_id is not null")
    copies = known.where("n_bytes > 0").groupBy("fp1", "fp2", (F.col("n_words") > 0).alias("worded")).agg(
        F.min("doc_id").alias("rep_id"),
        F.min_by("bands", "doc_id").alias("bands"),
    )
    copies = materialize(copies, "near-representatives")
    members = copies.where("worded").select(F.col("rep_id").alias("id"), F.explode("bands").alias("bucket"))
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    members = materialize(members.join(sizes, "bucket").drop("n"), "near-buckets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """``pairs`` (a, b, ...) whose texts are similar enough; only the texts of candidates are passed on."""
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
        bits = spark.sparkContext.broadcast(bloom(ids))
        some = texts.where("doc_id is not null").mapInArrow(_only(bits), "doc_id long, text string")
        some = materialize(some.dropDuplicates(["doc_id"]), f"near-texts-{name}")
        full = (
            pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
        )
        links = full.mapInArrow(_verify(idf, k, similarity), "a long, b long, similarity double")
        return materialize(links, f"near-links-{name}")

    links = verified(materialize(star_pairs(members, sizes), "near-stars"), "star")
    labels = components(links)
    left = open_members(members, labels)
    if not left.isEmpty():
        bits = spark.sparkContext.broadcast(bloom(left.select("id")))
        sketched = texts.where("doc_id is not null").mapInArrow(_sketches(idf, bits, k), "id long, sketch binary")
        sketched = sketched.dropDuplicates(["id"]).join(copies.select(F.col("rep_id").alias("id"), "bands"), "id")
        blocks = dealt(left, BLOCK_MEMBERS).select("bucket", "id", "comp", "block", "lo", "hi")
        rest = (
            blocks.join(sketched, "id")
            .repartition("bucket", "lo", "hi")
            .sortWithinPartitions("bucket", "lo", "hi", "id")
            .mapInArrow(_block_pairs(similarity), "a long, b long, ca long, cb long")
        )
        rest = materialize(rest, "near-rest")
        if not rest.isEmpty():
            more = verified(rest, "rest")
            links = links.unionByName(more)
            labels = merged(labels, more.join(rest, ["a", "b"]).select("ca", "cb"))
    reps = copies.select("fp1", "fp2", "worded", "rep_id").join(
        labels.select(F.col("node").alias("rep_id"), "comp"), "rep_id", "left"
    ).select("fp1", "fp2", "worded", "rep_id", F.coalesce("comp", "rep_id").alias("class_id"))
    # A group of copies may hold a third of all rows: this is a plain equi-join, which Spark splits.
    filled = known.where("n_bytes > 0").withColumn("worded", F.col("n_words") > 0)
    classes = filled.join(reps, ["fp1", "fp2", "worded"]).select("doc_id", "class_id", "rep_id", "n_words")
    empty = signed.where("n_bytes = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), "n_words"
    )
    return classes.unionByName(empty), links


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id, kept (the class's least doc_id), n_words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes, _ = near_duplicates(docs)
    return classes.select("doc_id", "class_id", F.expr("doc_id <=> class_id").alias("kept"), "n_words")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; rows without doc_id stay."""
    classes, _ = near_duplicates(docs)
    gone = classes.where("doc_id != class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
