"""Operator 5: benchmark decontamination by winnowing.

Words are maximal runs of ASCII letters, digits and non-ASCII characters,
ASCII lower-cased.  A window is ``WINDOW`` consecutive words of an item (all
words of a shorter item).  A document word is hit if it lies in an occurrence
of a window.

* Fingerprints: of the hashes of all ``GRAM``-word grams, the least of every
  ``WINDOW - GRAM + 1`` consecutive ones is kept (rightmost on ties).  A
  shared run of ``WINDOW`` words has the same grams on both sides, so the
  same fingerprint is kept on both: no window is missed.
* Items shorter than a window are one gram of their own length.
* Documents keep a fingerprint with its context of words only if a Bloom
  filter of the benchmark's fingerprints (fixed size) may hold it; then
  fingerprints are joined exactly.
* Every joined hit is extended to the left and the right, word by word on the
  words themselves; runs shorter than the window are dropped.

Defined results: null and word-less texts have no words and are not
contaminated; items without words have no window; rows that repeat a
document are each returned with their own counts; an item_id that occurs
twice or is null: ids count once, null ids are not counted as items but their
windows still hit; empty tables give empty or uncontaminated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simtrail.llm import textvec as tv
from simtrail.llm.linking import bloom, in_bloom
from simtrail.session import materialize

WINDOW = 10
GRAM = 5
_U = np.uint64


def winnow(hashes: np.ndarray, gram_off: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: the rightmost least hash of every ``width`` consecutive grams of a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Runs of ``width`` grams that lie within one row.
    row_end = np.repeat(gram_off[1:], np.diff(gram_off))
    start = np.flatnonzero(np.arange(n) + width <= row_end[:n])
    least, at = hashes[start].copy(), start.copy()
    for j in range(1, width):
        other = hashes[start + j]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = start[lower] + j
    return np.unique(at)


def _fingerprints(window: int, gram: int, short: list[int], bits, with_rows: bool):
    """Task function: fingerprints with their context; for documents also the word count of each row."""
    side = window - gram

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else bits.value
        context = TaskContext.get()
        next_row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            ids = batch.column(0)
            for first, end, d, o in tv.blocks(data, off):
                low = tv.LOWER[d]
                starts, ends, word_off = tv.word_spans(low, o)
                words = tv.span_hashes(low, starts, ends)
                counts = np.diff(word_off)
                rows = np.repeat(np.arange(len(counts)), counts)
                found_at, found_len, found_fp = [], [], []
                hashes = tv.rolling(words, gram)
                inside = np.arange(len(hashes)) + gram <= word_off[1:][rows[: len(hashes)]]
                where = np.flatnonzero(inside)
                gram_off = np.searchsorted(where, word_off)
                kept = where[winnow(hashes[where], gram_off, side + 1)]
                found_at.append(kept)
                found_len.append(np.full(len(kept), gram))
                found_fp.append(hashes[kept])
                for n in short:  # items shorter than a window: every gram of that length
                    h = tv.mix64(tv.rolling(words, n) + _U(n * 1000003))
                    ok = np.arange(len(h)) + n <= word_off[1:][rows[: len(h)]]
                    if not with_rows:  # in the benchmark only whole items of that length
                        ok &= (counts == n)[rows[: len(h)]]
                    at = np.flatnonzero(ok)
                    found_at.append(at)
                    found_len.append(np.full(len(at), n))
                    found_fp.append(h[at])
                at, size, fp = (np.concatenate(x) for x in (found_at, found_len, found_fp))
                if table is not None:
                    hit = in_bloom(table, fp)
                    at, size, fp = at[hit], size[hit], fp[hit]
                order = np.argsort(rows[at], kind="stable")
                at, size, fp = at[order], size[order], fp[order]
                of = rows[at]
                whole = size == gram  # short items need no context
                if gram in short:
                    whole &= np.isin(fp, hashes)
                lo = np.where(whole, np.maximum(at - side, word_off[of]), at)
                hi = np.where(whole, np.minimum(at + gram + side, word_off[of + 1]), at + size)
                texts = []
                for x, y in zip(lo, hi, strict=True):
                    texts.append([low[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(x, y)])
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array(tv.signed(fp)),
                        pa.array((at - word_off[of]).astype(np.int64)),
                        pa.array((at - lo).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(texts, pa.list_(pa.string())),
                    ],
                    ["fp", "at", "before", "size", "words"],
                )
                hit_off = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(next_row, next_row + end - first)),
                        ids.slice(first, end - first),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(hit_off), hits),
                    ],
                    ["row", "id", "n_words", "hits"],
                )
                next_row += end - first

    return scan


_HITS = "row long, id long, n_words long, hits array<struct<fp: long, at: long, before: int, size: int, words: array<string>>>"


def _extended(window: int, gram: int):
    """Task function: joined hits to runs of equal words of at least a window."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"row": [], "item": [], "start": [], "end": []}
            cols = [batch.column(c).to_pylist() for c in ("row", "item", "at", "before", "size", "words", "ibefore", "isize", "iwords")]
            for row, item, at, before, size, words, ibefore, isize, iwords in zip(*cols, strict=True):
                if size != isize or words[before : before + size] != iwords[ibefore : ibefore + size]:
                    continue
                left = 0
                while left < min(before, ibefore) and words[before - left - 1] == iwords[ibefore - left - 1]:
                    left += 1
                right, room = size, min(len(words) - before, len(iwords) - ibefore)
                while right < room and words[before + right] == iwords[ibefore + right]:
                    right += 1
                whole_item = len(iwords) == size and size < window and ibefore == 0
                if left + right >= window or whole_item and left == 0:
                    out["row"].append(row)
                    out["item"].append(item)
                    out["start"].append(at - left)
                    out["end"].append(at + right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], pa.int64()) for c in ("row", "item", "start", "end")], ["row", "item", "start", "end"]
            )

    return extend


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items``: (item_id, text).
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram has between one word and a window of words")
    spark: SparkSession = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # The lengths of items shorter than a window: at most ``window - 1`` numbers.
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lengths = texts.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))).alias("n"))
    short = sorted(r["n"] for r in lengths.where(f"n between 1 and {window - 1}").distinct().collect())
    bench = materialize(
        texts.mapInArrow(_fingerprints(window, gram, short, None, False), _HITS)
        .select("id", F.explode("hits").alias("h"))
        .select(
            F.col("id").alias("item"),
            "h.fp",
            F.col("h.before").alias("ibefore"),
            F.col("h.size").alias("isize"),
            F.col("h.words").alias("iwords"),
        )
        .distinct(),
        "benchmark-fingerprints",
    )
    bits = spark.sparkContext.broadcast(bloom(bench.select("fp")))
    scanned = materialize(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_fingerprints(window, gram, short, bits, True), _HITS),
        "document-fingerprints",
    )
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    # The benchmark side is a written table of known size: Spark broadcasts it
    # below its threshold and shuffles both sides beyond it.
    runs = materialize(
        hits.join(bench, "fp")
        .select("row", "item", "at", "before", "size", "words", "ibefore", "isize", "iwords")
        .mapInArrow(_extended(window, gram), "row long, item long, start long, end long")
        .distinct(),
        "contaminated-runs",
    )
    by_start = Window.partitionBy("row").orderBy("start", "end")
    spans = runs.select("row", "start", "end").distinct()
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        spans.withColumn("reach", F.coalesce(reach, F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("n_hit"))
    )
    found = (
        runs.where("item is not null")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    marks = covered.join(found, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    out = scanned.select("row", F.col("id").alias("doc_id"), "n_words").join(marks, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; rows without doc_id stay."""
    gone = contamination(docs, items).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
