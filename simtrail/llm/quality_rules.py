"""Operator 4: quality rules with adaptive thresholds per language and source.

Fixed base rules fail a document outright; beyond them every measure of a
text is compared with fences of its own (lang, source) group, taken from
mergeable quantile sketches: counts by logarithmic bucket (32 buckets an
octave, so a quantile is within 1/32 of its value).  Sketches merge by adding
counts; they are pre-aggregated before the shuffle and never hold more than
some 2,000 rows a group and measure, however many documents it has.

fence = 75 % quantile + SPREADS * max(75 % - 25 % quantile, least spread)

for shares of symbols, repeated lines and repeated words, and the same on
both sides for the mean word length.  Every group's sketch is its own counts
plus those of its language scaled to ``PARENT_ROWS`` rows, and the language's are
its own plus those of all documents scaled alike: a small group leans on its
parent, a large one outweighs it, and no size switches from one to the other.
Equal texts of a group count once, so copying a text does not move its fence.

Words are runs of anything but ASCII white space.

Defined results: null text has no words and fails the base rules; null lang
or source is a group of its own; repeated rows are all returned;
existing columns of the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simtrail.llm import textvec as tv
from simtrail.llm.line_dedup import line_offsets
from simtrail.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PARENT_ROWS = 200
SPREADS = 3
# Measures in thousandths and their least spread; the mean word length also has a lower fence.
MEASURES = {"symbol_share": 20, "dup_line_share": 200, "repeat_share": 100, "word_length": 500}
TWO_SIDED = ("word_length",)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64
_SYMBOL = tv.class_table(b"#*$%&|<>")
_LEAD = tv.class_table([*range(0x00, 0x80), *range(0xC0, 0x100)])


def base_measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row, and its number of lines."""
    rows = len(off) - 1
    starts, ends, word_off = tv.word_spans(data, off, tv.NON_SPACE)
    words = tv.span_hashes(data, starts, ends)
    counts = np.diff(word_off)
    row = np.repeat(np.arange(rows, dtype=np.uint64), counts)
    out = {
        "n_words": counts,
        "word_chars": tv.row_sums((_LEAD & tv.NON_SPACE)[data].astype(np.int64), off),
        "n_symbols": tv.row_sums(_SYMBOL[data].astype(np.int64), off),
    }
    # Lines with a word that equal an earlier line of the text.
    l_start, l_end, line_off = line_offsets(data, off)
    worded = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    line_row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(line_off))[worded]
    key = tv.mix64(tv.span_hashes(data, l_start[worded], l_end[worded]) + line_row * _U(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(line_row.astype(np.int64), minlength=rows)
    out["n_dup_lines"] = lines - np.bincount(line_row[first].astype(np.int64), minlength=rows)
    out["n_lines"] = lines
    # Words in a three-word window that the text has twice or more.
    grams = tv.rolling(words, 3)
    at = np.flatnonzero(np.arange(len(grams)) + 3 <= np.repeat(word_off[1:], counts)[: len(grams)])
    key = tv.mix64(grams[at] + row[at] * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    equal = np.concatenate([[False], key[1:] == key[:-1], [False]]) if len(key) else np.zeros(1, bool)
    twice = at[order[equal[1:] | equal[:-1]]]
    hit = np.zeros(len(words), dtype=np.int64)
    for j in range(3):
        hit[twice + j] = 1
    out["n_repeat_words"] = tv.row_sums(hit, word_off)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tv.text_bytes(batch.column("__text"))
        parts = [base_measures(d, o) for _, _, d, o in tv.blocks(data, off)]
        keys = [*BASE, "n_lines"]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in keys]
        names = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), *(pa.array(x.astype(np.int64)) for x in columns)], [*names, *keys]
        )


def with_measures(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed`` and the shares in thousandths."""
    rest = docs.drop(*BASE, "n_lines", "__text", *MEASURES, "base_failed").select(
        *[F.col(c) for c in docs.columns if c not in (text, *BASE, "n_lines", "__text", "text_key", *MEASURES, "base_failed")],
        F.col(text).cast("string").alias("__text"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name != "__text")
    counts = ", ".join(f"{c} long" for c in (*BASE, "n_lines"))
    keyed = rest.withColumn("text_key", F.xxhash64("__text", F.length("__text")))
    schema = f"{schema}, text_key long" if schema else "text_key long"
    found = keyed.mapInArrow(_measure, f"{schema}, {counts}")

    def share(top: str, bottom: str):
        return F.expr(f"case when {bottom} > 0 then {top} * 1000 div {bottom} else 0 end")

    return found.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )


def bucket_of(value):
    """Sketch bucket of a whole number: exact below 32, then 32 buckets an octave."""
    bits = F.length(F.bin(value))
    # The leading 6 bits, 32 to 63, number the bucket within its octave.
    return F.when(value < 32, value).otherwise(
        (bits - 5).cast("long") * 32 + F.floor(value / F.pow(F.lit(2), bits - 6)).cast("long") - 32
    )


def bucket_low(bucket):
    """Least value of a bucket: the inverse of ``bucket_of``."""
    octave = F.floor(bucket / 32)
    return F.when(bucket < 32, bucket).otherwise(
        ((bucket % 32 + 32) * F.pow(F.lit(2), octave - 1)).cast("long")
    )


_GROUP = ("__lk", "__sk")


def _keys(df: DataFrame) -> DataFrame:
    """``__lk`` and ``__sk``: language and source as keys that are never null."""
    return df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(_GROUP, ("lang", "source"))})


def sketches(measured: DataFrame) -> DataFrame:
    """(__lk, __sk, measure, bucket, n): the sketch of each group; texts that are equal count once."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES])
    ).alias("p")
    once = _keys(measured).groupBy(*_GROUP, "text_key").agg(*[F.min(m).alias(m) for m in MEASURES])
    return once.select(*_GROUP, pairs).select(*_GROUP, "p.*").groupBy(*_GROUP, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def blended(groups: DataFrame) -> DataFrame:
    """``sketches`` with the counts of the parents added (``n`` becomes a fraction).

    Merging sketches is adding counts: a language's is the sum of its groups',
    the one of all documents the sum of theirs.
    """

    def shares(counts: DataFrame, keys: list[str]) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy(*keys, "measure"))
        return counts.select(*keys, "measure", "bucket", (F.col("n") / total).alias("share"))

    def lean(own: DataFrame, parent: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
        """``own`` plus ``PARENT_ROWS`` rows dealt as the parent's shares."""
        added = own.select(*keys, "measure").distinct().join(parent, [*on, "measure"])
        both = own.select(*keys, "measure", "bucket", F.col("n").cast("double").alias("n")).unionByName(
            added.select(*keys, "measure", "bucket", (F.col("share") * PARENT_ROWS).alias("n"))
        )
        return both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))

    langs = groups.groupBy("__lk", "measure", "bucket").agg(F.sum("n").alias("n"))
    every = langs.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    langs = lean(langs, shares(every, []), ["__lk"], [])
    return lean(groups, shares(langs, ["__lk"]), list(_GROUP), ["__lk"])


def fences(counts: DataFrame) -> DataFrame:
    """(__lk, __sk, and low_/high_ of each measure) from the blended sketches."""
    keys = [*_GROUP, "measure"]
    run = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    # The bucket in which the running share reaches a quarter, or three quarters.
    ranked = counts.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(whole)})

    def reaches(quarters: int):
        # The margin is for rounding of the shares.
        return F.col("upto") * 4 >= F.col("total") * (quarters - 1e-9)

    quartiles = ranked.groupBy(*keys).agg(
        F.min(F.when(reaches(1), bucket_low(F.col("bucket")))).alias("q1"),
        F.min(F.when(reaches(3), bucket_low(F.col("bucket")))).alias("q3"),
    )
    aggs = []
    for m, least in MEASURES.items():
        reach = SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        aggs.append(F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"high_{m}"))
        if m in TWO_SIDED:
            aggs.append(F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"low_{m}"))
    return quartiles.groupBy(*_GROUP).agg(*aggs)


def with_verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: neither a base rule nor a fence of its group fails it."""
    limits = materialize(fences(blended(materialize(sketches(measured), "quality-sketches"))), "quality-fences")
    cols = [c for c in limits.columns if c.startswith(("high_", "low_"))]
    limits = limits.select(*[F.col(k).alias(f"{k}_of") for k in _GROUP], *[F.col(c).alias(f"__{c}") for c in cols])
    keyed = _keys(measured)
    # One row a group on the right: an equi-join that Spark broadcasts when small and splits when skewed.
    joined = keyed.join(limits, [keyed[k] == limits[f"{k}_of"] for k in _GROUP], "left")
    good = ~F.col("base_failed")
    for m in MEASURES:
        good &= F.col(m) <= F.col(f"__high_{m}")
        if m in TWO_SIDED:
            good &= F.col(m) >= F.col(f"__low_{m}")
    return joined.withColumn("kept", F.coalesce(good, F.lit(False))).select(*measured.columns, "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    measured = materialize(with_measures(docs), "quality-measures")
    return with_verdicts(measured).select("doc_id", *BASE, "base_failed", "kept")
