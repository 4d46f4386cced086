"""Operator 12: phrase collocations by set-oriented relational mining (SETM).

The occurrence relation of length k holds, for every place where a phrase of k
words stands, its position and the phrase.  It is kept sorted by position, in
blocks of whole documents, and written; positions are numbered through a block
with a gap after every piece, so neighbours in a piece are one apart.  For each
length:

1. group-count: the different phrases of a block, with their counts, are dealt
   to ranges of a hash; a task sums the counts of one range after another;
2. semi-join: phrases below the least count go; the numbers of those that stay
   return to their blocks, where occurrences of others go before anything is
   extended;
3. extension: the relation is merge-joined with itself on adjacent positions
   (two phrases of k words that overlap in k - 1 give one of k + 1).  A block
   holds whole pieces, so this join needs no shuffle.

Relations travel as packed columns (one row a block or range), not as one row
an occurrence: the shuffles carry a few bytes for each different phrase of a
block.  The number of ranges follows the number of those phrases, so no task
holds more than about ``RANGE_PHRASES`` of them, and a phrase that holds a third
of all places is one entry a block.  A phrase is keyed by the numbers of its
first and of its last k - 1 words (words by themselves), so counts are exact and
no key is a hash.

Scores are exact (decimal arithmetic): a phrase of count a, cut into parts of
counts l and r, scores floor(10^6 a a / (l r)); the lowest cut counts.

Defined results: null texts are empty; a null language is ``und``; rows that
repeat a document all count; other columns are ignored; an empty table, or one
without phrases, gives no rows.  Counts must stay below 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.pieces import cut_at
from simtrail.session import bound_batches, discard, materialize

MAX_WORDS = 3
MIN_COUNT = 10
COVER = 50
TOP = 2000
BLOCK_BYTES = 4 << 20
RANGE_PHRASES = 1 << 20
_PIECE_END = r"[.,;:!?\x0A-\x0D]"
_GAP = r"[\x20\x09]+"
# pos, item: places and the phrase at each, by its number in the block.  n phrases with their counts c: as words
# (one a line) with a language each (langs[code]), or as the numbers of their parts (left, right).
_KEYS = {1: "langs array<string>, code binary, words binary", 2: "left binary, right binary"}
_RELATION = "block long, pos binary, item binary, n int, c binary, "
_RANGED = "range int, block long, idx binary, c binary, "
# kind 0: numbers of kept phrases, back to their block; 1: a frequent phrase; 2: words of a language.
_COUNTED = "kind int, block long, idx binary, gids binary, gid long, a long, lang string, word string, left long, right long"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed bytes; the first byte is their width."""
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _pack_words(words: pa.Array) -> bytes:
    """Words, one a line (no word holds a line break)."""
    joined = pc.binary_join_element_wise(words.cast(pa.large_string()), *[pa.scalar(x, pa.large_string()) for x in ("", "\n")])
    data, _ = tv.text_bytes(joined)
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def _unpack_words(raw: bytes) -> pa.Array:
    """Words with their line breaks."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    return cut_at(data, np.append(0, ends[:-1]) if len(ends) else ends)


def _parts(flat: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """(which row a part is of, the parts) after a split."""
    split = pc.split_pattern_regex(flat, pattern)
    return pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)


def _block(texts: pa.Array, langs: pa.Array) -> dict | None:
    """Sorted occurrences of the words of some documents, and their different (lang, word) with counts."""
    low = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    doc, pieces = _parts(low, _PIECE_END)
    piece, words = _parts(pieces, _GAP)
    full = pc.not_equal(words, "")
    words, piece = words.filter(full).dictionary_encode(), piece[full.to_numpy(zero_copy_only=False)]
    if not len(piece):
        return None
    langs = pc.fill_null(langs, "und").dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()[doc[piece]]
    kinds, item, counts = np.unique(key, return_inverse=True, return_counts=True)
    pos = np.arange(len(piece)) + np.cumsum(np.append(0, piece[1:] != piece[:-1]))
    return {
        "pos": pack(np.diff(pos, prepend=0)),
        "item": pack(item),
        "n": len(kinds),
        "c": pack(counts),
        "langs": langs.dictionary.to_pylist(),
        "code": pack(kinds % len(langs.dictionary)),
        "words": _pack_words(words.dictionary.take(pa.array(kinds // len(langs.dictionary)))),
    }


def _one_row(row: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in types.items()], list(types))


_HELD = {"block": pa.int64(), "pos": pa.binary(), "item": pa.binary(), "n": pa.int32(), "c": pa.binary()}
_WORDS = {"langs": pa.list_(pa.string()), "code": pa.binary(), "words": pa.binary()}
_PAIRS = {"left": pa.binary(), "right": pa.binary()}


def _occurrences(block_bytes: int):
    """Task function over (text, lang): one row a block of documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            got = pa.concat_batches(held)
            block = _block(got.column("text"), got.column("lang"))
            if block:
                yield _one_row(block | {"block": number}, _HELD | _WORDS)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            first, before = 0, 0
            while first < batch.num_rows:
                end = max(int(np.searchsorted(ends, before + block_bytes - size, side="right")), first + 1)
                held.append(batch.slice(first, end - first))
                size += int(ends[end - 1]) - before
                first, before = end, int(ends[end - 1])
                if size >= block_bytes or first < batch.num_rows:
                    yield from rows()
                    held, size, number = [], 0, number + 1
        if held:
            yield from rows()

    return scan


def _split(ranges: int, words: bool):
    """Task function: the phrases of each block, dealt to ranges of their hash."""
    types = {"range": pa.int32(), "block": pa.int64(), "idx": pa.binary(), "c": pa.binary()} | (_WORDS if words else _PAIRS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - ranges.bit_length() + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if words:
                    names, code = _unpack_words(row["words"]), unpack(row["code"])
                    data, off = tv.text_bytes(names)
                    h = tv.span_hashes(data, off[:-1], off[1:])
                else:
                    left, right = unpack(row["left"]), unpack(row["right"])
                    h = tv.mix64(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
                which = (h >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(h), np.int64)
                by = np.argsort(which, kind="stable")
                counts = unpack(row["c"])
                kinds, first = np.unique(which[by], return_index=True)
                for r, a, b in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(by)]):
                    idx = by[a:b]
                    out = {"range": r, "block": row["block"], "idx": pack(np.diff(idx, prepend=0)), "c": pack(counts[idx])}
                    if words:
                        out |= {"langs": row["langs"], "code": pack(code[idx]), "words": zstandard.ZstdCompressor(level=1).compress(
                            tv.ragged_take(data, off, idx)[0].tobytes())}
                    else:
                        out |= {"left": pack(left[idx]), "right": pack(right[idx])}
                    yield _one_row(out, types)

    return scan


def _counted_rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "block": pa.int64(), "idx": pa.binary(), "gids": pa.binary(), "gid": pa.int64(), "a": pa.int64(),
             "lang": pa.string(), "word": pa.string(), "left": pa.int64(), "right": pa.int64()}
    columns["kind"] = np.full(n, kind, np.int32)
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))


def _sum_range(rows: list[dict], ranges: int, min_count: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Counts over all blocks of one range: the frequent phrases, and their numbers back to the blocks."""
    counts = [unpack(r["c"]) for r in rows]
    sizes = np.array([len(c) for c in counts])
    counts = np.concatenate(counts)
    if words:
        langs: dict[str, int] = {}
        names = pa.concat_arrays([_unpack_words(r["words"]) for r in rows]).dictionary_encode()
        lang = np.concatenate([np.array([langs.setdefault(x, len(langs)) for x in r["langs"]])[unpack(r["code"])] for r in rows])
        key = names.indices.to_numpy().astype(np.int64) * len(langs) + lang
        total = np.bincount(lang, counts, len(langs)).astype(np.int64)
        yield _counted_rows(2, len(langs), lang=pa.array(list(langs), pa.string()), a=total)
    else:
        parts = [np.concatenate([unpack(r[c]) for r in rows]) for c in ("left", "right")]
        (lefts, left), (rights, right) = (np.unique(p, return_inverse=True) for p in parts)
        key = left * len(rights) + right
    kinds, at = np.unique(key, return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, at, counts)
    frequent = np.flatnonzero(sums >= min_count)
    # Numbers of all ranges interleave, so that they stay small.
    number = np.full(len(kinds), -1, np.int64)
    number[frequent] = np.arange(len(frequent)) * ranges + rows[0]["range"]
    found = {"gid": number[frequent], "a": sums[frequent]}
    if words:
        text = names.dictionary.take(pa.array(kinds[frequent] // len(langs)))
        found |= {"word": pc.utf8_slice_codeunits(text, 0, -1).cast(pa.string()), "lang": pa.array(list(langs), pa.string()).take(pa.array(kinds[frequent] % len(langs)))}
    else:
        found |= {"left": lefts[kinds[frequent] // len(rights)], "right": rights[kinds[frequent] % len(rights)]}
    yield _counted_rows(1, len(frequent), **found)
    number, ends = number[at], np.cumsum(sizes)
    back: dict[str, list] = {"block": [], "idx": [], "gids": []}
    for row, lo, hi in zip(rows, (ends - sizes).tolist(), ends.tolist()):
        own = number[lo:hi]
        if (own >= 0).any():
            back["block"].append(row["block"])
            back["idx"].append(pack(np.cumsum(unpack(row["idx"]))[own >= 0]))
            back["gids"].append(pack(own[own >= 0]))
    yield _counted_rows(0, len(back["block"]), **back)


def _count(ranges: int, min_count: int, words: bool):
    """Task function over rows sorted by range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["range"] != row["range"]:
                    yield from _sum_range(held, ranges, min_count, words)
                    held = []
                held.append(row)
        if held:
            yield from _sum_range(held, ranges, min_count, words)

    return scan


def _extend(last: bool):
    """Task function: the merge join of a block's kept occurrences with themselves, one position on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                idx = np.concatenate([unpack(k["idx"]) for k in row["kept"]])
                gid = np.concatenate([unpack(k["gids"]) for k in row["kept"]])
                pos, item = np.cumsum(unpack(row["pos"])), unpack(row["item"])
                place = np.full(row["n"], -1, np.int64)
                place[idx] = np.arange(len(idx))
                item = place[item]
                kept = item >= 0
                pos, item = pos[kept], item[kept]
                at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
                kinds, number, counts = np.unique(item[at] * len(idx) + item[at + 1], return_inverse=True, return_counts=True)
                if not len(kinds):
                    continue
                out = {"block": row["block"], "n": len(kinds), "c": pack(counts), "left": pack(gid[kinds // len(idx)]), "right": pack(gid[kinds % len(idx)])}
                if not last:
                    out |= {"pos": pack(np.diff(pos[at], prepend=0)), "item": pack(number)}
                yield _one_row(out, _HELD | _PAIRS)

    return scan


def _group_count(relation: DataFrame, min_count: int, words: bool) -> DataFrame:
    """The phrases of all blocks, counted (``_COUNTED``)."""
    spark = relation.sparkSession
    phrases = relation.agg(F.sum("n").alias("n")).first()["n"] or 0
    wanted = max(phrases // RANGE_PHRASES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 1 << max(wanted - 1, 0).bit_length()
    keys = _KEYS[1 if words else 2]
    held = relation.select("block", "c", *(["langs", "code", "words"] if words else ["left", "right"]))
    ranged = held.mapInArrow(_split(ranges, words), _RANGED + keys).repartition("range").sortWithinPartitions("range")
    return materialize(ranged.mapInArrow(_count(ranges, min_count, words), _COUNTED), "phrase-counts")


def mined(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, block_bytes: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """(phrases of 1, 2, .. ``max_words`` words, (lang, n) with all words).

    Columns of each table: gid, lang, text, last (word), a (count), pre and
    suf (counts of the first and last 1 .. k - 1 words); from two words on also left and
    right, the numbers of the phrases without the last and without the first word.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    relation = materialize(texts.mapInArrow(_occurrences(block_bytes or BLOCK_BYTES), _RELATION + _KEYS[1]), "occurrences")
    levels: list[DataFrame] = []
    for k in range(1, max_words + 1):
        counted = _group_count(relation, min_count, k == 1)
        frequent = counted.where("kind = 1")
        if k == 1:
            totals = counted.where("kind = 2").groupBy("lang").agg(F.sum("a").alias("n"))
            none = F.array().cast("array<long>")
            level = frequent.select("gid", "lang", F.col("word").alias("text"), F.col("word").alias("last"), "a", none.alias("pre"), none.alias("suf"))
        else:
            below = levels[-1]
            first = below.select(F.col("gid").alias("left"), "lang", "text", F.array_append("pre", F.col("a")).alias("pre"))
            after = below.select(F.col("gid").alias("right"), "last", F.array_append("suf", F.col("a")).alias("suf"))
            level = frequent.select("gid", "left", "right", "a").join(first, "left").join(after, "right")
            level = materialize(level.withColumn("text", F.concat_ws(" ", "text", "last")), f"phrases-{k}")
        levels.append(level)
        if k < max_words:
            # A block's numbers: at most one row a range.
            kept = counted.where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("idx", "gids")).alias("kept"))
            joined = relation.select("block", "pos", "item", "n").join(kept, "block")
            longer = materialize(joined.mapInArrow(_extend(k + 1 == max_words), _RELATION + _KEYS[2]), "occurrences")
            discard(relation)
            relation = longer
    return levels, totals


def _cut(k: int, words: int) -> Column:
    left, right = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(words - k - 1))

    def wide(c: Column) -> Column:
        return c.cast("decimal(15,0)")

    top = F.lit(1000000).cast("decimal(7,0)") * (wide(F.col("a")) * wide(F.col("a")))
    return F.struct(F.call_function("div", top, wide(left) * wide(right)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer one that holds it has at least ``cover`` percent of its count.
    """
    levels, totals = mined(docs, max_words, min_count)
    out = None
    for words in range(2, max_words + 1):
        level = levels[words - 1]
        if words < max_words:
            # A longer phrase's count is at most that of the phrases between, which are candidates too.
            holds = levels[words].select(F.explode(F.array("left", "right")).alias("gid"), F.col("a").alias("more"))
            level = level.join(holds.groupBy("gid").agg(F.max("more").alias("more")), "gid", "left")
            level = level.where(F.coalesce(100 * F.col("more") < cover * F.col("a"), F.lit(True)))
        best = level.select("lang", "text", "a", F.array_min(F.array(*[_cut(k, words) for k in range(1, words)])).alias("cut"))
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("text"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        F.col("text").alias("phrase"),
        "a",
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        "n",
        F.col("cut.score").cast("long").alias("score"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2,000 phrases of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
