"""Operator 3: token ids in ORC, in document order.

Layout of a token table (a folder):

* ``tokens/``    ORC files, one per range of doc_id, rows ascending by doc_id:
  part, doc_id, local_start, n_tokens, ids (array of int).  Integers are
  run-length encoded by the format; every stripe and every ``ROW_STRIDE``
  rows has min/max entries, and doc_id has Bloom filters, so a lookup by
  doc_id skips stripes and row groups without reading ids.
* ``manifest/``  ORC: part, n_docs, n_tokens, min_id, max_id, base (ids
  before the part).  A document starts at ``base + local_start``.

Documents are range-partitioned before they are encoded, so the texts are
shuffled once and ids never; the manifest is built from the files.

Encoding uses the tokenizers library.  A text is cut where the byte-level
pre-tokeniser always cuts too: before a single space between two non-space
characters, between an ASCII letter and one of ``,.;:!?)"``, and between a
single line break and an ASCII letter; a tokenizer whose added tokens hold such
a place is an error.  Cutting, finding the distinct pieces of a block and
looking them up in the task's memory are array operations; only pieces that are
new to a task reach the tokenizer.

Defined results: null text counts as empty (only the end id); rows without
doc_id come first; rows that repeat a doc_id follow each other in the order
of their texts; an empty table gives an empty token table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simtrail.llm import textvec as tv
from simtrail.llm.pieces import WordIds, cut_at, id_lists
from simtrail.session import scratch_path

END_ID = 2
ROW_STRIDE = 1000
KNOWN_WORDS = 1_000_000
BLOCK_BYTES = 1 << 23
# ASCII bytes that may be white space to the pre-tokeniser.
_BLANK = tv.class_table([*range(0x09, 0x0E), *range(0x1C, 0x21)])
_LETTER = tv.class_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_STOP = tv.class_table(b',.;:!?)"')
# Pieces that are one pre-token: Latin letters up to U+024F, or digits, with or without a space before them.
_LETTERS = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+)")
# Lead bytes of characters that may be white space (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
_DOUBT = tv.class_table([0xC2, 0xE1, 0xE2, 0xE3])


def pretoken_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of each row begin that the byte-level pre-tokeniser treats independently.

    Runs of letters end before a stop; a single line break stands alone before
    a letter; a pre-token begins at a single space with a non-space on either
    side.  A neighbour that might be white space counts as such; a cut left out
    only makes a piece longer.
    """
    def solid(at: np.ndarray) -> np.ndarray:
        """Whether the character that ends at each place is surely no white space."""
        last, two, three = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
        return ~(_BLANK[last] | ((last >= 0x80) & ((two == 0xC2) | _DOUBT[three])))

    row_end = np.zeros(len(data) + 1, dtype=bool)
    row_end[off] = True
    space = np.flatnonzero(data == 0x20)
    space = space[~row_end[space] & ~row_end[space + 1]]  # with a neighbour on either side in its row
    after = data[space + 1]
    space = space[solid(space - 1) & ~_BLANK[after] & ~_DOUBT[after]]
    line = np.flatnonzero(data == 0x0A)
    line = line[~row_end[line] & ~row_end[line + 1]]
    line = line[solid(line - 1) & _LETTER[data[line + 1]]] + 1
    stop = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
    rows = off[:-1][np.diff(off) > 0]
    starts = np.zeros(len(data) + 1, dtype=bool)
    for places in (rows, space, line, stop):
        starts[places] = True
    return np.flatnonzero(starts)


def uncut(tokens: list[str]) -> list[str]:
    """The added tokens of a tokenizer that a cut could fall into."""
    return [t for t in tokens if len(pretoken_runs(t)) > 1]


def pretoken_runs(text: str) -> list[str]:
    """The pieces of one text (see ``pretoken_starts``)."""
    data = np.frombuffer(text.encode(), np.uint8)
    return cut_at(data, pretoken_starts(data, np.array([0, len(data)]))).to_pylist()


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes: printable Latin-1 for itself, the other bytes from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


def piece_encoder(tokenizer):
    """Function from pieces to their ids.

    A piece of Latin letters or of digits, with or without a space before them,
    is one pre-token to the byte-level pre-tokeniser: its bytes, written as the
    characters that stand for them, go to the tokenizer's model at once.  All
    other pieces, and all of them if the tokenizer does more than that, take
    the whole way.
    """
    kind = json.loads(tokenizer.to_str())
    first = kind["pre_tokenizer"] or {}
    added = [t["content"] for t in kind["added_tokens"]]
    held = uncut(added)
    if held:
        raise ValueError(f"added tokens {held} hold places where texts are cut")
    plain = (
        first.get("type") == "ByteLevel"
        and first.get("use_regex", True)
        and not first.get("add_prefix_space")
        and kind["normalizer"] is None
        and kind["model"]["type"] == "BPE"
        and not any(_LETTERS.search(t) for t in added if not t.startswith("<|"))
    )
    model, byte_chars = tokenizer.model, byte_alphabet()

    def whole(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def ids_of(words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if _LETTERS.fullmatch(w):
                chars = w.replace(" ", byte_chars[0x20]) if w.isascii() else w.encode().decode("latin-1").translate(byte_chars)
                out[i] = [t.id for t in model.tokenize(chars)]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, whole([words[i] for i in rest])):
            out[i] = ids
        return out

    return ids_of if plain else whole


def _encode(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(piece_encoder(_tokenizer(path)), limit)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = tv.text_bytes(batch.column("text"))
            for first, end, d, o in tv.blocks(data, offsets, BLOCK_BYTES):
                starts = pretoken_starts(d, o)
                ids, off = id_lists(cut_at(d, starts), np.searchsorted(starts, o), known)
                # The end id after each document.
                ids = np.insert(ids, off[1:], end_id).astype(np.int32)
                off = off + np.arange(len(off))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(end - first, part, np.int32)),
                        batch.column("doc_id").slice(first, end - first),
                        pa.array(start + off[:-1]),
                        pa.array(np.diff(off)),
                        pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                    ],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(off[-1])

    return run


def write_tokens(
    docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = END_ID, known_words: int = KNOWN_WORDS
) -> None:
    """Encode ``docs`` (doc_id, text) into a token table at ``path``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    ids = ordered.mapInArrow(
        _encode(tokenizer_path, end_id, known_words),
        "part int, doc_id long, local_start long, n_tokens long, ids array<int>",
    )
    options = {
        "compression": "zstd",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_STRIDE),
    }
    ids.write.options(**options).orc(f"{path}/tokens")
    spark = docs.sparkSession
    files = spark.read.orc(f"{path}/tokens")
    totals = files.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.min("doc_id").alias("min_id"),
        F.max("doc_id").alias("max_id"),
    )
    # One row a file, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a token table; filters on doc_id reach the ORC scan."""
    files = spark.read.orc(f"{path}/tokens")
    bases = spark.read.orc(f"{path}/manifest").select("part", "base")
    # One row a file on the right: a table of known size, which Spark broadcasts if small.
    joined = files.join(bases, "part")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        at = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
        raw = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
