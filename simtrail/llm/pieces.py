"""Operator 9: SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut at single spaces into marked words (U+2581 and the word), so a
word's pieces never depend on its neighbours.  The distinct marked words of
a block of documents are sorted; walking them in order is a depth-first walk
of their trie, and the forward scores (best score, last piece, vocabulary
matches still open) of a common prefix are computed once and reused by all
words that share it.

The piece file may hold log-probabilities (unigram models) or merge ranks
(BPE models, scores 0, -1, -2, ...).  Ranks are no log-probabilities, so for
them ``score = -ln(2 + rank)`` is used (``scores="file"`` takes the numbers
as they are).  Characters outside the vocabulary, and U+2581 itself in a
text, become byte pieces; each costs more than any piece.  Ties go to the
longer last piece.  Decoding gives back every text exactly.

Defined results: null and empty texts have no ids and decode to the empty
text; every row is returned, repeated and id-less ones too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.shared import share, shared
from simtrail.session import bound_batches

MARK = "▁"
# Words remembered in a task; beyond it the memory starts anew.
KNOWN_WORDS = 250_000
BLOCK_BYTES = 1 << 20
# Words encoded at a time; ids decoded at a time.
NEW_WORDS = 5_000
DECODED_IDS = 1 << 18


class Pieces:
    """A piece vocabulary: bounded by the model file, so it may be broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], usable: list[bool]):
        self.pieces, self.scores, self.byte_ids, self.usable = pieces, scores, byte_ids, usable

    @classmethod
    def load(cls, path: str | None = None, scores: str = "auto") -> Pieces:
        """Read a ``.model`` file (default: the public 32k vocabulary)."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        usable = [
            not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)
        ]
        given = [model.get_score(i) for i in range(size)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ranks = scores == "auto" and all(s <= 0 and s == int(s) for s, u in zip(given, usable, strict=True) if u)
        if ranks:
            given = [-math.log(2 - s) for s in given]
        return cls(pieces, given, byte_ids, usable)

    def trie(self) -> dict:
        """Nested dicts by character; a piece's node holds (id, score) under the empty string."""
        root: dict = {}
        for i, (piece, score, use) in enumerate(zip(self.pieces, self.scores, self.usable, strict=True)):
            if use and piece:
                node = root
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (i, score)
        return root

    def byte_score(self) -> float:
        return min(s for s, u in zip(self.scores, self.usable, strict=True) if u) - 10.0

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) that each id decodes to; control pieces decode to nothing."""
        of_byte = {i: b for b, i in enumerate(self.byte_ids)}
        out = [
            bytes([of_byte[i]]) if i in of_byte else p.replace(MARK, " ").encode() if u else b""
            for i, (p, u) in enumerate(zip(self.pieces, self.usable, strict=True))
        ]
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def encode_sorted(words: list[str], root: dict, byte_ids: list[int], byte_score: float) -> list[list[int]]:
    """Ids of each marked word; ``words`` sorted and distinct.

    Stacks by depth hold the forward pass of the current trie path: ``best``
    score, the ``step`` (start depth, id or None for bytes) that reached it,
    and ``open_``, the vocabulary nodes of the pieces begun on the path.
    Moving to the next word drops what lies below the common prefix.
    """
    best, step, open_ = [0.0], [None], [[]]
    before, out = "", []
    for word in words:
        depth, most = 0, min(len(before), len(word))
        while depth < most and before[depth] == word[depth]:
            depth += 1
        del best[depth + 1 :], step[depth + 1 :], open_[depth + 1 :]
        for j in range(depth, len(word)):
            c = word[j]
            alive = []
            if j and c == MARK:  # the mark itself inside a word: bytes only
                top, how = best[j] + 3 * byte_score, (j, None)
            else:
                top, how = best[j] + len(c.encode("utf-8", "surrogatepass")) * byte_score, (j, None)
                for start, node in open_[j]:
                    node = node.get(c)
                    if node is not None:
                        alive.append((start, node))
                        end = node.get("")
                        if end is not None and (s := best[start] + end[1]) > top:
                            top, how = s, (start, end[0])
                node = root.get(c)
                if node is not None:
                    alive.append((j, node))
                    end = node.get("")
                    if end is not None and (s := best[j] + end[1]) > top:
                        top, how = s, (j, end[0])
            best.append(top)
            step.append(how)
            open_.append(alive)
        ids, at = [], len(word)
        while at:
            start, piece = step[at]
            if piece is None:
                ids.extend(byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        out.append(ids)
        before = word
    return out


class WordIds:
    """Ids of the words met so far in a task: an Arrow array of words, their ids flat with offsets; reset when large."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.off = np.empty(0, np.int32), np.zeros(1, np.int64)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the memory; only distinct words are looked up, only new ones encoded."""
        coded = words.dictionary_encode()
        kinds = coded.dictionary
        at = pc.fill_null(pc.index_in(kinds, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.words) and len(self.words) + len(new) > self.limit:
            self.clear()
            new = np.arange(len(kinds))
        if len(new):
            fresh = kinds.take(pa.array(new))
            order = pc.sort_indices(fresh)
            at[new[order.to_numpy()]] = len(self.words) + np.arange(len(new))
            fresh = fresh.take(order)
            flat, lens = [self.flat], []
            for first in range(0, len(fresh), NEW_WORDS):
                ids = self.encode(fresh.slice(first, NEW_WORDS).to_pylist())
                lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(lens[-1].sum())))
            self.flat = np.concatenate(flat)
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.concatenate(lens))])
            self.words = pa.concat_arrays([self.words, fresh])
        return at[coded.indices.to_numpy()]


def cut_at(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words of a byte array that begin at ``starts`` and end where the next one begins."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def spaced_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) with a space put before every text that is not empty, so that each word has one."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return tv.text_bytes(pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(none, texts, space)))


def id_lists(words: pa.Array, word_off: np.ndarray, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets) of texts whose words are ``words``, with offsets by row."""
    codes = known.codes(words)  # may extend the memory
    ids, lens = tv.ragged_take(known.flat, known.off, codes)
    return ids, np.concatenate([[0], np.cumsum(lens)])[word_off]


def _encoder(vocabulary, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(vocabulary)
        root, byte_score = pieces.trie(), pieces.byte_score()
        # A word is remembered with the space before it and marked when it is encoded.
        known = WordIds(lambda ws: encode_sorted([MARK + w[1:] for w in ws], root, pieces.byte_ids, byte_score), limit)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "__text"]
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                data, off = spaced_words(some.column("__text"))
                for first, end, d, o in tv.blocks(data, off, BLOCK_BYTES):
                    starts = np.flatnonzero(d == 0x20)
                    ids, id_off = id_lists(cut_at(d, starts), np.searchsorted(starts, o), known)
                    arrays = [pa.ListArray.from_arrays(pa.array(id_off.astype(np.int32)), pa.array(ids)), pa.array(np.diff(id_off))]
                    rest = [some.column(c).slice(first, end - first) for c in names]
                    yield pa.RecordBatch.from_arrays([*rest, *arrays], [*names, "ids", "n_tokens"])

    return run


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", known_words: int = KNOWN_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` of column ``text``; existing columns of these names are replaced."""
    rest = docs.drop("ids", "n_tokens", "__text")
    vocabulary = share(docs.sparkSession, pieces)
    bound_batches(docs.sparkSession)
    inner = rest.withColumn("__text", F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return inner.mapInArrow(_encoder(vocabulary, known_words), f"{schema}, ids array<int>, n_tokens long")


def _decoder(vocabulary, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, off = shared(vocabulary).piece_bytes()
        for batch in batches:
            column = batch.column("__ids")
            lens = np.asarray(column.value_lengths().fill_null(0))
            ids = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lens)])
            row = 0
            while row < batch.num_rows:
                end = min(max(int(np.searchsorted(at, at[row] + DECODED_IDS, side="right")) - 1, row + 1), batch.num_rows)
                data, sizes = tv.ragged_take(table, off, ids[at[row] : at[end]])
                ends = np.concatenate([[0], np.cumsum(sizes)])[at[row : end + 1] - at[row]]
                raw = data.tobytes()
                # The first word's mark is no character of the text.
                texts = [raw[x + 1 : y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
                names = [c for c in batch.schema.names if c != "__ids"]
                rest = [batch.column(c).slice(row, end - row) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*names, out])
                row = end

    return run


def decode(tokens: DataFrame, pieces: Pieces, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of column ``ids`` as column ``out``."""
    rest = tokens.drop(out, "__ids")
    vocabulary = share(tokens.sparkSession, pieces)
    bound_batches(tokens.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.withColumn("__ids", F.col(ids)).mapInArrow(_decoder(vocabulary, out), f"{schema}, `{out}` string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, decoded, exact (decoded equals the text; null counts as empty)."""
    pieces = Pieces.load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, pieces), pieces)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "ids", "n_tokens", "decoded", exact.alias("exact"))
