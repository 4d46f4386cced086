"""Operator 6: near-duplicate lines, one occurrence kept per group.

A line (``\\n``-split) is normalised to its ASCII lower-cased words of letters
and digits, with every run of ASCII digits written ``0``.  In scripts written
without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) every character
is a word.  In the query and the pipeline every line with a word
(``EXACT_WORDS``) takes part in step 2; steps 3 to 6 compare lines of at least
``MIN_WORDS`` words.  Without ``exact_words``, ``without_duplicate_lines`` leaves
shorter lines out of step 2 as well.

1. One scan writes (doc_id, line number, key, SimHash and other bits of its
   words) of each such line; the key is a 64-bit hash of the normalised line.
   It counts words and blocks as well, in tables of ``WORD_COUNTERS`` and
   ``BLOCK_COUNTERS`` counters.
2. Equal lines collapse to one row per key with its first occurrence.
3. Lines are cut into overlapping blocks of three words, and joined on blocks
   (pigeonhole): an edit of one word breaks at most three, so two lines within
   the similarity differ in few blocks, and the first ``broken + 1`` blocks of
   each, in one fixed order of all blocks (those that stand out as common last,
   then rarest words first), have one in common.  Lines that are similar only
   with one edit (up to nine words) meet on themselves with one word left out.
   (A similarity below 0.8 may leave no run of three; then blocks have two
   words.)  Most of these blocks occur in one line only, so they are sorted out
   in packed form first: a task writes the blocks and keys of all its lines as
   arrays by range of the block, another finds the blocks of a range that
   several lines share, as sets of lines; blocks of the same lines are one set,
   and only the different sets become rows.
4. All lines of a block of at most ``WHOLE_LINES`` lines are compared with each
   other: pairs whose SimHashes lie within ``MAX_BITS`` and that fit in length
   and in the parity of their words (an edit turns at most two of 512 bits) and
   in the numbers of their words in 16 classes (an edit takes one away and adds
   one at most), so that these rule out no similar pair.  Each line with the nearest of these is
   verified first; most blocks are this small.  In a larger block every line is
   paired with the block's most central line, under the same conditions.
5. A pair is linked if the edit similarity ``1 - edit distance / longer length``
   of the normalised lines, both counted in words, is at least ``SIMILARITY``.
6. Larger blocks that still hold several components are dealt out again in groups of
   at most ``BLOCK_LINES`` lines, two to a task group; only lines outside a
   block's main component are dealt to other groups, so a block that is one
   component but for a few lines costs a few passes over it.  All pairs of
   different components within ``MAX_BITS`` are verified as well; before that,
   each line only with the nearest one of another component, because many
   copies of a line would else make all their pairs, and components that these
   links join need no further pairs (nor do the small blocks' other pairs).
   Blocks are taken in up to ``PARTS`` parts, one after another, so that only
   one part's shuffles lie on disk.
7. Every connected group keeps its first occurrence in (doc_id, line number)
   order; all other occurrences are removed.

The blocks of step 3 lose no pair.  The SimHash bound may: one word of five
or two of ten move 13 of 64 bits on average, more than 28 next to never
(README: measured recall).  Blocks of the SimHash itself cannot carry step 3 at
this similarity, so it only picks the pairs to verify.

Defined results: null text counts as empty and is returned unchanged; rows
without doc_id take no part and pass unchanged; rows that repeat a doc_id are
one document (each keeps the same lines); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.linking import bloom, centrality, chunk_rows, components, counter_table, dealt, in_bloom, merged, open_members, star_pairs
from simtrail.session import bound_batches, discard, materialize, materialize_hashes

MIN_WORDS = 5
EXACT_WORDS = 1
MAX_BITS = 28
SIMILARITY = 0.8
BLOCK_LINES = 2048
# Blocks of up to so many lines are compared whole.
WHOLE_LINES = 32
# Columns of the parities of a line's words, 64 bits each.
MASKS = [f"mask{i}" for i in range(8)]
# Columns of the numbers of a line's words in 16 classes.
LOADS = ["load0", "load1"]
# Open blocks are compared, and pairs verified, in up to so many parts of at least so many lines or pairs.
PARTS, PART_LINES = 4, 1 << 22
PAIR_PARTS, PART_PAIRS = 8, 1 << 19
# Groups up to this size are compared many at once.
SMALL_GROUP = 64
# Pairs of a larger group compared at once.
MATRIX = 1 << 20
# Counters of words, and of blocks.
WORD_COUNTERS, BLOCK_COUNTERS = 1 << 19, 1 << 21
# Blocks of a range of about so many; text in a task's block; packed blocks taken in at a time.
RANGE_BLOCKS = 1 << 20
BLOCK_BYTES = 1 << 19
FOLD_BLOCKS = 1 << 20
# Rows of shared blocks that a task holds before it gives away those of large blocks.
HELD_ROWS = 1 << 21
_U = np.uint64
_WORD_FACTOR = _U(0x9E3779B97F4A7C15)


# Characters that are words by themselves: Thai and Lao, Burmese, Khmer, U+3000 to U+9FFF, the second plane.
_SINGLE = re.compile("([\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff\U00020000-\U0002ffff])")


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of rows of bytes; characters of scripts without spaces are words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = (data >= 0x80) | ((data | np.uint8(0x20)) - np.uint8(0x61) < 26) | (data - np.uint8(0x30) < 10)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([np.zeros(int(inside[0]), np.int64), turns, np.full(int(inside[-1]), len(data))])
    starts, ends = turns[::2], turns[1::2]
    cuts = off[(off > 0) & (off < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # words end with their row
    if len(cuts):
        starts, ends = (np.insert(v, np.searchsorted(v, cuts), cuts) for v in (starts, ends))
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return starts, ends
    lead = lead[lead + 2 < len(data)]
    one, two = data[lead], data[lead + 1]
    wide = (one == 0xF0) & (two >= 0xA0) & (two <= 0xAF)
    single = (one >= 0xE3) & (one <= 0xE9) | wide
    single |= (one == 0xE0) & ((two >= 0xB8) & (two <= 0xBB))
    single |= (one == 0xE1) & ((two >= 0x80) & (two <= 0x82) | (two == 0x9E) | (two == 0x9F))
    if not single.any():
        return starts, ends
    cuts = np.concatenate([lead[single], (lead + 3 + wide)[single]])
    of = np.searchsorted(starts, cuts, side="right") - 1
    cuts = cuts[(of >= 0) & (cuts < ends[of])]
    all_starts = np.union1d(starts, cuts)
    of = np.searchsorted(starts, all_starts, side="right") - 1
    return all_starts, np.minimum(ends[of], np.append(all_starts[1:], len(data)))


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes of all words at a time."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))  # the eight bytes from each position on
    size = ends - starts
    out = tv.mix64((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _WORD_FACTOR)
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        left = size[more] - k
        out[more] = tv.mix64(out[more] * _U(3) + (eight[starts[more] + k] & _FIRST_BYTES[np.minimum(left, 8)]))
        more, k = more[left > 8], k + 8
    return out


def line_offsets(data: np.ndarray, off: np.ndarray):
    """(line starts, line ends, line offsets by row) of ``\\n``-split rows; an empty row has no line."""
    breaks = np.flatnonzero(data == 10)
    filled = np.diff(off) > 0
    starts = np.sort(np.concatenate([off[:-1][filled], breaks + 1]))
    ends = np.sort(np.concatenate([off[1:][filled], breaks]))
    line_off = np.searchsorted(breaks, off) + np.concatenate([[0], np.cumsum(filled)])
    return starts, ends, line_off


# The eight bits of a byte as eight one-byte counters of a 64-bit word.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def simhashes(words: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of word hashes (words weighted by count)."""
    rows = np.flatnonzero(np.diff(word_off) > 0)
    out = np.zeros(len(word_off) - 1, np.uint64)
    if not len(rows):
        return out
    # Pieces of at most 255 words, so that no one-byte counter overflows.
    lens = np.diff(word_off)[rows]
    pieces = -(-lens // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(word_off[rows], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    lanes = words.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(rows), 8, 8), np.int32)
    for lane in range(8):
        sums = np.add.reduceat(_COUNTERS[lanes[:, lane]], starts)
        ones[:, lane] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int32), first, axis=0)
    most = ones.reshape(len(rows), 64) * 2 > lens[:, None]
    out[rows] = np.packbits(most, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()
    return out


def parity_masks(words: np.ndarray, word_off: np.ndarray) -> list[np.ndarray]:
    """512 bits of each row of word hashes, each the parity of the words that fall on it: an edit of one word turns at most two."""
    rows = np.flatnonzero(np.diff(word_off) > 0)
    out = np.zeros((len(MASKS), len(word_off) - 1), np.uint64)
    bit = _U(1) << (words >> _U(8) & _U(63))
    which = words >> _U(14) & _U(len(MASKS) - 1)
    for i in range(len(MASKS) if len(rows) else 0):
        out[i, rows] = np.bitwise_xor.reduceat(np.where(which == _U(i), bit, _U(0)), word_off[rows])
    return list(out)


def squeeze(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each digit run written as one '0', and the positions left out; a run ends with its row."""
    digit = data - np.uint8(0x30) < 10
    out = data + (data - np.uint8(0x41) < 26) * np.uint8(0x20)
    out[digit] = 0x30
    gone = np.flatnonzero(digit[1:] & digit[:-1]) + 1
    gone = gone[~np.isin(gone, off)]
    return np.delete(out, gone), gone


def line_table(data: np.ndarray, off: np.ndarray, with_sims: bool = True, with_masks: bool = False, with_words: bool = False):
    """Lines of each row: starts, ends, line offsets, word counts, keys, SimHashes (if asked for; ``with_masks``: a list of them,
    the parity masks and the loads; ``with_words``: the hashed words and their offsets by line as well, at the end)."""
    starts, ends, line_off = line_offsets(data, off)
    squeezed, gone = squeeze(data, off)
    row_at, line_at = (at - np.searchsorted(gone, at) for at in (off, starts))
    w_start, w_end = word_spans(squeezed, row_at)  # a line break is no word byte
    words = word_hashes(squeezed, w_start, w_end)
    word_off = np.append(np.searchsorted(w_start, line_at), len(w_start))
    sims = None
    if with_sims or with_masks:
        sims = simhashes(tv.span_hashes(squeezed, w_start, w_end), word_off)
    if with_masks:
        sims = [sims, *parity_masks(words, word_off), *word_loads(words, word_off)]
    out = starts, ends, line_off, np.diff(word_off), tv.row_hashes(words, word_off, 3), sims
    return (*out, words, word_off) if with_words else out


def word_loads(words: np.ndarray, word_off: np.ndarray) -> list[np.ndarray]:
    """How many words of each row fall on each of 16 classes, up to 255, as bytes of two numbers."""
    line = np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))
    loads = np.bincount(line * 16 + (words >> _U(20) & _U(15)).astype(np.int64), minlength=16 * (len(word_off) - 1))
    return list(np.minimum(loads, 255).astype(np.uint8).reshape(-1, 16).view(np.uint64).T.copy())


def fitting_loads(x: list[np.ndarray], y: list[np.ndarray], edits: np.ndarray) -> np.ndarray:
    """Which pairs of lines (as their loads) may be so few edits apart: an edit takes one word away at most and adds one at most."""
    x, y = (np.stack(v, axis=1).view(np.uint8).astype(np.int16) for v in (x, y))
    gained = y - x
    return (np.maximum(gained, 0).sum(axis=1) <= edits) & (np.maximum(-gained, 0).sum(axis=1) <= edits)


def most_edits(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Edits that a line of ``n`` words may be away from one that is no longer."""
    return ((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def most_broken(n: np.ndarray | int, q: int, similarity: float) -> np.ndarray:
    """Runs of ``q`` words of a line of ``n`` words that a similar line may lack: an edit breaks ``q`` of them, a word put in one less."""
    return np.max([q * most_edits(np.asarray(n) + more, similarity) - more for more in range(12)], axis=0)


@cache
def one_edit_words(similarity: float) -> int:
    """The longest lines that are similar only with at most one edit."""
    n = 1
    while most_edits(n + 1, similarity) <= 1:
        n += 1
    return n


@cache
def block_words(similarity: float) -> int:
    """Words of a block: 3 if every line that meets a line with two edits keeps a run of three, else 2."""
    n = np.arange(1, 400)
    longest = np.max([np.where(n + more - most_edits(n + more, similarity) <= n, n + more, n) for more in range(400)], axis=0)
    n = n[longest > one_edit_words(similarity)]
    return 3 if (n - 2 > most_broken(n, 3, similarity)).all() else 2


def left_out(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of lines of ``n`` words: of each as it is and without one of its words (lines by ``n + 1``)."""
    table = tv.mix64(words[starts[:, None] + np.arange(n)])
    by = tv.gram_multipliers(n)
    before = np.concatenate([np.zeros((len(starts), 1), np.uint64), np.cumsum(table * by, axis=1, dtype=np.uint64)], axis=1)
    # The words after the one left out move up by one place.
    moved = np.concatenate([np.cumsum((table[:, 1:] * by[:-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(starts), 1), np.uint64)], axis=1)
    without = tv.mix64(before[:, :-1] + moved + _U(n - 1))
    return np.concatenate([tv.mix64(before[:, -1:] + _U(n)), without], axis=1)


def block_order(counts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Two tables by which blocks are ordered, of ``seen_words``' counters: how common a word is, how common a block is.

    A block whose counter stands out (twice the mean, which other blocks on it make) comes after all that do not.
    """
    words, blocks = counts[:WORD_COUNTERS], counts[WORD_COUNTERS:]
    level = np.where(blocks > 2 * blocks.mean() + 2, 4 * np.log2(np.maximum(blocks, 1)), 0)
    return np.round(16 * np.log2(np.maximum(words, 1))).astype(np.uint16), np.minimum(level, 255).astype(np.uint8)


def line_runs(n_words: np.ndarray, first: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, position of the first word) of the runs of ``q`` words of the lines ``first``."""
    line = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
    at = np.flatnonzero((line[q - 1 :] == line[: max(len(line) - q + 1, 0)]) & first[line[q - 1 :]])
    return line[at], at


def first_lines(keys: np.ndarray, n_words: np.ndarray, min_words: int) -> np.ndarray:
    """Whether a line is the first one with its key and long enough."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first & (n_words >= max(min_words, 2))


def rare_blocks(data: np.ndarray, off: np.ndarray, min_words: int, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(block, key): the blocks of each different line by which it is dealt out (see step 3)."""
    starts, _, _, n_words, keys, _, words, word_off = line_table(data, off, with_sims=False, with_words=True)
    first = first_lines(keys, n_words, min_words)
    least, q = one_edit_words(similarity), block_words(similarity)
    blocks, of = [], []
    for n in range(2, least + 1):
        at = np.flatnonzero(first & (n_words == n))
        if len(at) and most_edits(n + 1, similarity) > 0:
            blocks.append(left_out(words, word_off[at], n).ravel())
            of.append(np.repeat(keys[at], n + 1))
    # Lines that a line with more than one edit may be similar to.
    first &= n_words + most_edits(least + 1, similarity) > least
    line, at = line_runs(n_words, first, q)
    block = tv.rolling(words, q)[at]
    # One order of all blocks: common ones last, rarest words first, then by hash.
    word, level = order
    common = word[(words & _U(len(word) - 1)).astype(np.int64)]
    rare = level[(block & _U(len(level) - 1)).astype(np.int64)].astype(np.uint64) << _U(56)
    rare |= sum(common[at + i].astype(np.uint64) for i in range(q)) << _U(45)
    bits = _U(max(len(starts).bit_length(), 1))
    by = np.argsort((line.astype(np.uint64) << (_U(64) - bits)) | ((rare | (block >> _U(19))) >> bits))
    line, block = line[by], block[by]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (block[1:] != block[:-1])
    line, block = line[new], block[new]
    size = np.bincount(line, minlength=len(starts))
    rank = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    use = rank <= most_broken(np.arange(int(n_words.max(initial=0)) + 1), q, similarity)[n_words[line]]
    blocks.append(block[use])
    of.append(keys[line[use]])
    return np.concatenate(blocks), np.concatenate(of)


def seen_words(counts: np.ndarray, keys: np.ndarray, words: np.ndarray, n_words: np.ndarray, min_words: int, q: int) -> None:
    """Count the words, and the blocks of the different lines, in ``counts``."""
    np.add.at(counts, (words & _U(WORD_COUNTERS - 1)).astype(np.int64), np.uint32(1))
    _, at = line_runs(n_words, first_lines(keys, n_words, min_words), q)
    np.add.at(counts, WORD_COUNTERS + (tv.rolling(words, q)[at] & _U(BLOCK_COUNTERS - 1)).astype(np.int64), np.uint32(1))


def seen_rows(counts: np.ndarray) -> pa.RecordBatch:
    """The counters of a task as chunk rows; those of blocks up to 255 (they only order the blocks)."""
    words, blocks = chunk_rows(counts[:WORD_COUNTERS]), chunk_rows(np.minimum(counts[WORD_COUNTERS:], 255).astype(np.uint8), WORD_COUNTERS)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in zip(words.columns, blocks.columns)], words.schema.names)


def _count_words(min_words: int, q: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WORD_COUNTERS + BLOCK_COUNTERS, np.uint32)
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            for _, _, d, o in tv.blocks(data, off):
                _, _, _, n_words, keys, _, words, _ = line_table(d, o, with_sims=False, with_words=True)
                seen_words(counts, keys, words, n_words, min_words, q)
        yield seen_rows(counts)

    return scan


def _pack_blocks(min_words: int, similarity: float, ranges: int, order):
    """Task function: the blocks of the lines and their keys as one row of arrays a range; of a block the 32 bits that follow its range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = ranges.bit_length() - 1
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            for _, _, d, o in tv.blocks(data, off, BLOCK_BYTES):
                block, key = rare_blocks(d, o, min_words, similarity, order.value)
                which, of = by_range(block, ranges)
                block = (block[of] >> _U(32 - bits)).astype(np.uint32)  # the low 32 bits
                yield packed_rows(which, [block.astype("<u4"), key[of].astype("<u8")], ["blocks", "keys"])

    return scan


def by_range(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range of each, positions): hashes in the order of their range, which is their first bits."""
    which = (hashes >> _U(65 - ranges.bit_length())) if ranges > 1 else np.zeros(len(hashes), np.uint64)
    which = which.astype(np.uint16 if ranges <= 1 << 16 else np.int64)
    of = np.argsort(which, kind="stable")
    return which[of], of


def packed_rows(which: np.ndarray, values: list[np.ndarray], names: list[str], ends: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """One row a range of arrays sorted by range; ``ends``: the offsets of the items in each array, where they are not the positions."""
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])[: len(which)])
    last = np.append(first[1:], len(which))[: len(first)]
    columns = []
    for i, v in enumerate(values):
        at = ends[i] if ends else np.arange(len(v) + 1)
        columns.append(pa.array([v[at[x] : at[y]].tobytes() for x, y in zip(first.tolist(), last.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(which[first].astype(np.int32)), *columns], ["range", *names])


class SharedBlocks:
    """The blocks of one range met so far, each with one key; ``add`` gives (block, key) of those that two keys share.

    Memory follows the different blocks of the range, not their occurrences.
    """

    def __init__(self):
        self.blocks, self.keys, self.given = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)

    def add(self, blocks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(blocks) < 1 << 32 and int(blocks.max(initial=_U(0))) < 1 << 32:  # numbers sort faster than positions
            both = np.sort((blocks << _U(32)) | np.arange(len(blocks), dtype=np.uint64))
            blocks, keys = both >> _U(32), keys[(both & _U(0xFFFFFFFF)).astype(np.int64)]
        else:
            by = np.argsort(blocks)
            blocks, keys = blocks[by], keys[by]
        same = blocks[1:] == blocks[:-1]
        several = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(blocks) else np.empty(0, np.int64)
        keys[several] = keys[several[np.lexsort((keys[several], blocks[several]))]]
        new = np.ones(len(blocks), bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | (keys[1:] != keys[:-1])
        blocks, keys = blocks[new], keys[new]
        first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(blocks)))
        kinds = blocks[first]
        at = np.searchsorted(self.blocks, kinds)
        known = at < len(self.blocks)
        known[known] = self.blocks[at[known]] == kinds[known]
        old = at[known]
        shared = size > 1
        shared[known] |= self.given[old] | (self.keys[old] != keys[first][known])
        out = np.repeat(shared, size)
        late = old[shared[known] & ~self.given[old]]  # the key held for a block that turns out to be shared
        given = np.concatenate([blocks[out], self.blocks[late]]), np.concatenate([keys[out], self.keys[late]])
        self.given[old[shared[known]]] = True
        merged_blocks = np.concatenate([self.blocks, kinds[~known]])
        by = np.argsort(merged_blocks, kind="stable")
        self.blocks = merged_blocks[by]
        self.keys = np.concatenate([self.keys, keys[first][~known]])[by]
        self.given = np.concatenate([self.given, shared[~known]])[by]
        return given


class SharedSets:
    """Takes the (block, key) that ``SharedBlocks`` gives; ``settle`` gives them as sets of lines.

    Blocks of the same lines are one set, named by its lines.  Blocks of more
    than ``WHOLE_LINES`` lines are given as they are; where rows pile up they
    go on at once, so that memory follows the small sets.
    """

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.limit, self.large = 0, HELD_ROWS, np.empty(0, np.uint64)

    def add(self, blocks: np.ndarray, keys: np.ndarray) -> bool:
        """Whether ``settle`` is due."""
        self.held.append((blocks, keys))
        self.rows += len(blocks)
        return self.rows > self.limit

    def settle(self, last: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """((block, key) of large blocks, (name, size, keys) of the other sets); the others only at ``last``."""
        blocks, keys = (np.concatenate([np.empty(0, np.uint64), *v]) for v in zip(*self.held)) if self.held else (np.empty(0, np.uint64),) * 2
        by = np.lexsort((keys, blocks))
        blocks, keys = blocks[by], keys[by]
        new = np.append(True, (blocks[1:] != blocks[:-1]) | (keys[1:] != keys[:-1]))[: len(blocks)]
        blocks, keys = blocks[new], keys[new]
        first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])[: len(blocks)])
        size = np.diff(np.append(first, len(blocks)))
        large = (size > WHOLE_LINES) | np.isin(blocks[first], self.large)
        self.large = np.union1d(self.large, blocks[first[large]])
        out = np.repeat(large, size)
        given, (blocks, keys), size = (blocks[out], keys[out]), (blocks[~out], keys[~out]), size[~large]
        if not last:
            self.held, self.rows = [(blocks, keys)], len(blocks)
            self.limit = HELD_ROWS + 2 * len(blocks)
            return given, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))
        first = np.cumsum(size) - size
        names = tv.mix64(np.add.reduceat(tv.mix64(keys), first) + size.astype(np.uint64)) if len(size) else np.empty(0, np.uint64)
        names, one = np.unique(names, return_index=True)
        keys, size = tv.ragged_take(keys, np.append(first, len(keys)), one)
        return given, (names, size, keys)


def _shared_sets(ranges: int):
    """Task function over packed blocks sorted by range: the sets of lines that share a block, one row of arrays a range of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, now, state, sets = 0, -1, SharedBlocks(), SharedSets()

        def fold() -> bool:
            return sets.add(*state.add(*(np.concatenate(v).astype(np.uint64) for v in zip(*held)))) if held else False

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            (blocks, keys), (names, sizes, members) = sets.settle(last)
            which, of = by_range(names, ranges)
            own, lens = tv.ragged_take(members, np.append(0, np.cumsum(sizes)), of)
            ends = np.append(0, np.cumsum(lens))
            out = packed_rows(which, [names[of].astype("<u8"), lens.astype(np.uint8), own.astype("<u8")], ["names", "sizes", "keys"], [np.arange(len(of) + 1)] * 2 + [ends])
            yield out
            if len(blocks):
                # The range and the 32 bits that follow it.
                full = blocks + (_U(now) << _U(32))
                for at in range(0, len(full), FOLD_BLOCKS):
                    one = slice(at, at + FOLD_BLOCKS)
                    values = [full[one].astype("<u8").tobytes(), None, keys[one].astype("<u8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], out.schema.names)

        for batch in batches:
            for which, blocks, keys in zip(*(batch.column(c) for c in ("range", "blocks", "keys"))):
                if which.as_py() != now:
                    fold()
                    yield from rows(True)
                    held, size, now, state, sets = [], 0, which.as_py(), SharedBlocks(), SharedSets()
                held.append((np.frombuffer(blocks.as_py(), "<u4"), np.frombuffer(keys.as_py(), "<u8")))
                size += len(held[-1][0])
                if size >= FOLD_BLOCKS:
                    due = fold()
                    held, size = [], 0
                    if due:
                        yield from rows(False)
        fold()
        yield from rows(True)

    return run


def _different_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over packed sets sorted by range: (bucket, id, large) of every different set, and of the large blocks."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, now, seen = 0, -1, np.empty(0, np.uint64)

    def out(bucket: np.ndarray, id: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tv.signed(bucket)), pa.array(tv.signed(id)), pa.array(np.full(len(id), large))], ["bucket", "id", "large"])

    def different() -> pa.RecordBatch:
        nonlocal seen
        names, sizes, keys = (np.concatenate([np.empty(0, t), *v]) for t, v in zip((np.uint64, np.int64, np.uint64), zip(*held) if held else [()] * 3))
        names, one = np.unique(names, return_index=True)
        new = ~np.isin(names, seen)
        seen = np.union1d(seen, names[new])
        id, size = tv.ragged_take(keys, np.append(0, np.cumsum(sizes)), one[new])
        return out(np.repeat(names[new], size), id, False)

    for batch in batches:
        for which, names, sizes, keys in zip(*(batch.column(c) for c in ("range", "names", "sizes", "keys"))):
            names, keys = (np.frombuffer(v.as_py(), "<u8") for v in (names, keys))
            if which.as_py() != now or rows > FOLD_BLOCKS:
                yield different()
                held, rows = [], 0
            if which.as_py() != now:
                now, seen = which.as_py(), np.empty(0, np.uint64)
            if sizes.is_valid:
                held.append((names, np.frombuffer(sizes.as_py(), np.uint8).astype(np.int64), keys))
                rows += len(keys)
            else:
                yield out(names, keys, True)
    yield different()


def shared_blocks(texts: DataFrame, min_words: int, similarity: float, counts: DataFrame | None = None) -> DataFrame:
    """(bucket, id, large): the lines of each block that several different lines share; blocks of the same lines are one bucket.

    ``large``: blocks of more than ``WHOLE_LINES`` lines (rows of these may be
    repeated).  ``counts``: the chunk rows of ``seen_rows``, if counted before.
    """
    spark: SparkSession = texts.sparkSession
    q = block_words(similarity)
    if counts is None:
        counts = texts.mapInArrow(_count_words(min_words, q), "chunk int, counts binary")
    counts = counter_table(counts, WORD_COUNTERS + BLOCK_COUNTERS)
    sent = spark.sparkContext.broadcast(block_order(counts, q))
    wanted = max(int(counts[:WORD_COUNTERS].sum() * q * (1 - similarity)) // RANGE_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 1 << max(wanted - 1, 0).bit_length()
    packed = texts.mapInArrow(_pack_blocks(min_words, similarity, ranges, sent), "range int, blocks binary, keys binary")
    sets = packed.repartition("range").sortWithinPartitions("range").mapInArrow(_shared_sets(ranges), "range int, names binary, sizes binary, keys binary")
    rows = sets.repartition("range").sortWithinPartitions("range").mapInArrow(_different_sets, "bucket long, id long, large boolean")
    return materialize(rows, "line-blocks")


def _scan_lines(exact_words: int, min_words: int, q: int):
    """Task function: the lines, and at the end the counters of their words and blocks as rows without a line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WORD_COUNTERS + BLOCK_COUNTERS, np.uint32)
        names = ["doc_id", "line_no", "key", "sim", *MASKS, *LOADS, "size"]
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for first, _, d, o in tv.blocks(data, off):
                _, _, line_off, n_words, keys, bits, words, _ = line_table(d, o, with_masks=True, with_words=True)
                seen_words(counts, keys, words, n_words, min_words, q)
                rows = np.repeat(np.arange(len(o) - 1), np.diff(line_off))
                number = np.arange(len(rows)) - line_off[rows]
                use = np.flatnonzero(n_words >= exact_words)
                columns = [
                    ids.take(pa.array(rows[use] + first)),
                    pa.array(number[use].astype(np.int32)),
                    pa.array(tv.signed(keys[use])),
                    *[pa.array(tv.signed(m[use])) for m in bits],
                    pa.array(n_words[use].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(use), pa.int32()), pa.nulls(len(use), pa.binary())], [*names, "chunk", "counts"])
        chunks = seen_rows(counts)
        kinds = [pa.int32() if c in ("line_no", "size") else pa.int64() for c in names]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(chunks), k) for k in kinds), *chunks.columns], [*names, "chunk", "counts"])

    return scan


def normal_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The normalised text of lines: their words, single spaces between."""
    norm, gone = squeeze(data, starts)
    norm[~tv.ALNUM[norm]] = 0x20
    held, out = norm.tobytes(), []
    for a, b in zip(*((at - np.searchsorted(gone, at)).tolist() for at in (starts, ends)), strict=True):
        text = held[a:b].decode("utf-8", "replace")
        out.append(" ".join((text if text.isascii() else _SINGLE.sub(r" \1 ", text)).split()))
    return out


def _fetch_lines(bits, min_words: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            for _, _, d, o in tv.blocks(data, off):
                starts, ends, _, n_words, keys, _ = line_table(d, o, with_sims=False)
                use = np.flatnonzero((n_words >= min_words))
                use = use[in_bloom(table, keys[use])]
                _, one = np.unique(keys[use], return_index=True)
                use = use[one]
                texts = normal_lines(d, starts[use], ends[use])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tv.signed(keys[use])), pa.array(texts, pa.string())], ["key", "line"]
                )

    return fetch


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences: equal ends are cut off, the rest is done bit-parallel (one row a big integer)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # longest common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = ph << 1 & full | 1, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return score


def within(x: list[str], y: list[str], edits: int) -> bool:
    """Whether two lines of words are at most so many edits apart."""
    if abs(len(x) - len(y)) > edits:
        return False
    # Upper bound: words changed in their places.  Lower bound: words that one line has more often.
    if len(x) == len(y) and sum(map(ne, x, y)) <= edits:
        return True
    x_more = Counter(x)
    x_more.subtract(y)
    more = [n for n in x_more.values() if n]
    gained = sum(n for n in more if n > 0)
    return gained <= edits and gained - sum(more) <= edits and edit_distance(x, y) <= edits


def _verify_lines(similarity: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True):
                x, y = x.split(" "), y.split(" ")
                keep.append(within(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)))
            names = [c for c in batch.schema.names if c not in ("la", "lb")]
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return check


def _whole_pairs(max_bits: int, similarity: float, loads: tuple[str, ...] = ()):
    """Task function over rows sorted by bucket: all pairs of lines of a bucket that may be similar, and how many bits of their words' parity differ."""
    names = ["bucket", "key", "sim", "size", *MASKS, *loads]

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        """Row i with row i + 1, i + 2, .. of its bucket."""
        bucket, key, sim, size = rows[:4]
        end = np.searchsorted(bucket, bucket, side="right")
        at, found, step = np.arange(len(key)), [], 1
        while len(at):
            at = at[at + step < end[at]]
            x, y = at, at + step
            near = np.bitwise_count((sim[y] ^ sim[x]).view(np.uint64)) <= max_bits
            x, y = x[near], y[near]
            edits = (1 - similarity) * np.maximum(size[y], size[x]) + 1e-9
            near = np.abs(size[y] - size[x]) <= edits
            x, y, edits = x[near], y[near], edits[near]
            turned = sum(np.bitwise_count((m[y] ^ m[x]).view(np.uint64)).astype(np.int64) for m in rows[4 : 4 + len(MASKS)])
            near = turned <= 2 * edits.astype(np.int64)
            if loads:
                of = np.flatnonzero(near)
                near[of] = fitting_loads([m[x[of]] for m in rows[-len(loads) :]], [m[y[of]] for m in rows[-len(loads) :]], edits[of])
            found.append((key[x[near]], key[y[near]], turned[near]))
            step += 1
        x, y, far = (np.concatenate([np.empty(0, np.int64), *z]) for z in zip(*found)) if found else [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far)], ["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((len(names), 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
            # The last bucket may go on.
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield pairs(rows[:, :cut])
            held = rows[:, cut:].copy()
        yield pairs(held)

    return run


def _close_pairs(
    max_bits: int, similarity: float, with_comps: bool, nearest: bool = False, masks: tuple[str, ...] = ("low", "high"), loads: tuple[str, ...] = ()
):
    """Task function over rows sorted by bucket (with components: by bucket, lo, hi): pairs within ``max_bits`` whose lengths allow the similarity.

    With components, only pairs of different components and, if ``lo`` and
    ``hi`` differ, of different blocks.  A group holds at most two blocks.
    With ``nearest`` too, each line only with the nearest (in the parity of
    the words) of those after it in its group: at most one pair a line.
    """
    names = ["bucket", "key", "sim", "size", *([*masks, *loads, "comp", "block", "lo", "hi"] if with_comps else [])]
    at_loads, at_comp = 4 + len(masks), 4 + len(masks) + len(loads)

    def fitting(rows, x, y):
        """Which pairs fit in length, in the parity of their words and in their loads, and how many bits of the parity differ."""
        edits = (1 - similarity) * np.maximum(rows[3][y], rows[3][x]) + 1e-9
        fits = np.flatnonzero(np.abs(rows[3][y] - rows[3][x]) <= edits)
        if not with_comps:
            return x[fits], y[fits], np.zeros(len(fits), np.int64)
        x, y, edits = x[fits], y[fits], edits[fits].astype(np.int64)
        turned = sum(np.bitwise_count((rows[c][y] ^ rows[c][x]).view(np.uint64)).astype(np.int64) for c in range(4, at_loads))
        fits = np.flatnonzero(turned <= 2 * edits)
        x, y, edits, turned = x[fits], y[fits], edits[fits], turned[fits]
        if loads:
            fits = fitting_loads([m[x] for m in rows[at_loads:at_comp]], [m[y] for m in rows[at_loads:at_comp]], edits)
            x, y, turned = x[fits], y[fits], turned[fits]
        return x, y, turned

    def named(rows, found):
        x, y, far = (np.concatenate([np.empty(0, np.int64), *z]) for z in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
        if nearest:
            by = np.lexsort((far, x))
            x, y = x[by], y[by]
            first = np.append(True, x[1:] != x[:-1])[: len(x)]
            x, y = x[first], y[first]
        key, ids = rows[1], rows[at_comp] if with_comps else rows[1]
        swap = key[x] > key[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return key[x], key[y], ids[x], ids[y]

    def pairs_of(rows):
        """The pairs of one group, some lines with all others at a time."""
        sim, found = rows[2].view(np.uint64), []
        left = np.arange(rows.shape[1])
        across = False
        if with_comps:
            comp, block, lo, hi = rows[at_comp:]
            left, across = np.flatnonzero(block == lo), lo[0] != hi[0]
        right = np.flatnonzero(block == hi) if across else left
        step = max(MATRIX // max(len(right), 1), 1)
        for at in range(0, len(left), step):
            x, y = left[at : at + step, None], right[None, :] if across else right[None, at:]
            near = np.bitwise_count(sim[x] ^ sim[y]) <= max_bits
            if with_comps:
                near &= comp[x] != comp[y]
            if not across:
                near &= y > x
            i, j = np.nonzero(near)
            found.append(fitting(rows, x[i, 0], y[0, j]))
        return named(rows, found)

    def small_pairs(rows, starts, ends):
        """The pairs of many small groups (of one block each) at once: row i with row i + 1, i + 2, .. of its group."""
        size = ends - starts
        at = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        end = np.repeat(ends, size)
        sim, found, step = rows[2].view(np.uint64), [], 1
        while len(at):
            inside = at + step < end
            at, end = at[inside], end[inside]
            y = at + step
            near = np.bitwise_count(sim[y] ^ sim[at]) <= max_bits
            if with_comps:
                near &= rows[at_comp][y] != rows[at_comp][at]
            found.append(fitting(rows, at[near], y[near]))
            step += 1
        return named(rows, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out: list = []
        count = 0

        def flush():
            columns = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "ca", "cb"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            rows = np.concatenate([*held, rows], axis=1)
            if not rows.shape[1]:
                continue
            group = rows[[0, -2, -1] if with_comps else [0]]
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            # The last group may go on.
            starts, ends = np.append(0, cuts)[:-1] if len(cuts) else cuts, cuts
            small = ends - starts <= SMALL_GROUP
            out.append(small_pairs(rows, starts[small], ends[small]))
            count += len(out[-1][0])
            for a, b in zip(starts[~small], ends[~small]):
                out.append(pairs_of(rows[:, a:b]))
                count += len(out[-1][0])
                if count > 100_000:
                    yield flush()
                    out, count = [], 0
            held = [rows[:, cuts[-1] if len(cuts) else 0 :].copy()]
        if held:
            out.append(pairs_of(held[0]))
        yield flush()

    return run


def duplicate_lines(
    docs: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    exact_words: int | None = None,
    max_bits: int = MAX_BITS,
    similarity: float = SIMILARITY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drops, lines, links): removed occurrences (doc_id, line_no), all lines that take part, verified links.

    Lines of at least ``exact_words`` words (default: ``min_words``) collapse
    with their equals; those of at least ``min_words`` with similar ones too.
    """
    exact_words = min_words if exact_words is None else exact_words
    if similarity < 0.5:
        raise ValueError("blocks of two words deal out lines of a similarity of at least 0.5")
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id is not null and text is not null")
    bits = ["sim", *MASKS, *LOADS, "size"]
    scanned = materialize_hashes(
        texts.mapInArrow(
            _scan_lines(min(exact_words, min_words), min_words, block_words(similarity)),
            "doc_id long, line_no int, key long, " + "".join(f"{m} long, " for m in bits[:-1]) + "size int, chunk int, counts binary",
        ),
        "lines",
        ["key", *bits[:-1]],
    )
    lines = scanned.where("chunk is null").select("doc_id", "line_no", "key")
    by_doc = lines.groupBy("key", "doc_id").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))
    distinct = by_doc.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("line_no", "doc_id").alias("line_no"), F.sum("n").alias("n"))
    distinct = distinct.select("key", F.struct("doc_id", "line_no").alias("first"), "n")

    shared = shared_blocks(texts.select("text"), min_words, similarity, scanned.where("chunk is not null").select("chunk", "counts"))
    met = shared.select(F.col("id").alias("key")).distinct()
    # Equal lines have equal bits.
    payload = scanned.where("chunk is null").groupBy("key").agg(*[F.first(c).alias(c) for c in bits])
    payload = payload.join(met.hint("shuffle_hash"), "key", "left_semi").withColumnRenamed("key", "id")
    payload = materialize_hashes(payload, "line-bits", ["id", *bits[:-1]])

    written = []
    parts = min(PARTS, 1 + shared.count() // PART_LINES)
    for part in range(parts):
        own = shared if parts == 1 else shared.where(F.pmod(F.xxhash64("bucket"), F.lit(parts)) == part)
        rows = own.where("not large").drop("large").join(payload, "id").withColumnRenamed("id", "key")
        close = rows.repartition("bucket").sortWithinPartitions("bucket")
        close = close.mapInArrow(_whole_pairs(max_bits, similarity, tuple(LOADS)), "a long, b long, far long")
        written.append(materialize(close.distinct(), "line-whole-part"))
    whole = materialize(reduce(DataFrame.unionByName, written).distinct(), "line-whole") if parts > 1 else written[0]

    large = shared.where("large").select("bucket", "id").distinct()
    sizes = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    members = materialize(large.join(centrality(large, sizes), "id").join(payload, "id"), "line-members")
    discard(shared, payload, *(written if parts > 1 else []))
    n_members, n_whole = members.count(), whole.count()
    turned = " + ".join(f"bit_count(a_{m} ^ b_{m})" for m in MASKS)
    close = F.expr(
        f"bit_count(a_sim ^ b_sim) <= {max_bits} and abs(a_size - b_size) <= {1 - similarity} * greatest(a_size, b_size) + 1e-9"
        f" and {turned} <= 2 * floor({1 - similarity} * greatest(a_size, b_size) + 1e-9)"
    )
    stars = star_pairs(members, None, ["sim", *MASKS, "size"], close)
    # Each line of the small blocks with its nearest one.
    ends = whole.select("a", F.struct("far", "a", "b").alias("p")).unionByName(whole.select(F.col("b").alias("a"), F.struct("far", "a", "b").alias("p")))
    nearest_of = ends.groupBy("a").agg(F.min("p").alias("p")).select("p.a", "p.b")
    pairs = materialize(stars.unionByName(nearest_of).distinct(), "line-pairs")

    # The normalised text of all lines that may still be paired, in one pass.
    ends = [whole.select(F.col("a").alias("key")), whole.select(F.col("b").alias("key")), members.select(F.col("id").alias("key"))]
    met = reduce(DataFrame.unionByName, ends).distinct()
    width = 1 << min(max((8 * (2 * n_whole + n_members)).bit_length(), 23), 26)
    sent = spark.sparkContext.broadcast(bloom(met, width))
    found = texts.select("text").mapInArrow(_fetch_lines(sent, min_words), "key long, line string")
    found = materialize(found.groupBy("key").agg(F.min("line").alias("line")).join(met, "key"), "line-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        la, lb = (found.select(F.col("key").alias(x), F.col("line").alias(f"l{x}")) for x in ("a", "b"))
        written = []
        parts = min(PAIR_PARTS, 1 + pairs.count() // PART_PAIRS)
        for part in range(parts):
            # The texts travel with the pairs, a part of them at a time.
            own = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
            full = own.join(la, "a").join(lb, "b").select("a", "b", "la", "lb")
            written.append(materialize(full.mapInArrow(_verify_lines(similarity), "a long, b long"), f"line-links-{name}"))
        return reduce(DataFrame.unionByName, written)

    links = pairs if pairs.isEmpty() else verified(pairs, "first")
    labels = components(links)
    lines_of = members.drop("score")
    parts = min(PARTS, 1 + max(n_members, n_whole) // PART_LINES)

    def part_of(table: DataFrame, part: int, *by: str) -> DataFrame:
        return table if parts == 1 else table.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == part)

    def left_of_whole(part: int) -> DataFrame:
        """The small blocks' pairs of lines of different components that are not in ``pairs``."""
        left = part_of(whole, part, "a", "b").select("a", "b").join(pairs, ["a", "b"], "left_anti")
        for line, comp in (("a", "ca"), ("b", "cb")):
            left = left.join(labels.select(F.col("node").alias(line), F.col("comp").alias(comp)), line, "left")
        return left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def candidates(nearest: bool, name: str) -> DataFrame:
        """(a, b): pairs of lines of different components in the open large blocks (and, at last, in the small ones) that are not in ``pairs``."""
        written = []
        for part in range(parts):
            found = [] if nearest else [left_of_whole(part)]
            if n_members:
                left = open_members(part_of(lines_of, part, "bucket"), labels)
                close = (
                    dealt(left, BLOCK_LINES).withColumnRenamed("id", "key")
                    .repartition("bucket", "lo", "hi")
                    .sortWithinPartitions("bucket", "lo", "hi")
                    .mapInArrow(_close_pairs(max_bits, similarity, True, nearest, tuple(MASKS), tuple(LOADS)), "a long, b long, ca long, cb long")
                    # Without the components: they follow from the lines, and are put back to the few pairs that are links.
                    .select("a", "b")
                    .distinct()
                )
                found.append(close.join(pairs, ["a", "b"], "left_anti"))
            written.append(materialize(reduce(DataFrame.unionByName, found), f"{name}-part"))
            if n_members:
                discard(left)
        out = materialize(reduce(DataFrame.unionByName, written).distinct(), name)
        discard(*written)
        return out

    for nearest, name in [(True, "nearest")] * bool(n_members) + [(False, "rest")]:
        close = candidates(nearest, f"line-{name}")
        if not close.isEmpty():
            more = verified(close, name)
            links = links.unionByName(more)
            for line, comp in (("a", "ca"), ("b", "cb")):
                own = labels.select(F.col("node").alias(line), F.col("comp").alias(comp))
                more = more.join(own, line, "left").withColumn(comp, F.coalesce(comp, line))
            labels = materialize(merged(labels, more), "line-labels")
        if nearest:
            discard(close)
    discard(members, whole, found)
    grouped = distinct.join(labels.select(F.col("node").alias("key"), "comp"), "key", "left")
    grouped = materialize(grouped.where("n > 1 or comp is not null"), "line-groups")
    first = grouped.where("comp is not null").groupBy("comp").agg(F.min("first").alias("kept"))
    keys = grouped.join(first, "comp", "left")
    keys = keys.select("key", F.coalesce("kept", "first").alias("kept"))
    drops = lines.join(keys, "key").where(
        (F.col("doc_id") != F.col("kept.doc_id")) | (F.col("line_no") != F.col("kept.line_no"))
    )
    return drops.select("doc_id", "line_no"), lines, links


def without_duplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with later occurrences of duplicate lines removed from ``text``.

    Adds ``n_lines_removed``; all other columns are kept as they are.
    """
    drops, _, _ = duplicate_lines(docs, **options)
    gone = drops.groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone.hint("shuffle_hash"), "doc_id", "left")  # else every text is sorted
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    return joined.withColumns(
        {
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
            "n_lines_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    ).drop("__gone")


def op6_simhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text without duplicate lines, n_lines_removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_duplicate_lines(docs, exact_words=EXACT_WORDS).select("doc_id", "text", "n_lines_removed")
