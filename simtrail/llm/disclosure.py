"""Operator 8: personal data, by fixed patterns and information-theoretic sanitisation.

Protected entities are the base matches: emails, IP addresses, payment cards,
phone numbers.  How strongly another term reveals one of them is estimated
from co-occurrence over the corpus, the unit being the line:

    PMI(t; e) = ln(N * N_te / (N_t * N_e)),   IC(e) = -ln(N_e / N)

A term discloses e if ``PMI(t; e) >= SHARE * IC(e)`` (it gives away that share
of the entity's information) and the two meet in at least ``MIN_LINES``
different lines, so that chance neighbours of a rare entity do not count.
In documents that hold e, such terms are spans too: they are removed or
generalised with the entities.

1. Scan: N, and lines with an entity (entity, line hash, terms).
2. Entities on enough different lines, their terms, and the pairs' counts.
   The bound says N_t <= N_te * (N / N_e) ^ (1 - SHARE), and N_t is at least
   the number of entity lines with t: pairs beyond that are ruled out here, so
   common words do not reach the next scan.
3. Scan: N_t of the terms left (a Bloom filter of fixed size picks them, an
   exact join follows).
4. Scan: the base spans of every document and the places of terms that may
   disclose one of its entities (again a Bloom filter); an exact join decides.
   Texts are never shuffled.

Terms are words of letters, digits and non-ASCII characters that are not all
digits, ASCII lower-cased.

Keys, tokens and passwords are protected too, but no pattern lists them: such a
value is told by the information it carries.  The co-occurrence of neighbouring
bytes over the whole corpus gives every byte its surprisal after the one before
it, ``-log2 P(b | a)``.  A term of ``CODE_CHARS`` characters or more that mixes
letters and digits discloses itself if its bytes carry at least ``CODE_BITS`` bits
in all and their median is at least ``CODE_RATE`` times the corpus's mean: words,
however long or rare, are made of the pairs the corpus is made of, random codes
are not.

Defined results: null and empty texts have no spans; documents without a base
match get no span but for such codes; repeated rows are each returned; spans
never overlap (a term inside a base span is dropped).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.linking import bloom, chunk_rows, counter_table, in_bloom
from simtrail.llm.shared import share as share_value
from simtrail.llm.shared import shared
from simtrail.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SHARE = 0.9
MIN_LINES = 3
# Codes: characters, bits in all, and the median of a byte's bits as a multiple of the corpus's mean.
CODE_CHARS = 16
CODE_BITS = 64.0
CODE_RATE = 1.25
_U = np.uint64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A leftmost match of the IP pattern always begins where a run of digits begins.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9][\x20.-]?[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT_BYTES = tv.class_table(range(0x30, 0x3A))
_LONG_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]{%d,}" % CODE_CHARS)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in linear time: from each @ outwards."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in email_spans(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entity_key(kind: int, value: str) -> int:
    """64-bit key of a protected entity, whatever its spelling."""
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def term_spans(data: np.ndarray, off: np.ndarray):
    """(hash, start byte, end byte, offsets by row) of the terms of some rows."""
    low = tv.LOWER[data]
    starts, ends, _ = tv.word_spans(low, off)
    if len(starts):
        digits = np.concatenate([[0], np.cumsum(_DIGIT_BYTES[data], dtype=np.int64)])
        use = digits[ends] - digits[starts] < ends - starts
        starts, ends = starts[use], ends[use]
    return tv.span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, off)


def line_count(text: str | None) -> int:
    """Lines of a text; an ending newline starts no further line."""
    return text.count("\n") + (text[-1] != "\n") if text else 0


def _entity_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entity of a line (``first`` for one of them), and the number of all lines under a null entity."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        keys, lines, terms, first, n = [None], [None], [None], [False], [sum(map(line_count, texts))]
        for text in texts:
            spans = base_spans(text) if text else ()
            by_line: dict[int, list] = {}
            for kind, a, b in spans:
                by_line.setdefault(text.rfind("\n", 0, a) + 1, []).append((kind, a, b))
            for start, found in by_line.items():
                end = text.find("\n", max(b for _, _, b in found))
                line = text[start : end if end >= 0 else len(text)]
                raw = np.frombuffer(line.encode(), np.uint8)
                # A word that an entity touches is no term.
                byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
                taken = np.zeros(len(raw) + 1, np.int64)
                for _, a, b in found:
                    taken[byte_at[a - start] + 1 : byte_at[b - start - 1] + 2] = 1
                taken = np.cumsum(taken)
                hashes, starts, ends, _ = term_spans(raw, np.array([0, len(raw)]))
                own = np.unique(hashes[taken[ends] == taken[starts]])
                line_key = int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)
                for i, key in enumerate({entity_key(k, text[a:b]) for k, a, b in found}):
                    keys.append(key)
                    lines.append(line_key)
                    terms.append(tv.signed(own))
                    first.append(i == 0)
                    n.append(1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array(lines, pa.int64()),
                pa.array(terms, pa.list_(pa.int64())),
                pa.array(first),
                pa.array(n, pa.int64()),
            ],
            ["e", "line", "terms", "first", "n"],
        )


def _term_counts(bits):
    """Lines that hold each term of the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            data, off = tv.text_bytes(batch.column(0))
            for _, _, d, o in tv.blocks(data, off):
                breaks = np.concatenate([np.flatnonzero(d == 10), o[1:] - 1]) if len(d) else np.empty(0, np.int64)
                breaks = np.unique(breaks[breaks >= 0])
                hashes, starts, _, _ = term_spans(d, o)
                hit = in_bloom(table, hashes)
                line = np.searchsorted(breaks, starts[hit])
                pairs = np.unique(np.stack([line.astype(np.uint64), hashes[hit]]), axis=1) if hit.any() else np.empty((2, 0), np.uint64)
                terms, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tv.signed(np.ascontiguousarray(terms))), pa.array(n.astype(np.int64))], ["t", "n"]
                )

    return count


def pair_key(t: np.ndarray, e: int) -> np.ndarray:
    return tv.mix64(t ^ tv.mix64(np.array([e], np.int64).view(np.uint64)))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.column("t").to_numpy().view(np.uint64)
        e = batch.column("e").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(tv.signed(tv.mix64(t ^ tv.mix64(e))))], ["h"])


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring bytes within rows, as chunks of a table of 65,536 counters."""
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data, off = tv.text_bytes(batch.column(0))
        for _, _, d, o in tv.blocks(data, off):
            pairs = d[:-1].astype(np.int64) * 256 + d[1:]
            inner = o[1:-1]
            inner = inner[(inner > 0) & (inner < len(d))] - 1  # pairs across rows
            counts += np.bincount(pairs, minlength=1 << 16) - np.bincount(pairs[np.unique(inner)], minlength=1 << 16)
    yield chunk_rows(counts)


class Surprisal:
    """Bits of each byte after the one before it, and their mean over the corpus; 65,536 numbers, whatever the data."""

    def __init__(self, counts: np.ndarray):
        pairs = counts.reshape(256, 256).astype(np.float64)
        self.bits = (np.log2(pairs.sum(axis=1, keepdims=True) + 256.0) - np.log2(pairs + 1.0)).astype(np.float32)
        self.mean = float((pairs * self.bits).sum() / max(pairs.sum(), 1.0))

    @classmethod
    def of(cls, texts: DataFrame) -> Surprisal:
        """From all texts of a one-column table."""
        return cls(counter_table(texts.mapInArrow(_byte_pairs, "chunk int, counts binary"), 1 << 16))

    def code_spans(self, text: str) -> list[tuple[int, int]]:
        """Terms that disclose themselves, in code points."""
        out = []
        for m in _LONG_TERM.finditer(text):
            if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
                raw = np.frombuffer(m[0].encode(), np.uint8)
                bits = self.bits[raw[:-1], raw[1:]]
                if bits.sum() >= CODE_BITS and np.median(bits) >= CODE_RATE * self.mean:
                    out.append((m.start(), m.end()))
        return out


_SPAN = "array<struct<kind: int, start: long, end: long>>"
_PLACES = "array<struct<start: long, end: long>>"
_MAYBE = "array<struct<e: long, t: long, start: long, end: long>>"


def _document_spans(entities, pairs, surprisal):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity_bits, pair_bits, known = entities.value, pairs.value, shared(surprisal)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            spans, maybe, rows, codes = [], [], [], []
            for text in batch.column("__text").to_pylist():
                found = base_spans(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                own_codes = known.code_spans(text) if text else []
                codes.append([{"start": a, "end": b} for a, b in own_codes if not any(x < b and a < y for _, x, y in found)])
                own = sorted({entity_key(k, text[a:b]) for k, a, b in found})
                if own:
                    own = np.array(own, np.int64)
                    own = own[in_bloom(entity_bits, own.view(np.uint64))]
                places = []
                if len(own):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    hashes, starts, ends, _ = term_spans(raw, np.array([0, len(raw)]))
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
                    for e in own.tolist():
                        for i in np.flatnonzero(in_bloom(pair_bits, pair_key(hashes, e))).tolist():
                            a, b = int(chars[starts[i]]), int(chars[ends[i]])
                            if not any(x < b and a < y for _, x, y in found):
                                places.append({"e": e, "t": int(hashes[i : i + 1].view(np.int64)[0]), "start": a, "end": b})
                maybe.append(places)
                rows.append(row)
                row += 1
            names = [c for c in batch.schema.names if c != "__text"]
            span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            maybe_type = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
            code_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            added = [pa.array(rows, pa.int64()), pa.array(spans, span_type), pa.array(maybe, maybe_type), pa.array(codes, code_type)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *added], [*names, "__row", "__base", "__maybe", "__codes"]
            )

    return scan


def disclosing_terms(docs: DataFrame, *, share: float = SHARE, min_lines: int = MIN_LINES) -> DataFrame:
    """(e, t, pmi, ic): terms that disclose an entity, from the co-occurrence counts of ``docs`` (text)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    schema = "e long, line long, terms array<long>, first boolean, n long"
    scanned = materialize(texts.mapInArrow(_entity_lines, schema), "entity-lines")
    total = scanned.where("e is null").agg(F.sum("n")).scalar()
    lines = scanned.where("e is not null")
    # A line that is copied is one line here, however often it occurs.
    by_line = lines.groupBy("e", "line").agg(F.count(F.lit(1)).alias("n"))
    often = by_line.groupBy("e").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n_e")).where(F.col("lines") >= min_lines)
    often = materialize(often.select("e", "n_e"), "entities")
    by_term = (
        lines.join(often, "e").select("e", "line", F.explode("terms").alias("t"))
        .groupBy("e", "t", "line").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = by_term.groupBy("e", "t").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n_te")).where(F.col("lines") >= min_lines)
    # Entity lines with t: no more than N_t, so pairs beyond the bound cannot disclose (the margin is for rounding).
    least = lines.where("first").select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_least"))
    most = F.col("n_te") * F.pow(F.col("n") / F.col("n_e"), F.lit(1.0 - share)) * (1 + 1e-9)
    pairs = (
        pairs.join(often, "e").join(least, "t").withColumn("n", total)
        .where(F.col("n_least") <= most)
        .select("e", "t", "n_te", "n_e", "n")
    )
    pairs = materialize(pairs, "entity-terms")
    bits = spark.sparkContext.broadcast(bloom(pairs.select("t")))
    counts = materialize(
        texts.mapInArrow(_term_counts(bits), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t")), "term-counts"
    )
    known = pairs.join(counts, "t")
    scored = known.select(
        "e",
        "t",
        F.log(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))).alias("pmi"),
        (-F.log(F.col("n_e") / F.col("n"))).alias("ic"),
    )
    return materialize(scored.where((F.col("ic") > 0) & (F.col("pmi") >= share * F.col("ic"))), "disclosing-terms")


def with_spans(docs: DataFrame, *, text: str = "text", share: float = SHARE, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` without its text, with ``base_spans`` and ``term_spans`` (arrays of kind, start, end)."""
    spark: SparkSession = docs.sparkSession
    terms = disclosing_terms(docs.select(F.col(text).alias("text")), share=share, min_lines=min_lines)
    entities = spark.sparkContext.broadcast(bloom(terms.select("e")))
    pairs = spark.sparkContext.broadcast(bloom(terms.mapInArrow(_pair_keys, "h long")))
    surprisal = share_value(spark, Surprisal.of(docs.select(F.col(text).cast("string"))))
    rest = docs.drop("base_spans", "term_spans", "__row", "__base", "__maybe", "__codes", "__text")
    kept = [c for c in rest.columns if c != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields if f.name != text)
    scanned = materialize(
        rest.select(*[F.col(c) for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(
            _document_spans(entities, pairs, surprisal), f"{schema}__row long, __base {_SPAN}, __maybe {_MAYBE}, __codes {_PLACES}"
        ),
        "document-spans",
    )
    sure = (
        scanned.where(F.size("__maybe") > 0)
        .select("__row", F.explode("__maybe").alias("m"))
        .select("__row", "m.*")
        .join(terms.select("e", "t"), ["e", "t"])
        .groupBy("__row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("places"))
    )
    out = scanned.join(sure, "__row", "left")
    # A term may be a code as well: each place once, in order.
    places = F.transform(
        F.array_sort(F.array_union(F.coalesce("places", F.array().cast(_PLACES)), "__codes")),
        lambda p: F.struct(F.lit(len(KINDS)).alias("kind"), p["start"].alias("start"), p["end"].alias("end")),
    )
    return out.select(*kept, F.col("__base").alias("base_spans"), places.alias("term_spans"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [f"<{k.upper()}>" for k in KINDS]
    for batch in batches:
        texts, all_spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        out = []
        for text, spans in zip(texts, all_spans, strict=True):
            if text is None or not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] < at:  # base kinds may overlap each other
                    at = max(at, s["end"])
                    continue
                word = text[s["start"] : s["end"]]
                # Names are generalised, other terms removed.
                mark = marks[s["kind"]] if s["kind"] < len(KINDS) else "<NAME>" if word[:1].isupper() else ""
                parts += [text[at : s["start"]], mark]
                at = s["end"]
            out.append("".join(parts) + text[at:])
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "text"])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (unique doc_id, text): doc_id and the text with its spans replaced."""
    found = with_spans(docs.select("doc_id", "text"), **options)
    spans = found.select("doc_id", F.concat("base_spans", "term_spans").alias("spans"))
    return docs.select("doc_id", "text").join(spans, "doc_id").mapInArrow(_replace, "doc_id long, text string")


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs)
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])

    def written(spans):
        one = F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.concat_ws(",", one)

    def number(kind):
        # One parameter only: a second one would be the place in the array.
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.concat("base_spans", "term_spans")).alias("spans"),
        F.size("term_spans").cast("long").alias("n_term"),
    )
