"""Operator 13: a Merkle manifest of a data set, with a proof for every row.

A row's leaf is the SHA-256 of its fields.  The leaves of one language form a
binary tree in doc_id order, the roots of the languages (null first, then by
bytes) one more tree; its root names the whole data set.  A proof is the list
of siblings from a leaf up to the root.

* Positions: rows are range partitioned on (lang, doc_id, leaf) and written;
  a row's position is its place in its range plus the rows of its language in
  earlier ranges (one row a range and language).
* Levels: ``2**CHUNK`` consecutive nodes of a tree make one aligned subtree,
  whose inner levels are computed in one expression; subtrees' tops are the
  nodes of the next pass.  No group is larger than a subtree.
* Proofs by pointer jumping: at first every node holds the segment of one
  sibling, to its parent.  A self-join then lengthens the segment of every
  node by that of the ancestor it reaches, which doubles the distance, until
  every leaf reaches its root.  After a round only levels that are multiples
  of the new distance are jumped from again.
* Near the root many leaves share an ancestor: its segment is joined in
  copies, one for every ``2**SHARE`` neighbouring nodes, so a join key has no
  more than that many rows on either side.

A segment is binary: 33 bytes a level, the side of the sibling (``L``, ``R``,
or zero for a node that is alone) and its digest.

Defined results: null fields are ``-``; null doc_ids come first in their
language; rows that repeat a doc_id are ordered by their leaf, and rows equal
in everything are one leaf each; a language of one row has its leaf as its
root; an empty table has no rows and no root.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simtrail.session import discard, materialize

CHUNK = 8
SHARE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
_ENTRY = 33


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(*hexes: Column) -> Column:
    """Digest of digests, as bytes; they are hashed as hex text, and a missing one is empty."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(h, F.lit("")) for h in hexes]), 256))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of one row: every field as byte count, colon, value, or ``-`` for a null."""
    texts = [c.cast("string") for c in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _parents(nodes: Column) -> Column:
    """Digests of every two consecutive nodes (the last one may be alone)."""

    def parent(i: Column) -> Column:
        return _digest(_hex(F.get(nodes, i * 2)), _hex(F.get(nodes, i * 2 + 1)))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, the table it reads): ``rows`` (lang, doc_id, leaf, other) with ``tree`` (ascends with lang), ``pos`` in it, and ``n``, its leaves."""
    ranged = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("lang", "doc_id", "leaf", "row")
        .sortWithinPartitions("lang", "doc_id", "leaf", "row")
        .drop("row")
        .withColumn("at", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged.withColumn("part", F.shiftright("at", 33)), "merkle-order")
    runs = ranged.groupBy("part", "lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    # One row a range and language reaches these windows.
    of_lang = Window.partitionBy("lang")
    earlier = of_lang.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part",
        F.col("lang").alias("__lang"),
        (F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.min("first").over(of_lang).alias("tree"),
        F.sum("here").over(of_lang).alias("n"),
    )
    placed = ranged.join(runs, (ranged["part"] == runs["part"]) & ranged["lang"].eqNullSafe(runs["__lang"]))
    placed = placed.select("tree", (F.col("at") + F.col("shift")).alias("pos"), "n", "doc_id", F.col("leaf").alias("digest"), "other")
    return placed, ranged


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """One row a subtree of ``2**CHUNK`` nodes of ``level``: its levels as arrays ``l0`` .. ``l<CHUNK>``."""
    extra = [c for c in nodes.columns if c not in ("tree", "n", "pos", "digest")]
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", *extra)))
    out = (
        nodes.groupBy("tree", "n", F.shiftright("pos", CHUNK).alias("chunk"))
        .agg(held.alias("held"))
        .select("tree", "n", "chunk", F.col("held.digest").alias("l0"), *[F.col(f"held.{c}").alias(c) for c in extra])
    )
    for j in range(CHUNK):
        out = out.withColumn(f"l{j + 1}", _parents(F.col(f"l{j}")))
    return out.withColumn("level", F.lit(level))


def _links(subtrees: DataFrame) -> DataFrame:
    """Every node below the root with the segment to its parent; leaves also carry their row (and are kept if alone)."""
    rows = [c for c in ("doc_id", "other") if c in subtrees.columns]
    levels = subtrees.select(
        "tree", "n", "chunk", "level", *rows, F.posexplode(F.array(*[f"l{j}" for j in range(CHUNK)])).alias("j", "nodes")
    ).select(
        "tree",
        "n",
        (F.col("level") + F.col("j")).alias("level"),
        F.expr(f"shiftleft(chunk, {CHUNK} - j)").alias("first"),
        "nodes",
        *[F.when(F.col("level") + F.col("j") == 0, F.col(c)).alias(c) for c in rows],
    )
    below = F.col("level") < _depth(F.col("n"))

    def node(digest: Column, i: Column) -> Column:
        near = F.get("nodes", i.bitwiseXOR(F.lit(1)))
        side = F.when(i % 2 == 1, F.lit(bytearray(b"L"))).otherwise(F.lit(bytearray(b"R")))
        entry = F.coalesce(F.concat(side, near), F.lit(bytearray(_ENTRY)))
        return F.struct(
            (F.col("first") + i).alias("pos"),
            F.when(F.col("level") == 0, digest).alias("digest"),
            F.when(below, entry).otherwise(F.lit(bytearray())).alias("seg"),
            *[F.get(c, i).alias(c) for c in rows],
        )

    kept = levels.where((F.col("level") == 0) | below)
    return kept.select("tree", "n", "level", F.inline(F.transform("nodes", node)))


def _forest(leaves: DataFrame, *read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with their segments to the root of their tree, roots (tree, n, root)).

    ``leaves``: (tree, pos, n, digest, doc_id, other); the tables ``read`` end
    when the first levels are written.
    """
    nodes, level, passes = leaves, 0, []
    while True:
        done = materialize(_subtrees(nodes, level), "merkle-levels")
        passes.append(done)
        if level == 0:
            discard(*read)
            depth = max((done.agg(F.max("n")).first()[0] or 0) - 1, 0).bit_length()
        if level + CHUNK >= depth:
            break
        level += CHUNK
        nodes = done.where(_depth(F.col("n")) > level).select(
            "tree", "n", F.col("chunk").alias("pos"), F.get(f"l{CHUNK}", F.lit(0)).alias("digest")
        )
    tops, links = None, None
    for i, done in enumerate(passes):
        up = _depth(F.col("n")) - i * CHUNK  # levels from here to the root
        inside = done.where((up <= CHUNK) & ((up > 0) | (F.lit(i) == 0)))
        levels = F.array(*[f"l{j}" for j in range(CHUNK + 1)])
        top = inside.select("tree", "n", F.get(F.get(levels, up), F.lit(0)).alias("root"))
        link = _links(done)
        tops = top if tops is None else tops.unionByName(top)
        links = link if links is None else links.unionByName(link, allowMissingColumns=True)
    roots = materialize(tops, "merkle-roots")
    return _jumped(links, depth, passes), roots


def _jumped(links: DataFrame, depth: int, read: list[DataFrame]) -> DataFrame:
    """Leaves with segments up to their root: the distance doubles in every round."""
    now, step = links, 1
    while step < depth:
        left = now.where(F.col("level") % (2 * step) == 0)
        share = min(step, SHARE)
        left = left.withColumns({"to": F.col("level") + step, "key": F.shiftright("pos", share)})
        right = now.where(F.col("level") % (2 * step) == step)
        key = F.col("pos")
        if step > share:  # one copy for every 2**share of the nodes that jump
            jumping = F.expr(f"shiftright(n + shiftleft(1L, level - {step}) - 1, level - {step})")
            first = F.shiftleft("pos", step - share)
            end = F.least(first + ((1 << (step - share)) - 1), F.shiftright(jumping - 1, share))
            key = F.explode(F.sequence(first, end))
        right = right.select("tree", F.col("level").alias("to"), key.alias("key"), F.col("seg").alias("more"))
        seg = F.concat("seg", F.coalesce("more", F.lit(bytearray())))
        joined = left.join(right, ["tree", "to", "key"], "left").withColumn("seg", seg).select(*now.columns)
        now = materialize(joined, "merkle-segments")
        discard(*read)
        read, step = [now], step * 2
    return now.where("level = 0")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, leaf, other, subroot, root and proof (bytes; see the module).

    ``tampered`` is a condition on ``docs``; where it holds, ``other`` is the
    leaf of the row with ``n_chars`` one higher, else it is null.
    """
    key = {c: F.col(c) for c in FIELDS}
    changed = key | {"n_chars": key["n_chars"].cast("decimal(20,0)") + 1}
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(list(changed.values()))) if tampered is not None else F.lit(None).cast("binary")
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of(list(key.values())).alias("leaf"), other.alias("other")),
        "merkle-leaves",
    )
    placed, ranged = _placed(rows)
    proofs, roots = _forest(placed, rows, ranged)
    # Languages: one row each, in their order.
    subroots = roots.select(
        F.lit(0).cast("long").alias("tree"),
        (F.row_number().over(Window.orderBy("tree")) - 1).cast("long").alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
        F.col("tree").alias("doc_id"),
        F.col("root").alias("digest"),
        F.lit(None).cast("binary").alias("other"),
    )
    upper, whole = _forest(subroots)
    upper = upper.select(F.col("doc_id").alias("tree"), F.col("seg").alias("more"))
    # The path of a language goes to all its rows: one copy for 2**SHARE of them.
    shared = (
        roots.join(upper, "tree")
        .withColumn("whole", whole.select("root").scalar())
        .select("tree", "more", "root", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, SHARE))).alias("key"))
    )
    out = proofs.withColumn("key", F.shiftright("pos", SHARE)).join(shared, ["tree", "key"])
    return out.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "other",
        F.col("root").alias("subroot"),
        F.col("whole").alias("root"),
        F.concat("seg", "more").alias("proof"),
    )


def _entries(proof: Column) -> Column:
    return F.sequence(F.lit(0), (F.length(proof) / _ENTRY - 1).cast("int"))


def _entry(proof: Column, i: Column) -> tuple[Column, Column]:
    """(side, sibling's digest as hex) of one level."""
    return F.substring(proof, i * _ENTRY + 1, F.lit(1)), _hex(F.substring(proof, i * _ENTRY + 2, F.lit(_ENTRY - 1)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that ``leaf`` (bytes) gives with the siblings of ``proof``."""

    def up(low: Column, i: Column) -> Column:
        side, near = _entry(proof, i)
        return F.when(side == F.lit(bytearray(b"L")), F.sha2(F.concat(near, low), 256)).when(
            side == F.lit(bytearray(b"R")), F.sha2(F.concat(low, near), 256)
        ).otherwise(F.sha2(low, 256))

    return F.when(F.length(proof) == 0, _hex(leaf)).otherwise(F.aggregate(_entries(proof), _hex(leaf), up))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of the siblings of a proof, as hex text from the leaf up."""

    def text(i: Column) -> Column:
        side, near = _entry(proof, i)
        return F.when(side == F.lit(bytearray(1)), "").otherwise(near)

    return F.sha2(F.when(F.length(proof) == 0, "").otherwise(F.concat_ws("", F.transform(_entries(proof), text))), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every seventh crc32 of a doc_id is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(docs, F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0)
    fold = folded(F.coalesce("other", "leaf"), F.col("proof"))
    out = out.withColumn("folded_root", fold).withColumn("root", _hex(F.col("root")))
    return out.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
