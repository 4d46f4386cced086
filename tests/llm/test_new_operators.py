"""SimHash components, phrase collocations and the Merkle manifest against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from simtrail import session
from simtrail.llm import manifest, phrases, simhash_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    body = " ".join(f"word{i % 37}, tail{i % 5}" for i in range(300))
    data = [
        (1, body, "en", "s", 7), (1, body, "en", "s", 7), (2, None, None, "s", None), (3, "", "en", None, 0),
        (None, body + " more", "en", "s", 9), (4, "!!! ... \t\x0b", "de", "s", 1), (5, "Été\n\nçà " + body, "fr", "s", 3),
        (6, "x" * 3_000_000, "en", "s", 3_000_000), (7, (body + " ") * 400, "en", "s", 5), (8, "a b", "und", "s", 3), (9, "a B", None, "s", 3),
        (None, body + " more", "en", "s", 9),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 as fp", "2 as pos", "'a' as tree", "3 as salt", "4 as n", "5 as id", "6 as part", "7 as block", "8 as word", "9 as c")


# --- operator 11 ---------------------------------------------------------------
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(fps, ids, max_bits=4):
    """Least id reachable from each row; None where nothing reachable has an id."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= max_bits):
            parent[root(i)] = root(int(j))
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)].append(d)
    return [min(least[root(i)], default=None) for i in range(len(fps))]


def _key(row):
    return tuple((v is None, v) for v in row)


def _components_match(spark, docs, **kw):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = [(d, f, c) for (d, _), f, c in zip(rows, fps, brute_components(fps, [d for d, _ in rows]))]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_near.with_components(docs, **kw).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_simhash_components_match_brute_force(spark, documents):
    _components_match(spark, documents)


def test_simhash_of_odd_rows(spark):
    _components_match(spark, odd(spark))
    assert simhash_near.with_components(odd(spark).limit(0)).count() == 0
    only_nulls = spark.createDataFrame([(None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash_near.with_components(only_nulls).collect()} == {None}


def _planted(n, seed):
    """Distinct fingerprints around few centres, so that cells are crowded and chains are long."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = set()
    while len(out) < n:
        f = int(centres[rng.integers(6)])
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            f ^= 1 << int(b)
        out.add(f)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("limit", [simhash_near.CELL, 8])
@pytest.mark.parametrize("max_bits", [2, 4, 6])
def test_links_connect_all_that_is_close(spark, max_bits, limit):
    """Also with cells split into blocks of four."""
    from simtrail.llm.linking import components

    fps = _planted(700, 3)
    groups = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, id long")
    edges = simhash_near.links(groups, max_bits, limit)
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    want = brute_components(fps.tolist(), list(range(len(fps))), max_bits)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_crowded_cell_gives_a_forest_not_all_pairs():
    fps = np.array(sorted({1 << i | 1 << j for i in range(20) for j in range(20)}), np.uint64)
    a, b = simhash_near.linked(np.zeros(1, np.int64), fps, 4)
    assert len(a) == len(fps) - 1


def test_distance_of_segment_counts_is_a_lower_bound():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    ca, cb = simhash_near.segment_counts(a), simhash_near.segment_counts(b)
    far = sum(np.abs(((ca >> np.uint64(2 * i)) & np.uint64(3)).astype(int) - ((cb >> np.uint64(2 * i)) & np.uint64(3)).astype(int)) for i in range(32))
    assert (far <= np.bitwise_count(a ^ b)).all()


# --- operator 12 ---------------------------------------------------------------
def brute_phrases(rows, max_words=3, min_count=10, cover=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i : i + k])
                if 100 * a >= cover * candidates[inner]:
                    covered.add(inner)
    by_lang = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("sf,kw", [(SF, {}), (SF, {"min_count": 3, "top": 50}), ("/root/testdata/sf0.01", {})])
def test_phrases_match_brute_force(spark, sf, kw):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, phrases.collocations(docs, **kw).collect())) == brute_phrases(rows, **kw)


@pytest.mark.parametrize("block_bytes", [phrases.BLOCK_BYTES, 1000])
@pytest.mark.parametrize("max_words", [2, 3, 5])
def test_phrases_of_odd_rows(spark, max_words, block_bytes, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block_bytes)
    docs = odd(spark)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    got = phrases.collocations(docs, max_words=max_words, min_count=2)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, max_words, 2)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_phrases_bound_their_batches(spark):
    before = spark.conf.get(session.BATCH_SETTING, None)
    rows = [("en", "one two three. " * 20), (None, "four five " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    try:
        spark.conf.unset(session.BATCH_SETTING)
        assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute_phrases(rows)
        assert spark.conf.get(session.BATCH_SETTING) == str(session.BATCH_BYTES)
    finally:
        spark.conf.unset(session.BATCH_SETTING) if before is None else spark.conf.set(session.BATCH_SETTING, before)


# --- operator 13 ---------------------------------------------------------------
def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, tampered=False):
    n = r["n_chars"] + 1 if tampered and r["n_chars"] is not None else r["n_chars"]
    values = (r["doc_id"], r["source"], r["lang"], n, r["text"])
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(nodes):
    """(root, for each node the siblings of its path with their side)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, united = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, members in enumerate(groups[i : i + 2]):
                for k in members:
                    paths[k].append((j, run[1 - j : 2 - j] if len(run) == 2 else []))
            above.append(_h(*run))
            united.append(sum(groups[i : i + 2], []))
        nodes, groups = above, united
    return nodes[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees.append((own, *brute_tree([_leaf(r) for r in own])))
    if not trees:
        return []
    root, upper = brute_tree([subroot for _, subroot, _ in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            path = path + above
            proof = _h("".join("".join(near) for _, near in path))
            now = _leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for side, near in path:
                now = _h(*near, now) if side else _h(now, *near)
            out.append((r["doc_id"], _leaf(r), subroot, root, proof, now, now == root))
    return out


def _manifest_match(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = manifest.op13_merkle_manifest(spark, str(tmp_path)).collect()
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(map(tuple, got), key=_key) == sorted(brute_manifest(rows), key=_key)


def test_manifest_matches_brute_force(spark, documents, tmp_path):
    _manifest_match(spark, documents, tmp_path)


def test_manifest_of_odd_rows(spark, tmp_path):
    _manifest_match(spark, odd(spark), tmp_path / "odd")
    _manifest_match(spark, odd(spark).limit(0), tmp_path / "empty")
    _manifest_match(spark, odd(spark).limit(1), tmp_path / "one")


@pytest.mark.parametrize("n", [2, 3, 5, 17, 33])
def test_manifest_across_small_subtrees(spark, tmp_path, monkeypatch, n):
    """Subtrees of four nodes, shared segments from two nodes on: several passes and copies."""
    monkeypatch.setattr(manifest, "CHUNK", 2)
    monkeypatch.setattr(manifest, "SHARE", 1)
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 11 != 3, "en").alias("lang"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("n_chars"), F.concat(F.lit("t"), F.col("id")).alias("text"),
    )
    _manifest_match(spark, docs, tmp_path)


def test_proof_of_another_leaf_fails(spark, documents):
    out = manifest.manifest(documents)
    moved = out.withColumn("near", F.lit("00" * 32))
    good = out.where(manifest.folded(F.col("leaf"), F.col("proof")) == F.lower(F.hex("root"))).count()
    bad = moved.where(manifest.folded(F.unhex("near"), F.col("proof")) == F.lower(F.hex("root"))).count()
    assert (good, bad) == (documents.count(), 0)
