"""Operator 6 at size: the blocks by which lines meet, their sets, and candidates that the bits of the words do not tell apart."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from simtrail.llm import line_dedup, linking

DOCS = "doc_id long, text string"
_U = np.uint64


@pytest.mark.parametrize("common", [False, True])
def test_similar_lines_share_a_block(common):
    """Lines of 4 to 40 words and copies down to similarity 0.8, in any order of the blocks; short lines by single words left out."""
    rng = np.random.default_rng(21)
    order = (rng.integers(0, 300, line_dedup.WORD_COUNTERS).astype(np.uint16), rng.integers(0, 99 if common else 1, line_dedup.BLOCK_COUNTERS).astype(np.uint8))
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)]

    def blocks_of(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return set(line_dedup.rare_blocks(data, np.array([0, len(data)]), 4, 0.8, order)[0].tolist())

    met = n = 0
    for size in range(5, 41):
        for _ in range(40):
            line = list(rng.choice(vocabulary, size))
            copy = list(line)
            for _ in range(int(0.2 * size + 1e-9)):
                kind, at = int(rng.integers(3)), int(rng.integers(len(copy)))
                if kind == 0:
                    copy[at] = str(rng.choice(vocabulary))
                elif kind == 1 and len(copy) < size:
                    copy.insert(at, str(rng.choice(vocabulary)))
                elif len(copy) > 4:
                    del copy[at]
            if copy != line and line_dedup.edit_distance(line, copy) <= int(0.2 * max(len(line), len(copy)) + 1e-9):
                n += 1
                met += bool(blocks_of(line) & blocks_of(copy))
    assert n > 1000 and met == n


def test_blocks_of_the_same_lines_are_one_set(monkeypatch):
    """However the rows come, and whether the rows of large blocks go on at once or at the end."""
    rng = np.random.default_rng(22)
    rows = [(b, k) for b in range(30) for k in range(b % 5, b % 5 + 3)] + [(50, int(k)) for k in range(40)] + [(51, 7), (51, 9)]
    want = {frozenset(k for x, k in rows if x == b) for b, _ in rows if b < 50} | {frozenset([7, 9])}
    for held in (10, 1 << 21):
        monkeypatch.setattr(line_dedup, "HELD_ROWS", held)
        sets, large = line_dedup.SharedSets(), set()
        for part in np.array_split(rng.permutation(rows + rows), 7):
            if sets.add(part[:, 0].astype(np.uint64), part[:, 1].astype(np.uint64)):
                (b, k), (names, _, _) = sets.settle(False)
                large |= set(zip(b.tolist(), k.tolist()))
                assert not len(names)
        (b, k), (names, sizes, keys) = sets.settle(True)
        large |= set(zip(b.tolist(), k.tolist()))
        ends = np.append(0, np.cumsum(sizes))
        got = [frozenset(keys[x:y].tolist()) for x, y in itertools.pairwise(ends)]
        assert set(got) == want and len(got) == len(want) == len(set(names.tolist()))
        assert large == {(50, k) for k in range(40)}


def test_repeated_words_are_told_apart_before_their_texts(spark, monkeypatch):
    """Words that come 14 times leave no parity: their numbers tell such lines apart, in small and large blocks."""
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(20)]
    picks: list[set] = []
    while len(picks) < 70:  # two words or more apart: 28 edits of 22
        pick = set(rng.choice(20, 8, replace=False).tolist())
        picks += [pick] * all(len(pick & p) <= 6 for p in picks)
    lines = [" ".join(w for i in sorted(p) for w in [words[i]] * 14) for p in picks]
    docs = list(enumerate([*lines, lines[5].replace(words[min(picks[5])], "other", 3)]))
    met = []
    plain = line_dedup.materialize

    def recorded(df, name="table"):
        out = plain(df, name)
        if name in ("line-whole", "line-whole-part", "line-pairs", "line-nearest", "line-rest"):
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", recorded)
    out = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert {k for k, n in out.items() if n} == {len(lines)}
    assert sum(met) <= 2 * len(lines)  # before: most of the pairs of a block


def test_pairs_of_a_large_group_are_those_of_brute_force(monkeypatch):
    rng = np.random.default_rng(24)
    n = 150
    rows = {"bucket": np.zeros(n, int), "key": rng.permutation(n), "sim": rng.integers(0, 1 << 40, n), "size": rng.integers(20, 30, n)}
    rows |= {m: np.where(rng.random(n) < 0.5, 0, rng.integers(0, 1 << 9, n)) for m in line_dedup.MASKS}
    rows |= {m: rng.integers(0, 4, (n, 8)).astype(np.uint8).view(np.int64).ravel() for m in line_dedup.LOADS}
    rows |= {"comp": rng.integers(0, 9, n), "block": rng.integers(0, 2, n)}
    loads = np.stack([rows[m] for m in line_dedup.LOADS], axis=1).view(np.uint8).astype(int)
    for lo, hi in ((0, 0), (0, 1)):
        own = rows["block"] == 0 if lo == hi else np.ones(n, bool)
        columns = {c: v[own] for c, v in (rows | {"lo": np.full(n, lo), "hi": np.full(n, hi)}).items()}
        want = set()
        for i, j in itertools.combinations(np.flatnonzero(own).tolist(), 2):
            edits = 0.2 * max(rows["size"][i], rows["size"][j]) + 1e-9
            more = loads[i] - loads[j]
            fits = abs(rows["size"][i] - rows["size"][j]) <= edits and int(rows["sim"][i] ^ rows["sim"][j]).bit_count() <= 18
            fits = fits and sum(int(rows[m][i] ^ rows[m][j]).bit_count() for m in line_dedup.MASKS) <= 2 * int(edits)
            fits = fits and max(more[more > 0].sum(), -more[more < 0].sum()) <= int(edits)
            if fits and rows["comp"][i] != rows["comp"][j] and (lo == hi or rows["block"][i] != rows["block"][j]):
                want.add(tuple(sorted((int(rows["key"][i]), int(rows["key"][j])))))
        batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))
        for step in (1, 1 << 20):
            monkeypatch.setattr(line_dedup, "MATRIX", step)
            run = line_dedup._close_pairs(18, 0.8, True, False, tuple(line_dedup.MASKS), tuple(line_dedup.LOADS))
            got = pa.Table.from_batches(run(iter([batch]))).to_pydict()
            assert set(zip(got["a"], got["b"])) == want and len(got["a"]) == len(want)


@pytest.mark.parametrize("limit", [3, 1 << 20])
def test_edges_of_a_task_become_stars(limit, monkeypatch):
    monkeypatch.setattr(linking, "STARRED_EDGES", limit)
    rng = np.random.default_rng(25)
    u, v = rng.integers(0, 80, (2, 60))
    edges = [(int(max(x)), int(min(x))) for x in zip(u, v) if x[0] != x[1]] + [(i + 1, i) for i in range(100, 140)]

    def least(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in list(root)}

    batches = [pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in e], ["u", "v"]) for e in edges]
    out = [t for b in linking._starred(iter(batches)) for t in zip(*b.to_pydict().values())]
    assert least(out) == least(edges) and (limit == 3 or all(least(edges)[a] == b for a, b in out))


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_components_of_a_chain_take_few_rounds(spark, monkeypatch, limit):
    """In one task, or in rounds over what the tasks have joined."""
    monkeypatch.setattr(linking, "STARRED_EDGES", limit)
    written = []
    plain = linking.materialize

    def recorded(df, name="table"):
        written.append(name)
        return plain(df, name)

    monkeypatch.setattr(linking, "materialize", recorded)
    chain = spark.range(1, 200, 1, 1).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in linking.components(chain).collect()} == {(i, 1) for i in range(1, 201)}
    assert written.count("edges") <= (2 if limit > 200 else 9)
