"""Dealing of lines, repeated strings and token files: scripts without spaces, collisions, folds, nulls and pruning."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simtrail import session
from simtrail.llm import disclosure, line_dedup, linking, pieces, quality_model, quality_rules, repeats, token_files
from simtrail.llm import textvec as tv

DOCS = "doc_id long, text string"


# --- operator 6 ----------------------------------------------------------------
def test_characters_of_scripts_without_spaces_are_words():
    text = "東京 abc日本x ไทย é한국 𠀀a ကခ"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = line_dedup.word_spans(data, np.array([0, len(data)]))
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == ["東", "京", "abc", "日", "本", "x", "ไ", "ท", "ย", "é한국", "𠀀", "a", "က", "ခ"]
    assert line_dedup.normal_lines(data, np.array([0]), np.array([len(data)])) == [" ".join(words)]


def test_similar_lines_without_spaces_are_found(spark):
    """One character of 38 changed, put in or left out; another line of the same length stays."""
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    docs = []
    for kind in range(30):
        base = list(rng.choice(letters, 38))
        copy, at = list(base), int(rng.integers(1, 37))
        if kind % 3 == 0:
            copy[at] = "龍"
        elif kind % 3 == 1:
            copy.insert(at, "龍")
        else:
            del copy[at]
        docs += [(2 * kind, "".join(base)), (2 * kind + 1, "".join(copy))]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert [i for i in sorted(out) if out[i]] == list(range(0, 60, 2))


@pytest.mark.parametrize("kind", ["insert", "delete"])
def test_lines_with_words_put_in_or_left_out(spark, kind):
    """Recall of planted edits down to similarity 0.8 is at least 0.99."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "the of re con lyn ara mi to est".split() for b in "a on ing er ti sh ble ou".split()]
    docs = []
    for size in range(5, 61):
        for n in range(4):
            base = [f"u{len(docs)}v" if rng.random() < 0.2 else w for w in rng.choice(vocabulary, size)]
            copy = list(base)
            for _ in range(size // 5 if kind == "delete" else int(size / 4)):
                at = int(rng.integers(len(copy)))
                if kind == "delete":
                    del copy[at]
                else:
                    copy.insert(at, str(rng.choice(vocabulary)))
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
    options = {"min_words": 4} if kind == "delete" else {}
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, DOCS), **options).collect()}
    assert all(out[i] for i in range(0, len(docs), 2))
    assert np.mean([out[i] == "" for i in range(1, len(docs), 2)]) >= 0.99


def test_shared_blocks_in_any_number_of_folds():
    rng = np.random.default_rng(6)
    rows = [(int(b), int(k)) for b, k in zip(rng.integers(0, 60, 400), rng.integers(0, 40, 400))] + [(99, 7)] * 5 + [(1000 + i, 1) for i in range(50)]
    keys: dict = {}
    for b, k in rows:
        keys.setdefault(b, set()).add(k)
    want = {(b, k) for b, ks in keys.items() if len(ks) > 1 for k in ks}
    for fold in (1, 3, 50, 10_000):
        state, got = line_dedup.SharedBlocks(), set()
        for lo in range(0, len(rows), fold):
            b, k = (np.array(v, np.uint64) for v in zip(*rows[lo : lo + fold]))
            got |= set(zip(*(v.tolist() for v in state.add(b, k))))
        assert got == want, fold


@pytest.mark.parametrize("ranges", [1, 64])
def test_packed_blocks_are_those_that_lines_share(spark, ranges, monkeypatch):
    monkeypatch.setattr(line_dedup, "RANGE_BLOCKS", 1 << 30 if ranges == 1 else 1)
    lines = ["alpha beta gamma delta eps zeta", "alpha beta other words stand here", "nothing of that is in this one", "alpha beta gamma delta eps zeta"]
    texts = spark.createDataFrame([("\n".join(lines[:2]),), ("\n".join(lines[2:]),)], "text string")
    got = line_dedup.shared_blocks(texts, 5, 0.8).groupBy("bucket").agg(F.countDistinct("id").alias("n")).collect()
    assert len(got) <= 1 and all(r["n"] == 2 for r in got)


def test_members_of_other_components_meet_all(spark):
    """Dealt groups: every pair of different components meets, pairs of the main component do not."""
    rows = [(1, i, 0 if i < 50 else i, 0, 57) for i in range(57)] + [(2, i, i % 3, 0, 9) for i in range(9)]
    left = spark.createDataFrame(rows, "bucket long, id long, comp long, main long, n long")
    groups: dict = {}
    for r in linking.dealt(left, 8).collect():
        groups.setdefault((r["bucket"], r["lo"], r["hi"]), []).append((r["id"], r["comp"], r["block"]))
    met, copies = set(), 0
    for (bucket, lo, hi), members in groups.items():
        copies += len(members)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if a[1] != b[1] and {a[2], b[2]} == {lo, hi}:
                    met.add((bucket, *sorted((a[0], b[0]))))
    want = {(b, x, y) for b, x, cx, *_ in rows for c, y, cy, *_ in rows if b == c and x < y and cx != cy}
    assert met == want
    assert copies <= 2 * len(rows) + 7 * 8


# --- operator 10 ---------------------------------------------------------------
def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    where: dict = {}
    for i, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((i, s))
    marks = [bytearray(len(t)) for t in raw]
    for found in where.values():
        if len(found) > 1:
            for i, s in found:
                marks[i][s : s + length] = b"\1" * length
    return [(sum(m), hashlib.sha256(bytes(x for x, f in zip(t, m) if not f)).hexdigest()) for t, m in zip(raw, marks)]


def passages(seed=1):
    """Documents that share a passage with other words before and after it, some repeated, some inside themselves."""
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), 5)) for _ in range(n))
    shared = word(12)
    texts = [word(int(rng.integers(0, 20))) + shared[: int(rng.integers(20, len(shared)))] + word(int(rng.integers(0, 20))) for _ in range(40)]
    return [*texts, texts[0], texts[0], shared * 3, "", None, "x" * 300]


@pytest.mark.parametrize("limits", [(4000, 1 << 20, 1 << 17), (4000, 300, 7), (3, 300, 64)])
def test_repeats_with_small_slices(spark, monkeypatch, limits):
    for name, value in zip(("GROUP_LIMIT", "CONTEXT_BYTES", "SUFFIXES"), limits):
        monkeypatch.setattr(repeats, name, value)
    texts = passages()
    out = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS), length=32).collect()
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 32)


def test_colliding_hashes_mark_nothing(spark, monkeypatch):
    """All suffixes of a group get one hash: bytes decide."""
    monkeypatch.setattr(repeats.RollingHash, "windows", _weak(repeats.RollingHash.windows))
    texts = passages(2)
    names = repeats.exact_names(np.frombuffer(b"abcabcabd", np.uint8), np.array([0, 3, 6, 1]), np.zeros(4, np.uint64), 3)
    assert names[0] == names[1] and len(set(names.tolist())) == 3
    out = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1), length=32).collect()
    assert [(r["n_removed"], r["kept_sha256"]) for r in sorted(out, key=lambda r: r["doc_id"])] == brute_repeats(texts, 32)


def _weak(plain):
    def windows(self, size):
        out = plain(self, size)
        return out & np.uint64(1) if size == 32 else out  # the names of suffixes; grams have half the length

    return windows


# --- operators 3 and 9 -----------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_table_of_odd_rows(spark, tokenizer_path, tmp_path):
    body = "Some words, here.\nAnd  there's more (much more)!\n\nEnd " * 300
    data = [(5, body), (5, "b"), (5, body), (None, "no id"), (None, None), (3, None), (4, ""), (9, "é 東京　x y"), (-7, " lead and trail ")]
    docs = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as part", "2 as ids", "3 as start")
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer_path=tokenizer_path)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    t, start = _tokenizer(tokenizer_path), 0
    assert [r["doc_id"] for r in rows] == [None, None, -7, 3, 4, 5, 5, 5, 9]
    texts = {None: [None, "no id"], 5: sorted(["b", body, body]), 3: [None], 4: [""], 9: [data[7][1]], -7: [data[8][1]]}
    for r in rows:
        text = texts[r["doc_id"]].pop(0)
        ids = [*(t.encode(text, add_special_tokens=False).ids if text else []), 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        start += len(ids)
    token_files.write_tokens(docs.limit(0), str(tmp_path / "e"), tokenizer_path=tokenizer_path)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_cuts_of_random_texts(tokenizer_path):
    t, rng = _tokenizer(tokenizer_path), np.random.default_rng(4)
    parts = [",", ".", "\n", ")", ";x", ".\n", "a\n", "a", "B", "é", " ", "  ", " ", " ", "　", "日本", "\x1c", "'s", "1", "<|endoftext|>", "ß", "\t", "\x85", " x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        pieces_ = token_files.pretoken_runs(text)
        assert "".join(pieces_) == text
        assert [i for p in pieces_ for i in t.encode(p, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_pieces_sent_to_the_model_get_the_same_ids(tokenizer_path):
    t, rng = _tokenizer(tokenizer_path), np.random.default_rng(9)
    encode = token_files.piece_encoder(t)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    words = ["".join([" " * int(rng.integers(0, 2)), *rng.choice(letters, rng.integers(1, 16))]) for _ in range(5000)]
    words += [" ", "  a", "é", " été", "a1", "it's", "\n", "<|endoftext|>", " endoftext", "\u0120a", " Straße", "œuvre", "\u024f", "×", "12", " 345x", " the", "The", "I"]
    assert encode(words) == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_forgetting_words_changes_no_ids():
    import pyarrow as pa

    calls = []
    known = pieces.WordIds(lambda ws: calls.append(ws) or [[len(w), ord(w[-1])] for w in ws], 5)
    for words in (["a", "bb", "a"], ["ccc", "a"], ["d", "e", "f", "a"], [], ["g", "h", "i", "j", "k", "l"]):
        ids, off = pieces.id_lists(pa.array(words, pa.large_string()), np.arange(len(words) + 1), known)
        assert ids.reshape(-1, 2).tolist() == [[len(w), ord(w[-1])] for w in words]
        assert off.tolist() == list(range(0, 2 * len(words) + 1, 2))
    assert all(ws == sorted(set(ws)) for ws in calls)


def test_lookup_by_doc_id_skips_stripes(spark, tokenizer_path, tmp_path):
    """The filter reaches the ORC scan, and row groups without the id are not read."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    token_files.write_tokens(docs.coalesce(1), str(tmp_path / "t"), tokenizer_path=tokenizer_path)
    one = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 12345")
    assert [r["doc_id"] for r in one.collect()] == [12345]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12345)" in one._jdf.queryExecution().executedPlan().toString()
    import pyarrow.orc as orc

    files = sorted((tmp_path / "t" / "tokens").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 20_000
    read = spark.read.orc(str(tmp_path / "t" / "tokens")).where("doc_id = 12345")
    plan = read.select("ids")
    plan.write.format("noop").mode("overwrite").save()
    scanned = plan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert scanned <= 2 * token_files.ROW_STRIDE


def test_digest_is_of_little_endian_ids(spark, tokenizer_path, tmp_path):
    spark.createDataFrame([(1, "abc def"), (2, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files.op3_orc_tokens(spark, str(tmp_path)).collect()}
    ids = [*_tokenizer(tokenizer_path).encode("abc def", add_special_tokens=False).ids, 2]
    assert got == {1: zlib.crc32(np.array(ids, "<u4").tobytes()), 2: zlib.crc32(np.array([2], "<u4").tobytes())}


# --- operator 8 ------------------------------------------------------------------
def test_codes_disclose_themselves(spark):
    """Random keys in words of a corpus are spans; long, rare or numbered words are not."""
    rng = np.random.default_rng(12)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda n: "".join(rng.choice(syllables, n))
    secret = ["".join(rng.choice(list("0123456789abcdef"), 40)), "sk" + "".join(rng.choice(list("ABCDEFGHijklmnop0123456789"), 24))]
    docs = [(i, " ".join(word(int(rng.integers(1, 5))) for _ in range(200))) for i in range(60)]
    docs += [(100, f'so token = "{secret[0]}" and on'), (101, f"é key: {secret[1]}, {secret[0]}"), (102, word(16) + "2024 " + word(14)), (103, None), (104, "mail a1b2c3d4e5f6a7b8c9d0@x.org")]
    out = {r["doc_id"]: r for r in disclosure.with_spans(spark.createDataFrame(docs, DOCS)).collect()}
    texts = dict(docs)
    found = {d: [texts[d][s["start"] : s["end"]] for s in r["term_spans"]] for d, r in out.items()}
    assert found[100] == [secret[0]] and found[101] == [secret[1], secret[0]]
    assert not any(found[d] for d in found if d not in (100, 101))


def test_surprisal_counts_pairs_within_rows(spark):
    texts = ["abab", None, "", "ba", "é"]
    got = disclosure.Surprisal.of(spark.createDataFrame([(t,) for t in texts], "text string"))
    pairs = np.zeros((256, 256))
    for t in texts:
        raw = (t or "").encode()
        for a, b in zip(raw, raw[1:]):
            pairs[a, b] += 1
    bits = np.log2(pairs.sum(axis=1, keepdims=True) + 256) - np.log2(pairs + 1)
    assert np.allclose(got.bits, bits) and got.mean == pytest.approx((pairs * bits).sum() / pairs.sum(), rel=1e-5)


# --- operator 4 ------------------------------------------------------------------
def brute_verdicts(rows):
    """kept by group fences, from plain counts: own documents plus 200 rows of the language, which leans on all."""

    def low(v):
        if v < 32:
            return v
        step = 1 << (v.bit_length() - 6)
        return v // step * step

    measures = list(quality_rules.MEASURES)
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["lang"], r["source"]), {})[r["text_key"]] = [low(r[m]) for m in measures]

    def counts(values):
        out: dict = {}
        for v in values:
            out[v] = out.get(v, 0) + 1
        return out

    def lean(own, parent):
        total = sum(parent.values())
        return {v: own.get(v, 0) + parent.get(v, 0) / total * quality_rules.PARENT_ROWS for v in own | parent}

    limits = {}
    for j, m in enumerate(measures):
        own = {g: counts(v[j] for v in docs.values()) for g, docs in groups.items()}
        langs: dict = {}
        for (lang, _), c in own.items():
            for v, n in c.items():
                langs.setdefault(lang, {})[v] = langs.setdefault(lang, {}).get(v, 0) + n
        every: dict = {}
        for c in langs.values():
            for v, n in c.items():
                every[v] = every.get(v, 0) + n
        for g, c in own.items():
            mixed = lean(c, lean(langs[g[0]], every))
            total, upto, found = sum(mixed.values()), 0.0, []
            for v in sorted(mixed):
                upto += mixed[v]
                found += [v] * (upto * 4 >= total * (len(found) * 2 + 1 - 1e-9)) if len(found) < 2 else []
                if len(found) == 1 and upto * 4 >= total * (3 - 1e-9):
                    found.append(v)
            q1, q3 = found
            reach = quality_rules.SPREADS * max(q3 - q1, quality_rules.MEASURES[m])
            limits[g, m] = (q1 - reach if m in quality_rules.TWO_SIDED else -1, q3 + reach)
    return {
        r["doc_id"]: not r["base_failed"] and all(lo <= r[m] <= hi for m in measures for lo, hi in [limits[(r["lang"], r["source"]), m]])
        for r in rows
    }


def test_verdicts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 17 != 0, F.col("source")))
    measured = quality_rules.with_measures(docs)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.with_verdicts(measured).collect()}
    assert got == brute_verdicts(measured.collect()) and 0 < sum(got.values()) < len(got)


def test_verdicts_do_not_follow_copies_or_clashing_columns(spark):
    """Three times the same table: the same verdict for every document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("__lk", F.lit("x"))
    one = {r["doc_id"]: r["kept"] for r in quality_rules.with_verdicts(quality_rules.with_measures(docs)).collect()}
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2000))
    three = {r["doc_id"]: r["kept"] for r in quality_rules.with_verdicts(quality_rules.with_measures(more)).collect()}
    assert three == {d + 1000 * i: k for d, k in one.items() for i in range(3)}


def test_personal_data_is_counted_by_kind(spark, tmp_path):
    """Counts by kind differ from each other and from the number of all matches."""
    docs = [
        (1, "a@b.co, c@d.org, e@f.net and 10.0.0.1"),
        (2, "4111 1111 1111 1111 or +44 20 7946 0958, +1 (555) 123-4567"),
        (3, None),
        (4, "256.1.1.1 4111111111111112 +1 23"),
        (None, "1.2.3.4 5.6.7.8"),
        (None, "1.2.3.4 5.6.7.8"),
    ]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = disclosure.op8_pii_disclosure(spark, str(tmp_path)).collect()
    got = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows))
    assert got == [(0, 0, 2, 0, 0), (0, 0, 2, 0, 0), (1, 3, 1, 0, 0), (2, 0, 0, 1, 2), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
    first = next(r for r in rows if r["doc_id"] == 1)
    assert first["base_sha256"] == hashlib.sha256(b"email:0:6,email:8:15,email:17:24,ip:29:37").hexdigest()


# --- operator 9 ------------------------------------------------------------------
def test_rows_go_to_python_a_few_megabytes_at_a_time(spark):
    """Texts of 12 MB in one partition come in batches of the bound; a session's own bound stays."""
    before = spark.conf.get(session.BATCH_SETTING, None)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab c "), 800).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    try:
        spark.conf.unset(session.BATCH_SETTING)
        vocabulary = pieces.Pieces.load()
        done = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
        assert done.where("decoded = text").count() == 3000
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 1 and max(found) < 2 * session.BATCH_BYTES
        spark.conf.set(session.BATCH_SETTING, "123456")
        pieces.encode(docs, vocabulary)
        assert spark.conf.get(session.BATCH_SETTING) == "123456"
    finally:
        spark.conf.unset(session.BATCH_SETTING) if before is None else spark.conf.set(session.BATCH_SETTING, before)


# --- operator 10 -----------------------------------------------------------------
def test_repeats_bound_their_batches(spark):
    before = spark.conf.get(session.BATCH_SETTING, None)
    try:
        spark.conf.unset(session.BATCH_SETTING)
        text = "".join(chr(97 + i * i % 23) for i in range(40)) + "x"
        docs = spark.createDataFrame([(1, text), (2, "y" + text), (3, "z")], DOCS)
        got = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(docs, length=40).collect()}
        assert got == {1: 41, 2: 41, 3: 0} and spark.conf.get(session.BATCH_SETTING) == str(session.BATCH_BYTES)
    finally:
        spark.conf.unset(session.BATCH_SETTING) if before is None else spark.conf.set(session.BATCH_SETTING, before)


# --- operator 6, candidates --------------------------------------------------------
def test_candidates_of_other_components_are_pairs_of_lines_only(spark, monkeypatch):
    """The same words in other orders pass the bit filters: they are written as (a, b), verified, and stay."""
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs = [(i, " ".join(["alpha", "beta", *rng.permutation(words)])) for i in range(8)] + [(20, "alpha beta " + " ".join(words))]
    docs.append((21, docs[-1][1].replace("wd", "other")))
    written = {}
    plain = line_dedup.materialize

    def recorded(df, name="table"):
        out = written[name] = plain(df, name)
        return out

    monkeypatch.setattr(line_dedup, "materialize", recorded)
    out = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert out == {**{i: 0 for i in range(8)}, 20: 0, 21: 1}
    assert written["line-rest"].columns == ["a", "b"] and written["line-rest"].count() > 0


def test_nearest_candidates_are_one_a_line_and_join_copies():
    """Groups of copies in components of their own: a pair a line, not all pairs, and one tree a group."""
    n = 300
    rng = np.random.default_rng(5)
    for sizes in ([n], [n // 10] * 10):
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        key = rng.permutation(n)
        columns = {"bucket": bucket, "key": key, "sim": np.full(n, 7), "size": np.full(n, 20), "low": np.zeros(n, int), "high": np.zeros(n, int),
                   "comp": key, "block": np.zeros(n, int), "lo": np.zeros(n, int), "hi": np.zeros(n, int)}
        batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))
        got = pa.Table.from_batches(line_dedup._close_pairs(28, 0.8, True, nearest=True)(iter([batch]))).to_pydict()
        assert len(got["a"]) == n - len(sizes)
        root = dict(zip(key.tolist(), key.tolist()))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(got["a"], got["b"]):
            root[find(a)] = find(b)
        assert len({find(x) for x in key.tolist()}) == len(sizes)


def test_lines_compared_and_verified_in_parts_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    docs = []
    for i in range(60):
        line = ["alpha", "beta", *np.random.default_rng(i % 12).permutation(words)[:12]]
        if i >= 12:
            line[int(rng.integers(2, 14))] = f"x{chr(97 + i % 26)}"
        docs.append((i, " ".join(line)))
    table = spark.createDataFrame(docs, DOCS)
    rows = sorted(map(tuple, line_dedup.without_duplicate_lines(table).select("doc_id", "text", "n_lines_removed").collect()))
    written = []
    plain = line_dedup.materialize

    def recorded(df, name="table"):
        written.append(name)
        return plain(df, name)

    monkeypatch.setattr(line_dedup, "materialize", recorded)
    monkeypatch.setattr(line_dedup, "PART_LINES", 1)
    monkeypatch.setattr(line_dedup, "PART_PAIRS", 1)
    got = sorted(map(tuple, line_dedup.without_duplicate_lines(table).select("doc_id", "text", "n_lines_removed").collect()))
    assert got == rows and sum(r[2] for r in rows) == 48
    assert written.count("line-rest-part") == line_dedup.PARTS and written.count("line-links-first") > 1


def test_small_blocks_are_compared_whole():
    """All pairs of a block under the three conditions, wherever the batches are cut."""
    rng = np.random.default_rng(11)
    n = 400
    words = rng.integers(0, 1 << 62, (3, 40), dtype=np.uint64)
    lines = [words[i % 3].copy() for i in range(n)]
    for line in lines:
        line[rng.integers(0, 40, int(rng.integers(0, 6)))] = rng.integers(0, 1 << 62, dtype=np.uint64)
    lines = [x[: int(rng.integers(30, 41))] for x in lines]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    masks = line_dedup.parity_masks(np.concatenate(lines), off)
    sims = line_dedup.simhashes(np.concatenate(lines), off)
    bucket, key = np.sort(rng.integers(0, 40, n)), rng.permutation(n)
    columns = {"bucket": bucket, "key": key, "sim": sims.view(np.int64), "size": np.diff(off), **dict(zip(line_dedup.MASKS, (m.view(np.int64) for m in masks)))}
    table = pa.table(columns)
    expected = set()
    for i in range(n):
        for j in range(i + 1, n):
            most = 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
            turned = sum(int(m[i] ^ m[j]).bit_count() for m in masks)
            if bucket[i] == bucket[j] and int(sims[i] ^ sims[j]).bit_count() <= 28 and abs(len(lines[i]) - len(lines[j])) <= most and turned <= 2 * int(most):
                expected.add((min(key[i], key[j]), max(key[i], key[j]), turned))
    for size in (7, n):
        got = pa.Table.from_batches(line_dedup._whole_pairs(28, 0.8)(iter(table.to_batches(max_chunksize=size)))).to_pydict()
        assert set(zip(got["a"], got["b"], got["far"])) == expected and len(got["a"]) == len(expected) > 50


def test_long_lines_that_differ_are_no_candidates(spark, monkeypatch):
    """Lines of 200 different words that share a block, in a small and a large block: told apart before their texts are fetched."""
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def line(first: str) -> str:
        return " ".join([first, "beta", *("".join(rng.choice(letters, 7)) for _ in range(200))])

    docs = [(i, line("alpha" if i < 20 else "gamma")) for i in range(80)]
    docs += [(100, docs[3][1].replace("alpha", "delta")), (101, docs[50][1].replace("gamma", "delta"))]
    met = []
    plain = line_dedup.materialize

    def recorded(df, name="table"):
        out = plain(df, name)
        if name in ("line-whole", "line-whole-part", "line-pairs", "line-nearest", "line-rest"):
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", recorded)
    out = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert {k for k, n in out.items() if n} == {100, 101} and sum(met) <= 20


# --- operator 2, the driver's memory ------------------------------------------------
def test_the_fit_holds_little_beside_the_features():
    """Features are worked out a run of rows at a time: the same sums, and a few bytes a feature."""
    rng = np.random.default_rng(13)
    off = np.concatenate([[0], np.cumsum(rng.integers(1500, 2500, 1000))])
    dims = 1 << 12
    ids = rng.integers(0, dims, off[-1]).astype(np.int32)
    y = rng.integers(0, 2, 1000)
    values = rng.normal(size=dims)
    assert (quality_model.feature_sums(ids, off, lambda at, rows, o: values[at]) == tv.row_sums(values[ids], off)).all()
    tracemalloc.start()
    quality_model.fit(ids, off, y, dims, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * ids.nbytes
