"""The ten operators against brute force on small inputs: nulls, empties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simtrail.llm import (
    decontaminate,
    disclosure,
    line_dedup,
    near_dedup,
    page_text,
    pieces,
    quality_model,
    quality_rules,
    repeats,
    token_files,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())


def odd(spark):
    """Nulls, empty texts, ties, repeated rows, and extra columns whose names clash."""
    body = " ".join(f"word{i}" for i in range(80))
    data = [(1, body), (1, body), (2, None), (3, ""), (None, body + " more"), (4, "!!!"), (5, "Été\n\nçà " + body), (6, "x" * 5000)]
    return spark.createDataFrame(data, DOCS).selectExpr("*", "1 as score", "'a' as ids", "2 as n_words", "'en' as lang", "'s' as source")


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, empty):
    docs = odd(spark).limit(0) if empty else odd(spark)
    n = 0 if empty else 8
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vocabulary = pieces.Pieces.load()
    assert near_dedup.near_duplicates(docs)[0].count() == n
    assert quality_model.with_scores(docs, quality_model.train(docs, labels)).count() == n
    assert quality_rules.with_verdicts(quality_rules.with_measures(docs)).count() == n
    assert decontaminate.contamination(docs, items).where("contaminated").count() == (0 if empty else 4)
    assert line_dedup.without_duplicate_lines(docs).count() == n
    assert disclosure.with_spans(docs).count() == n
    encoded = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    assert encoded.where(F.col("decoded") == F.coalesce("text", F.lit(""))).count() == n
    assert repeats.without_repeats(docs).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "score")
    assert page_text.with_main_text(pages, page_text.train(pages)).count() == n


def test_near_duplicates_find_every_similar_pair(spark, documents, rows):
    def shingles(text):
        w = WORD.findall(lower(text))
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()

    sets = {d: shingles(t) for d, t in rows}
    df = Counter(s for c in sets.values() for s in c)
    total = np.log(sum(1 for c in sets.values() if c))
    idf = {s: 2 - np.log(n) / total for s, n in df.items()}
    classes, links = near_dedup.near_duplicates(documents)
    of = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum(idf[s] * min(sets[a][s], sets[b][s]) for s in sets[a].keys() & sets[b].keys())
            if both:
                either = sum(idf[s] * n for s, n in (sets[a] + sets[b]).items()) - both
                if both / either >= 0.82:  # hashed frequencies move the similarity a little
                    assert of[a] == of[b], (a, b)
    assert links.where("similarity < 0.8").count() == 0


def test_jaccard_of_known_sets():
    off = np.array([0, 3])
    h = np.array([1, 2, 3], np.uint64)
    got = near_dedup.jaccard(h, np.array([1, 2, 1], np.float32), off, np.array([2, 3, 9], np.uint64), np.ones(3, np.float32), off)
    assert got[0] == pytest.approx(2 / 5)


def test_weighted_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    wa, wb = rng.uniform(1, 2, 300).astype(np.float32), rng.uniform(1, 2, 300).astype(np.float32)
    wb[:60] = 1e-6
    s = near_dedup.weighted_samples(np.concatenate([h, h]), np.concatenate([wa, wb]), np.array([0, 300, 600]), 2000, near_dedup.sampling_tables())
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_model.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    right = out.where("predicted = quality").count()
    assert right >= 0.95 * out.count() and docs.count() == 1000


def test_token_files_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_files.op3_orc_tokens(spark, SF).collect()}
    start = 0
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"]) == (start, len(ids))
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("text", ["a b", " a", "a ", "a  b", "a\n b", "it's 5 o'clock\t x", "é à b", "", "<|endoftext|> x"])
def test_cut_texts_encode_like_whole_ones(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = token_files.pretoken_runs(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in t.encode(p, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_base_measures(spark, rows, documents):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r["doc_id"]: r for r in quality_rules.with_measures(documents).collect()}
    for d, t in rows:
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))


def test_sketch_buckets(spark):
    got = spark.range(100_000).select("id", quality_rules.bucket_of(F.col("id")).alias("b")).withColumn(
        "low", quality_rules.bucket_low(F.col("b")))
    per = got.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("low").alias("low"))
    assert per.where("lo != low or (hi - lo) * 32 > lo").count() == 0


def contaminated(docs, items, window=10):
    windows: dict = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[k]
        names = ",".join(sorted(map(str, found)))
        yield d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest()


def test_contamination_is_exact(spark, rows, documents):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900, rows[3][1][:14]), (901, "the"), (902, ""), (903, None), (904, rows[5][1][:40])]  # shorter than a window
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {tuple(r)[:5] for r in decontaminate.contamination(documents, items).collect()}
    assert got == set(contaminated(rows, bench))


def test_line_groups(spark):
    base = " ".join(f"alpha{i} beta{i}" for i in range(60))
    near = base.replace("beta30", "gamma30")
    docs = spark.createDataFrame(
        [(1, f"{base}\nshort line"), (2, f"one\n{near}\nshort line"), (3, base.upper() + "!"), (4, "totally other words are standing here now")], DOCS)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert out[1] == f"{base}\nshort line" and out[3] == "" and out[4].startswith("totally")
    sims = line_dedup.line_table(np.frombuffer(f"{base}\n{near}".encode(), np.uint8), np.array([0, len(base) + len(near) + 1]))[5]
    assert (out[2] == "one\nshort line") == (int(np.bitwise_count(sims[0] ^ sims[1])) <= 3)


def test_close_lines_are_all_met(spark):
    """Every pair of SimHashes within three bits ends in one component (all lengths equal, all verified)."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 40)
    sims = [int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(5)]
    run = line_dedup._close_pairs(3, 0.8, False)
    import pyarrow as pa

    rows = sorted((s >> 16 * i & 0xFFFF | i << 16, k, s, 10) for k, s in enumerate(sims) for i in range(4))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["bucket", "key", "sim", "size"])
    met = {x for b in run(iter([batch])) for c in ("a", "b") for x in b.column(c).to_pylist()}
    want = {x for i, s in enumerate(sims) for j, t in enumerate(sims[:i]) if (s ^ t).bit_count() <= 3 for x in (i, j)}
    assert met == want


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (list(rng.integers(0, 3, rng.integers(0, 12))) for _ in "ab")
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_page_text_of_an_unseen_make(spark):
    model = page_text.train(spark.read.parquet(f"{SF}/pages.parquet"))
    page = (
        "<html><head><title>t</title><script>if(a<b){'</p>'}</script></head><body><header><a href=/>Home</a></header>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><aside><p>Side words go here.</p></aside>"
        "<article><h1>T &amp; <b>x</b></h1><p>One\n  two<br>three<p>Four<div class='ad'>Buy</div>"
        "<form><p>Name</p><input></form></article><section id='comments'><p>Nice text!</p></section><footer>&copy;</footer>"
    )
    assert model.text(page) == "T & x\nOne two three\nFour"


def test_base_patterns_match_the_expressions():
    rng = np.random.default_rng(7)
    parts = ["a", "@", ".", "1", "255", "256", "+", "-", " ", "4111111111111111", "(", "b.c", "%", "x@y.z", "\n", "é", "1.2.3.4"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        t = "".join(rng.choice(parts, rng.integers(1, 20)))
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in disclosure.base_spans(t) if s[0] < 2] == want


def test_terms_that_disclose_an_entity(spark):
    lines = [f"agent Zorblax wrote from zx@spy.org on topic number{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(i, f"agent wrote on topic number{i} again") for i in range(10, 60)], DOCS)
    found = {r["doc_id"]: r for r in disclosure.with_spans(docs).collect()}
    assert [lines[0][s["start"] : s["end"]] for s in found[0]["term_spans"]] == ["Zorblax", "from"]
    assert not found[20]["term_spans"] and not found[20]["base_spans"]
    assert disclosure.sanitised(docs).where("doc_id = 0").first()["text"].startswith("agent <NAME> wrote")


def test_viterbi_equals_plain_dynamic_programming():
    vocabulary = pieces.Pieces.load()
    score = {p: s for p, s, u in zip(vocabulary.pieces, vocabulary.scores, vocabulary.usable) if u}
    words = sorted({"▁" + w for w in "hello help helping Straße naïve x 日本 a▁b tion nation".split()})
    got = pieces.encode_sorted(words, vocabulary.trie(), vocabulary.byte_ids, vocabulary.byte_score())
    for word, ids in zip(words, got):
        best = [0.0] + [-1e18] * len(word)
        for j in range(1, len(word) + 1):
            best[j] = best[j - 1] + len(word[j - 1].encode()) * vocabulary.byte_score()
            for i in range(j):
                if word[i:j] in score and "▁" not in word[max(i, 1) : j]:
                    best[j] = max(best[j], best[i] + score[word[i:j]])
        mine = sum(vocabulary.byte_score() if i in vocabulary.byte_ids else vocabulary.scores[i] for i in ids)
        assert mine == pytest.approx(best[-1])


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [8000, 1])
def test_repeats_are_exact(spark, monkeypatch, documents, rows, keep_first, limit):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    places: dict = {}
    raw = [(t or "").encode() for _, t in rows]
    for j, b in enumerate(raw):
        for s in range(len(b) - 399):
            places.setdefault(b[s : s + 400], []).append((j, s))
    marks = [bytearray(len(b)) for b in raw]
    for found in places.values():
        for j, s in found[1:] if keep_first else found if len(found) > 1 else ():
            marks[j][s : s + 400] = b"\1" * 400
    got = {r["doc_id"]: r for r in repeats.without_repeats(documents, keep_first=keep_first).collect()}
    for (d, _), b, m in zip(rows, raw, marks):
        kept = bytes(x for x, f in zip(b, m) if not f)
        assert (got[d]["n_removed"], got[d]["kept_sha256"]) == (sum(m), hashlib.sha256(kept).hexdigest())


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.where("not exact").count() == 0
    assert 100 < out.count() < 200 and out.select("doc_id").distinct().count() == out.count()


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line))))


def line_roots(pairs):
    """The least member of each connected group."""
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_edited_lines_are_found(spark):
    """Planted edits of 5- to 60-word lines down to similarity 0.8: each copy is removed."""
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "the of re con lyn ara mi to est".split() for b in "a on ing er ti sh ble ou".split()]
    docs, n = [], 0
    for size in range(5, 61):
        for _ in range(4):
            base = [f"x{n}y" if rng.random() < 0.2 else w for w in rng.choice(vocabulary, size)]
            n += 1
            copy = list(base)
            for _ in range(size // 5):  # substitutions keep the longer length at ``size``
                copy[rng.integers(size)] = str(rng.choice(vocabulary))
            if copy != base:
                docs.append((len(docs), "\n".join([" ".join(base)])))
                docs.append((len(docs), " ".join(copy)))
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(table).collect()}
    found = [out[i] == "" for i in range(1, len(docs), 2)]
    assert all(out[i] for i in range(0, len(docs), 2)) and np.mean(found) >= 0.99


def test_similar_lines_are_linked_as_by_brute_force(spark, rows):
    """Lines of sf0.001: components of all pairs that reach the similarity."""
    lines = sorted({normal(x) for _, t in rows for x in (t or "").split("\n")})
    words = [x.split() for x in lines]
    keep = [i for i, w in enumerate(words) if len(w) >= line_dedup.MIN_WORDS]
    pairs = []
    for i, a in enumerate(keep):
        for b in keep[i + 1 :]:
            x, y = words[a], words[b]
            bound = int(0.2 * max(len(x), len(y)) + 1e-9)
            if abs(len(x) - len(y)) <= bound and sum((Counter(x) & Counter(y)).values()) >= max(len(x), len(y)) - bound:
                if line_dedup.edit_distance(x, y) <= bound:
                    pairs.append((a, b))
    table = spark.createDataFrame([(i, lines[i]) for i in keep], DOCS)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(table).collect()}
    assert pairs
    assert {i for i in keep if out[i] == ""} == {x for x, r in line_roots(pairs).items() if x != r}


@pytest.mark.parametrize("limit", [2048, 2])
def test_many_lines_of_one_template(spark, monkeypatch, limit):
    """A template with one name links to one group; lines that share words but not enough stay; small blocks change nothing."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", limit)
    near = [f"copyright notice of the archive kept by name{chr(97 + i % 26)}{chr(97 + i // 26)} since then" for i in range(60)]
    far = [f"copyright notice {' '.join(f'{w}{chr(97 + i)}' for w in ('some', 'other', 'words', 'stand', 'here'))}" for i in range(20)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(near + far)], DOCS)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert [i for i in range(80) if out[i]] == [0, *range(60, 80)]


def test_short_equal_lines_go_in_the_query(spark, tmp_path):
    """Lines of one to four words, of any script, collapse with their equals; a line without a word stays."""
    data = [(1, "All rights reserved.\n東京都は日本の首都です\n---"), (2, "all rights  reserved\nmore\n---"), (3, "東京都は日本の首都です\nMore!\n大阪")]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in line_dedup.op6_simhash_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {1: (data[0][1], 0), 2: ("more\n---", 1), 3: ("大阪", 2)}


@pytest.mark.parametrize("name", ["Ann", "Lee", "Bo"])
def test_short_names_disclose_an_entity(spark, name):
    lines = [f"agent {name} wrote from zx@spy.org on topic number{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(i, f"agent wrote on topic number{i} again") for i in range(10, 60)], DOCS)
    found = {r["doc_id"]: r for r in disclosure.with_spans(docs).collect()}
    assert [lines[0][s["start"] : s["end"]] for s in found[0]["term_spans"]] == [name, "from"]
    assert not found[20]["term_spans"]
