"""Periodic runs, hard negatives and token files against brute-force versions and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsquorum.llm import negatives, oracles, queries, runs, tokenfile

WORDS = r"[^\x20\x09-\x0D]+"


def plain_runs(w, least=24, exponent=3):
    """All stretches by every period, smallest periods only."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=5), st.sampled_from([(1, 2), (6, 3), (24, 3)]), st.integers(1, 9), st.integers(0, 40))
def test_runs_equal_those_found_by_every_period(docs, limits, period, start):
    least, exponent = limits
    docs = [*docs, *[[d[i] if i < start else d[start + (i - start) % period] for i in range(len(d))] for d in docs if len(d) > start + period]]
    assert runs.word_runs(docs, least, exponent) == [plain_runs(d, least, exponent) for d in docs]


def test_runs_of_extreme_documents():
    thue = [bin(i).count("1") % 2 for i in range(512)]  # no cube at all
    found = runs.word_runs([[1] * 5000, list(range(700)) * 4, thue, list(range(5000)), []])
    assert found == [[(0, 5000, 1)], [(0, 2800, 700)], [], [], []]
    assert runs.collapsed(list("xabababab"), [(1, 8, 2)]) == list("xab")


def test_query_of_runs_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w = re.findall(WORDS, text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w) if n < 1500 else runs.word_runs([w])[0]
        some += len(found)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        row = got[doc_id]
        assert row["n_runs"] == len(found)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert some


def test_runs_of_odd_rows(spark):
    rows = [(None, "a b " * 20), (1, None), (1, ""), (2, "\x85x y z \t\n" * 30), (2, "\x85x y z \t\n" * 30), (3, "w " * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("n_words", "runs", "collapsed", "start", "Period")})
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(odd).collect())
    assert got == [(0, 40, [(0, 40, 2)], "a b"), (1, 0, [], ""), (1, 0, [], ""), (2, 60, [(0, 60, 2)], "\x85x y z"), (2, 60, [(0, 60, 2)], "\x85x y z"), (3, 200_000, [(0, 200_000, 1)], "w")]
    assert runs.find_runs(odd.limit(0)).collect() == []
    tie = F.array(*[F.struct(F.lit(s).cast("long").alias("start"), F.lit(n).cast("long").alias("length"), F.lit(p).cast("long").alias("period")) for s, n, p in ((9, 40, 4), (2, 30, 3), (2, 60, 6), (0, 24, 8))])
    assert tuple(spark.range(1).select(runs.strongest(tie).alias("r")).first()["r"]) == (2, 30, 3)


def plain_negatives(rows, asks, positives=5, negs=10):
    out = []
    fit = [(k, i, lab, [int(np.floor(256 * x)) for x in v]) for k, (i, lab, v) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for k, i, lab, q in fit:
        if not asks(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j, m, other == lab) for m, j, other, v in fit if m != k and len(v) == len(q)), key=lambda r: r[:3])
        for minus, j, _, _ in [s for s in scored if s[3]][:positives]:
            hard = [(n, -score) for score, n, _, same in scored if not same and 30 * -minus <= 100 * -score <= 90 * -minus][:negs]
            out += [(i, j, r, n, -minus, score) for r, (n, score) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    result = con.execute(oracles.NEGATIVES)
    names = [d[0] for d in result.description]
    got = queries.op12_negatives(spark, sf_dir)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_of_odd_rows(spark, seed, monkeypatch):
    """Ties, repeated ids and rows, two lengths, odd lengths, negative and empty vectors, nulls; many small blocks."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = random.Random(seed)
    rows = [(rng.randrange(80), rng.randrange(3), [rng.choice([-0.5, 0.1, 0.25, 0.3, 0.9]) for _ in range(rng.choice([3, 3, 3, 4]))]) for _ in range(150)]
    rows += [rows[0]] * 3 + [(5, 1, []), (10, 2, []), (15, 1, []), (None, 1, [0.1] * 3), (20, None, [0.1] * 3), (25, 1, None), (30, 1, [0.1, None, 0.2]), (35, 1, [0.1, float("nan"), 0.2]), (40, 1, [0.1, float("inf"), 0.2])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("uid", "id", "rank", "asks", "dim", "score")})
    got = negatives.mine_negatives(frame.repartition(3), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert negatives.mine_negatives(frame.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    rows = rng.integers(-300, 300, (500, 7))
    rows[:250, 2] = 9  # half of the rows in one cell
    anchors = rng.integers(-300, 300, (5, 7))
    low, high = negatives.Approximation.of(rows).bounds(anchors, slice(None))
    exact = rows @ anchors.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.25 * (exact.max() - exact.min())


def test_scores_that_overflow_are_an_error(spark):
    frame = spark.createDataFrame([(0, 1, [1e12, 1.0]), (1, 1, [1e12, 1.0])], "vec_id bigint, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine_negatives(frame, F.col("vec_id") == 0).collect()


@pytest.fixture(scope="module")
def tokenizer():
    return tokenfile.ByteTokenizer(queries.tokenizer_path("byte_bpe_50k.json"))


def test_words_are_encoded_as_whole_texts_are(tokenizer):
    rng = random.Random(1)
    parts = ["a", "B", "é", "Straße", " ", "  ", "\n", ".", ",", "'s", "12", "\t", " ", "日", "<|endoftext|>", " .", "\x01", "_", "\x1c", "́", "-", ". ", ", "]
    assert tokenizer.splits
    for weights in (None, [10, 5, 3, 3, 12, 1, 3, 3, 3, 2, 2] + [0.1] * 10 + [4, 4]):
        texts = ["".join(rng.choices(parts, weights, k=rng.randint(0, 14))) for _ in range(4000)]
        want = [e.ids for e in tokenizer.plain.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in tokenizer.encode_all(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000), st.integers(0, 5))
def test_coding_round_trip(ids, hot):
    ids = np.array(ids * 2 + [7] * (hot * 1000), "<u4")
    seen, counts = np.unique(ids, return_counts=True)
    table = tokenfile.Frequencies.from_bytes(tokenfile.Frequencies.of_counts(seen, counts).to_bytes())
    assert table.freq.sum() == 1 << tokenfile.SCALE and table.freq.min() >= 1
    words, marks = tokenfile.encode_ids(ids, table)
    assert (tokenfile.decode_ids(words, marks, len(ids), table) == ids).all()


def test_coding_is_near_the_entropy_and_starts_at_checkpoints():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.02, 400_000), 50_000).astype("<u4")
    seen, counts = np.unique(ids, return_counts=True)
    table = tokenfile.Frequencies.of_counts(seen, counts)
    words, marks = tokenfile.encode_ids(ids, table)
    share = counts / counts.sum()
    assert 32 * len(words) < 1.01 * -(share * np.log2(share)).sum() * len(ids)
    step = tokenfile.INTERVAL * tokenfile.LANES
    assert len(marks) == 2 and (tokenfile.decode_ids(words, marks, len(ids), table, 1) == ids[step:]).all()
    rare = tokenfile.Frequencies.of_counts(np.arange(200_000), np.append(10**15, np.ones(199_999)))
    assert rare.freq.sum() == 1 << tokenfile.SCALE and rare.freq.min() == 1


def test_checksums_are_joined():
    a, b = b"one stretch", bytes(range(256)) * 40
    assert tokenfile.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tokenfile.crc_joined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_query_of_token_files_equals_the_tokenizer(spark, sf_dir, tokenizer):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op13_tokens(spark, sf_dir).collect()}
    at = 0
    for doc_id, text in docs:
        ids = np.array([*tokenizer.plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(doc_id) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert not got


def test_token_files_of_odd_rows(spark, tokenizer):
    """Nulls, repeats, clashing names, documents over many blocks; what is damaged isn't read."""
    rows = [(5, "five"), (None, "no id"), (2, None), (2, "two again"), (7, "word " * 3000), (None, "no id"), (-3, "<|endoftext|> x"), (9, "")]
    odd = spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit("x") for c in ("row", "n", "ids", "part", "at")})
    path = queries.tokenizer_path("byte_bpe_50k.json")
    folder, files = tokenfile.write_token_files(odd.coalesce(1), path, block=100)
    pieces = tokenfile.read_pieces(spark, folder, files, with_ids=True)
    got = tokenfile.documents_of(pieces, files).orderBy("start").collect()
    order = [rows[k] for k in (1, 5, 6, 2, 3, 0, 4, 7)]
    want, at = [], 0
    for doc_id, text in order:
        ids = np.array([*tokenizer.plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    long = [x for r in pieces.where("doc_id = 7").orderBy("at").collect() for x in r["ids"]]
    assert long == [*tokenizer.plain.encode(rows[4][1], add_special_tokens=False).ids, 2]
    folder, files = tokenfile.write_token_files(odd.limit(0), path)
    assert files.count() == 0 and tokenfile.documents_of(tokenfile.read_pieces(spark, folder, files), files).collect() == []
    with pytest.raises(TypeError):
        tokenfile.tokenized(odd.withColumn("doc_id", F.lit("a")), path)


def test_damage_is_found():
    ids = np.arange(3000, dtype="<u4") % 50
    table = tokenfile.Frequencies.of_counts(np.arange(50), np.full(50, 60))
    data = tokenfile.block_bytes([1, None], [1000, 2000], ids, table)
    block = tokenfile.read_block(data, table)
    assert block.doc_ids == [1, None] and (block.ids == ids).all()
    for at in (3, 40, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(tokenfile.TokenFileError):
            tokenfile.read_block(bytes(broken), table)
    other = tokenfile.Frequencies.of_counts(np.arange(50), np.arange(1, 51))
    with pytest.raises(tokenfile.TokenFileError):
        tokenfile.read_block(data, other)
    with pytest.raises(tokenfile.TokenFileError):
        tokenfile.Frequencies.from_bytes(table.to_bytes()[:-1])


def test_each_different_word_is_looked_up_once():
    """Words are found in the memory once per call, however often they come; marks and digits need no search of whole words."""
    tokenizer = tokenfile.ByteTokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    looked = []

    class Memory(dict):
        def __getitem__(self, w):
            looked.append(w)
            return super().__getitem__(w)

        def get(self, w, default=None):
            looked.append(w)
            return super().get(w, default)

    tokenizer.known = Memory()
    texts = ["one two. three, one 1.2.3.4 wasn't a×b é÷é### two!\n\none  x\n" * 300, "two one", "a\u00a0b two \u2003", "", "it's \x01 odd"]
    for _ in range(2):
        looked.clear()
        got = tokenizer.encode_all(texts)
        assert [ids.tolist() for ids in got] == [tokenizer.plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(looked) < 60


def test_ids_are_counted_as_they_are_written(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"word{i} and " * (i % 7) if i % 5 else None) for i in range(60)], "doc_id bigint, text string").repartition(4)
    made = tokenfile._tokenized(docs, path, "doc_id", "text", 2).cache()
    want = Counter(int(t) for r in made.where("ids IS NOT NULL").collect() for t in tokenfile._unpacked(bytes(r["ids"])))
    assert {r["id"]: r["n"] for r in tokenfile._counted(made.select("counts")).collect()} == want and want[2] == 60
    assert tokenfile.tokenized(docs, path).count() == 60
    assert tokenfile._counted(tokenfile._tokenized(docs.limit(0), path, "doc_id", "text", 2)).collect() == []
