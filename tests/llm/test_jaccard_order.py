"""The order of tokens that the prefix filter needs."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import jaccard


def test_frequent_tokens_ascend_and_short_sets_meet(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 61}" for k in range(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    heavy = jaccard._heavy_tokens(df.withColumn("row_key", F.lit(0)), 8192, 3, 200_000)
    assert len(heavy) > 20 and (heavy[1:] > heavy[:-1]).all() and heavy[0] < 1 << 63 <= heavy[-1]
    rng = np.random.default_rng(6)
    for _ in range(20_000):
        a = rng.choice(np.concatenate([heavy, rng.integers(0, 1 << 64, 60, dtype=np.uint64)]), int(rng.integers(5, 11)), replace=False)
        a.sort()
        b = np.delete(a, int(rng.integers(len(a))))
        if jaccard.similar(a, b):
            assert set(jaccard.prefix(a, heavy).tolist()) & set(jaccard.prefix(b, heavy).tolist())


def word_sets(text):
    """Sets of plain tuples of words, told apart from what is tested."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [word_sets(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_short_documents_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(150):
        at, n = int(rng.integers(80)), int(rng.integers(9, 15))
        words = [f"w{(at + k) % 80}" for k in range(n)]
        if rng.random() < 0.5:
            words[0] = f"x{int(rng.integers(1000))}"
        texts += [" ".join(words), " ".join(words[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_shared_passages_copies_and_every_document_of_a_table(spark):
    """All documents of sf0.001, and made ones that share passages, against plain sets of words; frequent tokens, small groups, no broadcasts."""
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(60)]
    texts = list(real)
    for base in range(10):
        words = [f"b{base}w{k}" for k in range(int(rng.integers(30, 200)))]
        for copy in range(12):
            own = list(words)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(len(own)))] = f"x{base}{copy}{int(rng.integers(1000))}"
            texts.append(" ".join(own + (passage if copy % 3 else [])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts)
    for options in ({}, {"block": 3, "broadcast": 0, "sample": 64, "heavy_least": 2}):
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.jaccard_components(df, **options).collect()}
        assert [got[i][0] for i in range(len(texts))] == want
        assert [got[i][1] for i in range(len(texts))] == [len(word_sets(t)) for t in texts]


def test_repeated_rows_and_clashing_columns_are_carried_on(spark):
    rows = [(2, "a b c d e f g", 7, 1), (1, "A b c d e f g", 8, 2), (2, "a b c d e f g", 7, 1), (3, None, 9, 3), (4, "", 9, 4), (None, "a b c d e f g", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rk int, g int")
    got = sorted((tuple(r) for r in jaccard.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[4]], key=str)


def test_a_pair_is_given_out_once_and_sorted_out_by_parities(spark, monkeypatch):
    """Long documents that have much in common without being linked; before, each pair came at every token and whole sets were fetched for it."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(1500)]
        for copy in range(8):
            own = list(words)
            for k in range(int(rng.integers(2, 9)) * 4):
                own[int(rng.integers(len(own)))] = f"x{base}c{copy}k{k}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts)
    assert 6 < len(set(want)) < len(texts)
    rows, kept = {}, jaccard.stored

    def stored(of, name):
        out = kept(of, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    monkeypatch.setattr(jaccard, "CARRIED", 40)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    first, distinct = rows["jaccard-met"]
    assert distinct < first / 2
    assert sum(rows["jaccard-near"]) < sum(rows["jaccard-pairs"]) / 2


def test_parities_lose_no_link():
    rng = np.random.default_rng(9)
    kept = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.9 else int(rng.integers(2000, 50_000))
        gone = int(rng.random() * 0.25 * n)
        tokens = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
        a = np.sort(rng.permutation(tokens)[:n])
        b = np.sort(np.concatenate([rng.permutation(a)[: n - gone], rng.integers(0, 1 << 64, int(rng.random() * gone), dtype=np.uint64)]))
        may = jaccard.may_link(jaccard.parities(a), jaccard.parities(b), len(a), len(b))
        assert may or not jaccard.similar(a, b)
        kept += may and not jaccard.similar(a, b)
    assert kept < 300
