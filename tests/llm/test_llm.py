"""The training-data operators against brute force, round trips and held-out accuracy, with the hard cases."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chains, components, html_text, jaccard, language, lines, media, mixing, neighbours, quality, toxicity

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
HARD = [
    (1, "the quick brown fox jumps over it", "en", "a"), (1, "the quick brown fox jumps over it", "en", "a"), (2, None, None, None), (3, "", "", ""),
    (None, "the quick brown fox jumps over it", "fr", "b"), (4, " \n\t ", "de", None), (5, "x" * 50_000, "en", "a"), (6, "word " * 30_000, "en", "a"), (7, "日本 😀 1 ½", None, "c"),
]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id bigint, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("bigint")).withColumns({"ids": F.lit("clash"), "size": F.lit("clash"), "n_lines": F.lit("clash"), "quality_score": F.lit("clash")})


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


def test_bpe_equals_tiktoken_and_round_trips(spark, hard, empty):
    ranks = bpe.load_ranks(PATH)
    folder = bpe.WordFolder(ranks, tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice(list("ab' \n\t é1!s日\x1c\r")) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["ab" * 3000, " a ", "a  b"]
    for x in texts:
        packed = folder.packed(x)
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(x)
        assert folder.decode(packed) == x.encode()
    for r in bpe.encode_documents(hard, PATH, tokenizers.PATTERN).collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_documents(empty, PATH, tokenizers.PATTERN).count() == 0


def test_bpe_in_higher_order_functions(spark):
    df = spark.createDataFrame([(1, "naïve  café, don't\n\n x"), (2, None), (3, "")], "doc_id int, text string")
    a = {r.doc_id: r.ids for r in bpe.encode_documents_native(df, PATH, tokenizers.PATTERN, map_words=64).collect()}
    b = {r.doc_id: r.ids for r in bpe.encode_documents(df, PATH, tokenizers.PATTERN).collect()}
    assert a == b


def test_vp_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8))
    x[100:140] = x[7]
    ids = np.arange(1500)
    tree = neighbours.VpTree(ids, x, float(np.linalg.norm(x, axis=1).max()) * 1.001, 6)
    s = x[:60] @ x.T
    for q, rows in enumerate(tree.search(x[:60], 6, 1.0)):
        got = sorted(((-float(tree.vectors[r] @ x[q]), int(i)) for r in rows for i in tree.ids[r]))[:6]
        want = np.sort(-s[q])[:6]
        assert np.allclose([a for a, _ in got], want)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)]) for i in range(200)]
    rows[50] = (50, rows[20][1])
    rows[51] = (51, rows[20][1])
    rows += [(400, None), (420, [0.0] * 6), (440, [float("nan")] * 6), (460, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, k=5, shard=64, block=4).collect()
    ids = np.array([i for i, _ in rows[:200]])
    x = np.array([v for _, v in rows[:200]])
    for q in range(0, 200, 20):
        s = (x * x[q]).sum(axis=1)
        want = sorted((-s[i], ids[i]) for i in range(200) if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert [m[2] for m in mine] == [-w[0] for w in want]
    assert {r.query_id for r in got} == set(range(0, 200, 20))
    assert neighbours.nearest(df.limit(0)).count() == 0


def brute_components(rows):
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_components(spark, hard, empty):
    rng = random.Random(2)
    rows = []
    for base in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 120))]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = str(rng.random())
            rows.append((len(rows), " ".join(own).upper()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (1024, 4):
        got = jaccard.jaccard_components(df, block=block, heavy_least=3).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    got = jaccard.jaccard_components(hard).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components([(d, t) for d, t, _, _ in HARD])
    assert jaccard.jaccard_components(empty).count() == 0
    left = jaccard.drop_near_duplicates(hard)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "6", "7"]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_toxicity_on_held_out_rows(spark, hard, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = toxicity.fit(docs.where(train), labels.where(train))
    out = toxicity.score(docs.where(~train), model).join(labels, "doc_id").toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.95
    rows = toxicity.score(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([], []).score(1.0) < 0.01


def test_chain_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    u, pair = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    lengths = np.array([5, 4, 2])
    joint = np.zeros((2, 2))
    got = chains.binary_marginals(u, lengths, pair, joint)
    want_joint = np.zeros((2, 2))
    for r, n in enumerate(lengths):
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            p = np.exp(sum(u[r, i] * y[i] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            ones += p * np.array(y)
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += p
        assert np.allclose(got[r, :n], ones / total)
        want_joint += pairs / total
    assert np.allclose(joint, want_joint)


def test_tree_marginals_against_enumeration():
    parent, unary, pair = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.5, 2.0, -0.2], (0.4, -0.3, -0.5, 0.6)
    total, ones = 0.0, np.zeros(5)
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        p = np.exp(sum(a * b for a, b in zip(unary, y, strict=True)) + sum(pair[2 * y[parent[i]] + y[i]] for i in range(1, 5)))
        total += p
        ones += p * np.array(y)
    assert np.allclose(html_text.marginals(parent, unary, pair)[0], ones / total)


def test_mixing(spark, hard, empty):
    out = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    one = out.groupby("source").agg(size=("size", "sum"), whole=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), big=("size", "max"))
    assert (one["size"] == one.whole).all() and (abs(one.taken - one.target) <= one.big).all() and (out.taken <= 2 * out["size"]).all()
    # targets by reference: share by weight, stop at twice the size, share the excess again
    left, targets, open_ = 1.5 * one["size"].sum(), {}, dict(zip(sorted(one.index), [(5, 2, 1)[i % 3] for i in range(len(one))], strict=True))
    while True:
        unit = left / sum(open_.values())
        over = [s for s, w in open_.items() if unit * w > 2 * one["size"][s]]
        if not over:
            break
        for s in over:
            targets[s] = 2 * one["size"][s]
            left -= targets[s]
            del open_[s]
    targets |= {s: unit * w for s, w in open_.items()}
    assert all(abs(targets[s] - one.target[s]) < 1e-6 * one.target[s] for s in one.index)
    rows = mixing.mix_sources(hard).collect()
    assert len(rows) == len(HARD) and all(isinstance(r.size, int) for r in [*rows] if not callable(r.size)) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_quality(spark, hard, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 4 == 0
    model = quality.fit(docs, labels.where(~held))
    out = quality.classify(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert ((out.quality_score >= 0.5) == (out.quality == 1)).mean() > 0.95
    rows = quality.classify(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.classify(empty, model).count() == 0
    assert quality.fit(empty, labels).constant == 0.5


def test_html(spark):
    e = html_text.Extractor()
    page = (
        "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><ul><li><a href=/a>Menu one</a></ul></nav><header><p>Site name</p></header>"
        "<div id='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>First  para<br>goes\non &lt;here&gt;.<p>Second <b>bold</b> one</p>"
        "<aside class=sidebar><p>Related things</p></aside><form><p>Subscribe</p></form></article><section class=comments><p>I disagree</p></section><footer>&copy; me</footer>"
    )
    assert e.text(page) == "A & B\n\nFirst para goes on <here>.\n\nSecond bold one"
    assert e.text(None) == e.text("") == e.text("<") == ""
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "", "<p>" * 3000)], "page_id bigint, url string, html string")
    assert [r.n_chars for r in html_text.extract(df).orderBy("page_id").collect()][2:] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


def test_language(spark, hard, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 4 <> 2"))
    out = language.identify(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97
    rows = {(r.doc_id, r.lang_pred) for r in language.identify(hard, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= rows
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(hard, language.train([], [])).collect()} == {"und"}


def test_mixed_language_spans():
    model = language.train(["the cat and the dog were with this thing " * 5, "который этот была если только они когда " * 5], ["en", "ru"])
    _, tokens, path, _ = next(model.spans(["the cat with the dog только когда этот они была"]))
    assert [model.languages[k] for k in path] == ["en"] * 5 + ["ru"] * 5


def test_media_round_trip_and_carving(spark, hard, empty):
    for n in (1, 2, 3, 50):
        for seed in range(12):
            payload = random.Random(seed).randbytes(64 * n)
            kind, blob = media.wrap(payload)
            assert media.sniff(blob) == [(kind, 0, len(blob))] and media.unwrap(kind, blob) == payload
            carved = media.sniff(b"BM junk RIFF" + blob + b"tail")
            assert carved == [(kind, 12, len(blob))]
            assert media.sniff(blob[:-1]) == [] or kind == "audio/wav"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(8) + b"\0\x02\x02\x44\x01\0\x3b"
    assert media.sniff(b"xx" + gif)[0][:2] == ("image/gif", 2)
    rows = media.store_texts(hard).collect()
    for r, (_, t, _, _) in zip(sorted(rows, key=lambda r: r.n_bytes), sorted(HARD, key=lambda x: len((x[1] or "").encode())), strict=True):
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), size, hashlib.sha256(raw + bytes(size - len(raw))).hexdigest())
    assert media.store_texts(empty).count() == 0
    blobs = spark.createDataFrame([(1, media.wrap(bytes(64))[1], "image/png"), (2, None, None), (3, b"", "x")], "i int, data binary, said string")
    found = {r.i: (len(r.media), r.declared_ok) for r in media.sniff_column(blobs, "data", "said").collect()}
    assert found[2] == (0, None) and found[3] == (0, False) and found[1][0] == 1


def test_edit_distance_against_the_table():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert lines.edit_distance(a, b) == row[-1]


def test_line_dedup_against_brute_force(spark, hard, empty):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lines.dedup_lines(df, by="simhash", min_words=5).collect()}
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    occ = [(d, k, " ".join(w)) for d, t in docs for k, x in enumerate(t.split("\n")) if len(w := lines.line_words(x)) >= 5]
    names = sorted({x for _, _, x in occ})
    sims = lines.simhashes([x.split() for x in names]).view(np.uint64)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(sims[:i] ^ sims[i]) <= 3).tolist():
            if lines.edit_distance(names[i], names[j]) <= 0.2 * max(len(names[i]), len(names[j])) + 1e-9:
                root[find(i)] = find(j)
    at = {x: i for i, x in enumerate(names)}
    seen, drop = set(), {}
    for d, k, x in occ:
        if (g := find(at[x])) in seen:
            drop.setdefault(d, set()).add(k)
        seen.add(g)
    for d, t in docs:
        assert got[d].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop.get(d, ()))
    rows = lines.dedup_lines(hard).collect()
    assert len(rows) == len(HARD)
    assert lines.dedup_lines(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.round_trip.all()
    assert (out.groupby(["doc_id", "source"]).size() <= 2).all()
