"""Pages with ordinary classes, stray quotes, unclosed elements; other hard inputs of the operators."""

import struct
import time

import numpy as np
import pytest

from tidepanel.llm import chains, html_text, language, media, mixing, neighbours

BODY = "".join(f"<p>Some ordinary sentence number {i} that belongs to the text of the article itself.</p>" for i in range(4))


@pytest.fixture(scope="module")
def text():
    return html_text.Extractor().text


@pytest.mark.parametrize("page", [
    '<body class="single has-sidebar"><article>{}</article></body>', '<body class="post comments-open"><article>{}</article></body>',
    '<body><div class="page no-sidebar"><article>{}</article></div></body>', '<body class="sidebar"><div class="wrapper comments"><main>{}</main></div></body>',
    "<body><article>{}</article></body>", '<body><article><div class="search-results">{}</div></article></body>',
])
def test_classes_of_what_holds_the_article(text, page):
    got = text(page.format(BODY))
    assert got.count("belongs to the text") == 4 and "<" not in got


def test_boxes_stay_out(text):
    page = f'<body><div class="sidebar"><p>Buy this now.</p></div><article>{BODY}</article><div class="comments"><p>First!</p></div></body>'
    assert text(page) == text(f"<article>{BODY}</article>")


def test_stray_quotes_and_offsets(text):
    assert text(f"<article>{BODY}<p data-x=it's>A word here</p><p>I don't B either</p></article>").endswith("A word here\n\nI don't B either")
    assert text(f'<article>{BODY}<p>before <img alt="5" tall"> after it</p></article>').endswith("before after it")
    assert text(f"<article>{BODY}<p>İİİİİİ</p><script>x</script><p>behind the script</p></article>").endswith("behind the script")
    assert text(f"<article>{BODY}<svg><svg></svg><text>no</text></svg><p>1 < 2 and a<b</p></article>").endswith("1 < 2 and a")
    assert text(f"<article>{BODY}<title>rest of it<p>still here</p></article>").endswith("still here")


@pytest.mark.parametrize("piece", ["<a '", "<a b='", '<a "', "<title>", "<svg>", "<!-", "</ ", "<div ", "<"])
def test_time_is_linear(piece):
    began = time.process_time()
    html_text.Page(piece * 100_000)
    assert time.process_time() - began < 10


def test_hundreds_of_languages():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(6, 4, 300))
    lengths = np.array([6, 6, 5, 2])
    paths = chains.viterbi(lambda t, k: scores[t, :k], lengths, 300, 0.5)
    assert all(0 <= int(x) < 300 for p, n in zip(paths, lengths, strict=True) for x in p[:n])


def test_viterbi_against_every_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        scores, penalty = rng.normal(size=(5, 1, 3)), float(rng.random() * 2)
        path = [int(x) for x in next(iter(chains.viterbi(lambda t, k, s=scores: s[t, :k], np.array([5]), 3, penalty)))[:5]]

        def worth(p, s=scores, c=penalty):
            return sum(s[t, 0, x] for t, x in enumerate(p)) - c * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(worth(p) for p in np.ndindex(3, 3, 3, 3, 3))
        assert abs(worth(path) - best) < 1e-9


def test_rows_to_train_on_are_bounded(spark):
    df = spark.createDataFrame([("one and the same text", "en")] * 3000 + [("ein anderer Text", "de")], "text string, lang string")
    seen = []
    real = language.train
    language.train = lambda texts, names, *a: seen.append(len(texts)) or real(texts, names, *a)
    try:
        language.fit(df, rows=100)
    finally:
        language.train = real
    assert seen[0] <= 100


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    for scale in (1e150, 1e-150):
        df = spark.createDataFrame([(i, [x * scale for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, k=5, shard=16).collect())
        want = []
        for q in (0, 20, 40):
            best = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in rows if i != q)[:5]
            want += [(q, k, i) for k, (_, i) in enumerate(best, 1)]
        assert got == want


def test_boxes_of_all_lengths():
    def box(kind, body, size=None):
        return struct.pack(">I4s", 8 + len(body) if size is None else size, kind) + body

    ftyp, moov = box(b"ftyp", b"isom" + bytes(4)), box(b"moov", bytes(16))
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 40) + bytes(40)
    for blob in (ftyp + wide + moov, ftyp + moov + box(b"mdat", bytes(30), 0)):
        assert media.sniff(blob)[0] == ("video/mp4", 0, len(blob))


def test_clashing_columns(spark):
    rows = [(i, f"a b c {i}", "s", 7, 8, 9, 10, 11, 12) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, whole int, cut int, key int, h int, row int, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 12 and {(r.whole, r["cut"], r.key, r.h, r["row"], r["size"]) for r in got} == {(7, 8, 9, 10, 11, 4)}
    blobs = spark.createDataFrame([(media.wrap(bytes(64))[1], "text/plain")], "media binary, said string")
    with pytest.raises(ValueError, match="media"):
        media.sniff_column(blobs, "media", "said")
    row = media.sniff_column(blobs, "media", "said", types="found").collect()[0]
    assert row.declared_ok is False and row.corrected == row.found[0].type
