"""Language identification of spans: script ranges narrow the candidates, Viterbi labels the words.

A word's score for a language is the log likelihood of its character n-grams
there.  Along a text, changing the language costs a penalty, so that a span
needs several words against its surroundings.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chains import padded, viterbi

from tidepanel.llm.common import sliced

# --- fixed values: first and last code points of script blocks
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
]
# ---
LETTERS = regex.compile(r"\p{L}+")
BUCKETS = 1 << 17
#: Documents whose distinct words are scored together.
TOGETHER = 2000


def script_of(letter: str) -> str:
    point = ord(letter)
    return next((name for name, low, high in SCRIPTS if low <= point <= high), "other")


def gram_sums(words: list[str], table: np.ndarray | None = None, counts: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray | None:
    """Over the character 1- to 4-grams of each word with its ends marked: the mean rows of ``table``.

    With ``counts`` (buckets) and ``weights`` (words) the grams are counted instead.
    """
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    out = np.zeros((len(words), table.shape[1])) if table is not None else None
    total = np.zeros(len(words))
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 5):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        own = word[: len(h)] == word[n - 1 :]
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        places, of = (mixed[own] >> np.uint64(47)).astype(np.int64) % BUCKETS, word[: len(h)][own]
        if counts is not None:
            counts += np.bincount(places, weights=weights[of], minlength=BUCKETS)
        else:
            for k in range(table.shape[1]):
                out[:, k] += np.bincount(of, weights=table[places, k], minlength=len(words))
            total += np.bincount(of, minlength=len(words))
    return out / np.maximum(total, 1)[:, None] if out is not None else None


@dataclass
class LanguageModel:
    """``table`` (buckets x languages): log probability of a gram; ``scripts``: languages by script."""

    languages: list[str]
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    penalty: float = 6.0

    def word_scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, number of letters) of white-space tokens; zero scores without letters."""
        parts = [LETTERS.findall(t.lower()) for t in tokens]
        letters = np.array([sum(map(len, p)) for p in parts], dtype=np.int64)
        out = np.zeros((len(tokens), len(self.languages)))
        some = np.flatnonzero(letters)
        if len(some):
            words = [" ".join(parts[i]) for i in some.tolist()]
            out[some] = gram_sums(words, self.table) * (np.minimum(letters[some], 12) / 2)[:, None]
            barred = {s: ~k for s, k in self.scripts.items() if k.any() and not k.all()}
            if barred:
                for i, w in zip(some.tolist(), words, strict=True):
                    if (no := barred.get(script_of(w[0]))) is not None:
                        out[i, no] -= 50.0
        return out, letters

    def spans(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """(place, tokens, state of each token, letters of each token) of each text that has tokens."""
        for start in range(0, len(texts), TOGETHER):
            tokens_of = [(t or "").split() for t in texts[start : start + TOGETHER]]
            place = {t: i for i, t in enumerate(dict.fromkeys(t for own in tokens_of for t in own))}
            ids = [np.fromiter(map(place.__getitem__, own), dtype=np.int32, count=len(own)) for own in tokens_of]
            matrix, count = self.word_scores(list(place))
            for own, lengths, cells in padded(ids):
                cells = cells.T.copy()
                paths = viterbi(lambda t, k, cells=cells: matrix[cells[t, :k]], lengths, len(self.languages), self.penalty)
                for i, n, path in zip(own.tolist(), lengths.tolist(), paths, strict=True):
                    yield start + i, tokens_of[i], path[:n], count[ids[i]]


def train(texts: list[str], languages: list[str], penalty: float = 6.0) -> LanguageModel:
    """Smoothed gram counts of labelled texts; a script belongs to a language with 1 % of its letters."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), {}, penalty)
    counts = np.zeros((BUCKETS, len(names)))
    scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    for k, name in enumerate(names):
        words = Counter(w for t, own in zip(texts, languages, strict=True) if own == name for w in LETTERS.findall(t.lower()))
        if words:
            gram_sums(list(words), counts=(own := np.zeros(BUCKETS)), weights=np.minimum(list(words.values()), 50).astype(float))
            counts[:, k] = own
        for w, n in words.items():
            scripts[script_of(w[0])][k] += n * len(w)
    table = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    total = sum(scripts.values())
    return LanguageModel(names, table.astype(np.float32), {s: c >= 0.01 * np.maximum(total, 1) for s, c in scripts.items()}, penalty)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = 6000, seed: int = 1) -> LanguageModel:
    """Trains on at most ``rows`` labelled rows, those of the least hash of the text.

    A word counts up to 50 times for a language, and a word's weight grows with
    its letters up to 12.  NULL texts and languages are no labelled rows.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    total = labelled.select("l").count()
    if total > rows:
        dice = F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(1_000_000))
        some = labelled.where(dice < int(1_100_000 * rows / total) + 1)
        labelled = some.orderBy(dice, "t", "l").limit(rows)  # copies of one text have one hash
    got = labelled.toArrow().to_pydict()
    pairs = sorted(zip(got["l"], got["t"], strict=True))
    return train([t for _, t in pairs], [str(k) for k, _ in pairs])


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language with most letters, its share, and the spans.

    A span is (first word, words, language).  Texts that are NULL or have no
    letter are ``und`` with score 1 and no spans, as are all without a trained
    language.  Ties go to the first language by name.  Whole texts of any
    length are read; repeated rows get equal results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for batch in sliced(batches, text):
            n = batch.num_rows
            name, score, spans = ["und"] * n, [1.0] * n, [[] for _ in range(n)]
            if model.languages:
                for i, _, path, letters in model.spans(batch.column(1).to_pylist()):
                    share = np.bincount(path, weights=letters, minlength=len(model.languages))
                    if share.sum() > 0:
                        best = int(share.argmax())
                        name[i], score[i] = model.languages[best], float(share[best] / share.sum())
                        cuts = np.flatnonzero(np.diff(path, prepend=-1)).tolist()
                        ends = [*cuts[1:], len(path)]
                        spans[i] = [{"first": a, "words": b - a, "lang": model.languages[path[a]]} for a, b in zip(cuts, ends, strict=True)]
            arrays = [batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"
    return docs.select(doc_id, text).mapInArrow(run, schema)
