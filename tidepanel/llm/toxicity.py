"""Toxicity: a linear-chain conditional random field tags toxic spans.

Tokens are labelled from the labelled documents: a token of a toxic document is
toxic when one of its features (word, stem) is far commoner in toxic documents
than in others.  The field is then trained on these token sequences;
forward-backward marginals give the spans and, summed up, the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chains import binary_marginals, padded

from tidepanel.llm.common import sliced

TOKENS = re.compile(r"\S+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
BUCKETS = 1 << 18
#: Words whose potentials a worker keeps; when full it starts anew.
KEPT = 500_000
#: Log odds from which a feature marks toxic tokens, and documents that must have it.
MARKED, SUPPORT = 2.5, 3


def token_features(token: str) -> list[str]:
    """The word, and its first 3, 4, 5 and 6 letters."""
    word = EDGES.sub("", token.lower())
    return [f"={word}", *(f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)] if word else []


def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


@dataclass
class ToxicModel:
    """``weights`` by feature bucket, ``bias`` and ``pair`` of the field; ``scale``, ``shift`` turn marginals into a score."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    _kept: dict[str, float] = field(default_factory=dict, repr=False)

    def unary(self, tokens: list[str]) -> np.ndarray:
        if len(self._kept) > KEPT:
            self._kept.clear()
        kept = self._kept
        for token in set(tokens).difference(kept):
            kept[token] = self.bias + sum(float(self.weights[bucket(f)]) for f in token_features(token))
        return np.fromiter(map(kept.__getitem__, tokens), dtype=np.float32, count=len(tokens))

    def marginals(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, probability that each token is toxic) of each text with tokens."""
        chains = [self.unary((t or "").split()) for t in texts]
        for own, lengths, cells in padded(chains):
            found = binary_marginals(cells, lengths, self.pair)
            for i, n, row in zip(own.tolist(), lengths.tolist(), found, strict=True):
                yield i, row[:n]

    def evidence(self, marginal: np.ndarray) -> float:
        """What a document's marginals add up to, in (0, ...): log of one plus the expected toxic tokens."""
        return math.log1p(float(marginal[marginal > 0.05].sum()))

    def score(self, evidence: float) -> float:
        z = self.scale * evidence + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def label_tokens(texts: list[str], toxic: list[int]) -> tuple[list[list[str]], list[np.ndarray]]:
    """Tokens of each text and their labels."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    with1, with0 = Counter(), Counter()
    tokens = [t.split() for t in texts]
    for own, y in zip(tokens, toxic, strict=True):
        (with1 if y else with0).update({f for token in set(own) for f in token_features(token)})
    marked = {
        f for f, a in with1.items()
        if a >= SUPPORT and math.log((a + 0.5) / (n1 + 1)) - math.log((with0[f] + 0.5) / (n0 + 1)) >= MARKED
        and a >= 4 * with0[f]
    }
    known = {token: any(f in marked for f in token_features(token)) for own, y in zip(tokens, toxic, strict=True) if y for token in set(own)}
    labels = [np.array([known[t] for t in own], dtype=bool) if y else np.zeros(len(own), dtype=bool) for own, y in zip(tokens, toxic, strict=True)]
    return tokens, labels


def train(texts: list[str], toxic: list[int], rounds: int = 60, window: int = 40, decay: float = 1e-5) -> ToxicModel:
    """Fits the field on windows around labelled tokens and on windows of clean texts, then the document score.

    Without rows of both labels the score is the share of toxic rows (0.0 for none).
    """
    model = ToxicModel(np.zeros(BUCKETS), -4.0, np.zeros((2, 2)))
    n1, n = sum(toxic), len(toxic)
    if not n1 or n1 == n:
        model.shift, model.scale = (-50.0, 0.0) if not n1 else (50.0, 0.0)
        return model
    tokens, labels = label_tokens(texts, toxic)
    rng = np.random.default_rng(5)
    chains: list[tuple[list[str], np.ndarray]] = []
    for own, y in zip(tokens, labels, strict=True):
        if not own:
            continue
        hits = np.flatnonzero(y)
        starts = hits[:: max(1, len(hits) // 3)][:3] - window // 2 if len(hits) else rng.integers(0, max(1, len(own) - window), 2)
        for s in starts:
            s = max(0, int(s))
            chains.append((own[s : s + window], y[s : s + window]))
    index: dict[int, int] = {}
    rows, cols, states = [], [], []
    cells = sum(len(c) for c, _ in chains)
    at = 0
    memo: dict[str, list[int]] = {}
    for own, y in chains:
        for token, label in zip(own, y.tolist(), strict=True):
            hot = memo.get(token)
            if hot is None:
                hot = memo[token] = [index.setdefault(bucket(f), len(index)) for f in token_features(token)]
            rows.extend([at] * len(hot))
            cols.extend(hot)
            states.append(label)
            at += 1
    rows, cols, truth = np.array(rows), np.array(cols), np.array(states, dtype=float)
    w, bias, pair = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    sw, sb, sp = np.full(len(index), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    ends = np.cumsum([len(c) for c, _ in chains])
    begins = ends - np.array([len(c) for c, _ in chains])
    inside = np.ones(cells, dtype=bool)
    inside[begins] = False
    t = truth.astype(int)
    seen_pairs = np.bincount(2 * t[:-1][inside[1:]] + t[1:][inside[1:]], minlength=4).reshape(2, 2)
    for _ in range(rounds):
        u = np.bincount(rows, weights=w[cols], minlength=cells) + bias
        p, expected = np.empty(cells), np.zeros((2, 2))
        for own, lengths, cell in padded([u[a:b] for a, b in zip(begins, ends, strict=True)]):
            found = binary_marginals(cell, lengths, pair, expected)
            for i, k, row in zip(own.tolist(), lengths.tolist(), found, strict=True):
                p[begins[i] : ends[i]] = row[:k]
        miss = truth - p
        gw = np.bincount(cols, weights=miss[rows], minlength=len(index)) / cells - decay * w
        gb, gp = miss.sum() / cells, (seen_pairs - expected) / cells
        sw += gw * gw
        sb += gb * gb
        sp += gp * gp
        w += 0.5 * gw / np.sqrt(sw)
        bias += 0.3 * gb / math.sqrt(sb)
        pair += 0.05 * gp / np.sqrt(sp)
    for place, i in index.items():
        model.weights[place] = w[i]
    model.bias, model.pair = bias, pair
    evidence = np.zeros(n)
    for i, m in model.marginals(texts):
        evidence[i] = model.evidence(m)
    y = np.array(toxic, dtype=float)
    scale, shift = 1.0, 0.0
    for _ in range(200):  # Newton's method for the logistic document score
        q = 1 / (1 + np.exp(-np.clip(scale * evidence + shift, -50, 50)))
        v = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((y - q) * evidence).sum() - 0.01 * scale, (y - q).sum() - 0.01 * shift])
        h = np.array([[(v * evidence**2).sum() + 0.01, (v * evidence).sum()], [(v * evidence).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        scale, shift = scale + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.scale, model.shift = float(scale), float(shift)
    model._kept.clear()  # each task gets the model, not what training has looked up
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = 6000) -> ToxicModel:
    """Trains on at most about ``rows`` labelled rows, half of them toxic if there are so many.

    Rows are chosen by a hash of the id; a NULL label or text is no labelled row.
    The field is trained on windows of these texts (three around toxic tokens,
    two elsewhere), the document score on whole texts.
    """
    marked = labels.where(F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(toxic).alias("_y"))
    count = {bool(r["_y"]): r["n"] for r in marked.groupBy(F.col("_y") > 0).agg(F.count(F.lit(1)).alias("n")).toDF("_y", "n").collect()}
    ones = min(count.get(True, 0), rows // 2)
    share = {True: ones / max(1, count.get(True, 0)), False: (rows - ones) / max(1, count.get(False, 0))}
    dice = F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(1_000_000)) / F.lit(1e6)
    picked = marked.where(dice < F.when(F.col("_y") > 0, share[True]).otherwise(share[False]))
    # a bounded set of ids: its size is at most about ``rows``
    got = docs.select(doc_id, text).join(F.broadcast(picked), doc_id).where(F.col(text).isNotNull()).toArrow().to_pydict()
    own = sorted(zip(got[doc_id], got[text], got["_y"], strict=True))
    return train([t for _, t, _ in own], [int(y > 0) for _, _, y in own])


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): score in 0..1 and the offending spans.

    A span is a run of tokens of marginal ``at`` or more, as offsets in code
    points.  NULL and empty texts get the score of a text without evidence.
    Whole texts of any length are read; repeated rows get equal results, an
    empty table gives none, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        none = model.score(0.0)
        for batch in sliced(batches, text):
            texts = batch.column(1).to_pylist()
            scores, spans = [none] * len(texts), [[] for _ in texts]
            for i, m in model.marginals(texts):
                scores[i] = model.score(model.evidence(m))
                if (hit := m >= at).any():
                    places = [x.span() for x in TOKENS.finditer(texts[i])]
                    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()
                    spans[i] = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")
