"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Both views are additive logistic models over quantile bins.  In each round a
view hands its most confident predictions on unlabelled documents to the other
as labels.  Each view is then calibrated, and the two combined, on labelled
rows that neither was fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.llm.common import sliced

#: Groups of bytes whose shares are features of a text.
_CLASS = np.full(256, 7, dtype=np.int64)
for _members, _k in ((b" \t\n\r\x0b\x0c", 0), (bytes(range(65, 91)), 1), (bytes(range(97, 123)), 2), (b"0123456789", 3), (b".,;:'\"-()?", 4), (b"!", 5), (bytes(range(128, 256)), 6)):
    for _b in _members:
        _CLASS[_b] = _k
BINS, HASHED = 12, 64


def text_features(text: str | None) -> list[float]:
    """Shares of character classes, word and line statistics of a whole text; zeros for NULL or empty."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 20
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=8) / len(raw)
    symbols = counts.copy()
    symbols[_CLASS != 7] = 0
    n = len(words)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = counts[46] + counts[33] + counts[63]
    letters = shares[1] + shares[2] + shares[6]
    return [
        *shares.tolist(), float(symbols.max() / len(raw)), len(seen) / n, seen.most_common(1)[0][1] / n, float(lengths.mean()),
        float(lengths.std()), float(lengths.max()), len(set(lines)) / len(lines), n / max(1, int(ends)), n / len(lines),
        float(shares[1] / letters) if letters else 0.0, float(np.log1p(n)), sum(c for c in seen.values() if c > 1) / n,
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Buckets of source, language and both, and the length that the page's record declares."""
    def dealt(*x: str | None) -> float:
        return float(xxhash.xxh3_64_intdigest("\0".join("~" if v is None else v for v in x)) % HASHED)

    return [dealt("s", source), dealt("l", lang), float(np.log1p(max(0, n_chars or 0)))]


@dataclass
class View:
    """An additive logistic model; ``edges`` are bin borders by feature, None for hashed buckets."""

    edges: list[np.ndarray | None]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def over(cls, x: np.ndarray, hashed: frozenset[int] = frozenset()) -> View:
        edges = [None if j in hashed else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        sizes = [HASHED if e is None else len(e) + 1 for e in edges]
        return cls(edges, np.zeros(1 + sum(sizes)), 1 + np.cumsum([0, *sizes[:-1]]))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, j].astype(np.int64) if e is None else np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) + self.starts

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[self.cells(x)].sum(axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> None:
        cells, n, d = self.cells(x), len(x), x.shape[1]
        w, g2 = np.zeros_like(self.weights), np.full_like(self.weights, 1e-8)
        for _ in range(rounds):
            miss = y - 1 / (1 + np.exp(-np.clip(w[0] + w[cells].sum(axis=1), -40, 40)))
            g = np.bincount(cells.ravel(), weights=np.repeat(miss, d), minlength=len(w)) / n - decay * w
            g[0] = miss.mean()
            g2 += g * g
            w += 0.5 * g / np.sqrt(g2)
        self.weights = w


def _platt(z: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of y on the columns of z and a constant."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ a + decay * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - q) - decay * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    """Both views and the combination; ``constant`` replaces them when the labels are of one kind."""

    text: View | None = None
    meta: View | None = None
    calibrations: tuple[np.ndarray, np.ndarray] = (np.zeros(2), np.zeros(2))
    blend: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float = 0.5

    def _calibrated(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        views = ((self.text, xt, self.calibrations[0]), (self.meta, xm, self.calibrations[1]))
        return np.column_stack([np.clip(v.logit(x), -30, 30) * c[0] + c[1] for v, x, c in views])

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        if self.text is None or self.meta is None:
            return np.full(len(xt), self.constant)
        z = self._calibrated(xt, xm) @ self.blend[:2] + self.blend[2]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, rounds: int = 4, share: float = 0.05) -> QualityModel:
    """Fits on labelled rows (xt, xm, y) and an unlabelled pool (ut, um); the last fifth of the labelled rows calibrates."""
    if len(y) < 20 or y.min() == y.max():
        return QualityModel(constant=float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 5 == 4
    views = [View.over(np.concatenate([xt, ut])), View.over(np.concatenate([xm, um]), frozenset((0, 1)))]
    base, pool = (xt, xm), (ut, um)
    given: list[dict[int, float]] = [{}, {}]
    prior = float(y[~held].mean())
    for step in range(rounds + 1):
        for k, view in enumerate(views):
            extra = np.array(sorted(given[k]), dtype=np.int64)
            x = np.concatenate([base[k][~held], pool[k][extra]]) if len(extra) else base[k][~held]
            view.fit(x, np.concatenate([y[~held], [given[k][i] for i in extra.tolist()]]))
        if step == rounds or not len(ut):
            break
        for k, view in enumerate(views):
            z = view.logit(pool[k])
            sure = np.abs(z) > 2.2  # 0.9 either way
            order = np.argsort(z, kind="stable")
            low, high = order[: max(1, int(share * (1 - prior) * len(z)))], order[::-1][: max(1, int(share * prior * len(z)))]
            for i in (*low.tolist(), *high.tolist()):
                if sure[i]:
                    given[1 - k].setdefault(i, float(z[i] > 0))
    model = QualityModel(views[0], views[1])
    yh = y[held]
    model.calibrations = tuple(_platt(np.clip(v.logit(b[held]), -30, 30)[:, None], yh) for v, b in zip(views, base, strict=True))
    model.blend = _platt(model._calibrated(xt[held], xm[held]), yh)
    return model


def featurize(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", model: QualityModel | None = None) -> DataFrame:
    """``docs`` plus ``quality_score``, or, without a model, plus the features ``xt`` and ``xm`` in place of the text."""
    kept = docs.drop("quality_score") if model else docs
    names = [c for c in kept.columns if model or c != text]
    extra = "quality_score double" if model else "xt array<double>, xm array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            xt = [text_features(x.as_py()) for x in batch.column(text)]
            columns = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in (source, lang, n_chars)]
            xm = [meta_features(*x) for x in zip(*columns, strict=True)]
            if model:
                scores = model.score(np.array(xt).reshape(len(xt), -1), np.array(xm).reshape(len(xm), -1)) if xt else np.zeros(0)
                out = [pa.array(scores, pa.float64())]
            else:
                out = [pa.array(xt, pa.list_(pa.float64())), pa.array(xm, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], names=[*names, *extra.replace(",", "").split()[::2]])

    return kept.mapInArrow(run, StructType([kept.schema[c] for c in names] + StructType.fromDDL(extra).fields))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", rows: int = 8000, pool: int = 8000) -> QualityModel:
    """Trains on at most about ``rows`` labelled rows and ``pool`` others, chosen by a hash of the id.

    Only features leave the executors.  NULL labels are no labels; of several
    labels of one id the least counts.
    """
    marked = labels.where(F.col(quality).isNotNull()).groupBy(doc_id).agg(F.min(quality).alias("_y"))
    dice = F.pmod(F.xxhash64(F.lit(23), doc_id), F.lit(1_000_000)) / F.lit(1e6)
    # a bounded set of ids: its size is at most about ``rows``
    picked = F.broadcast(marked.where(dice < rows / max(1, marked.count())))
    columns = [c for c in (doc_id, "text", "source", "lang", "n_chars") if c in docs.columns]
    got = featurize(docs.select(*columns).join(picked, doc_id)).select(doc_id, "_y", "xt", "xm").toArrow().to_pydict()
    spare = F.pmod(F.xxhash64(F.lit(29), doc_id), F.lit(1_000_000)) / F.lit(1e6) < pool / max(1, docs.count())
    free = featurize(docs.select(*columns).where(spare)).select(doc_id, "xt", "xm").toArrow().to_pydict()

    def arrays(x: dict, by: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x["xt"][i] for i in by]).reshape(len(by), 20), np.array([x["xm"][i] for i in by]).reshape(len(by), 3)

    by = sorted(range(len(got[doc_id])), key=lambda i: (xxhash.xxh3_64_intdigest(str(got[doc_id][i])), got["xt"][i]))
    known = set(got[doc_id])
    other = sorted((i for i in range(len(free[doc_id])) if free[doc_id][i] not in known), key=lambda i: (str(free[doc_id][i]), free["xt"][i]))
    xt, xm = arrays(got, by)
    ut, um = arrays(free, other)
    return co_train(xt, xm, np.array([float(got["_y"][i] > 0) for i in by]), ut, um)


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` plus ``quality_score`` in 0..1, higher for better texts.

    Texts that are NULL or empty have the features zero; repeated rows get
    equal scores; a column of that name is replaced.
    """
    return featurize(docs, model=model)
