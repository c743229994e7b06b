"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins; cyclic boosting visits the features in turn and adds a shallow tree of
that feature alone to its table. Then pairs of features whose quadrants explain most of what is left get two-way tables
by the same cycle. A score is the sum of the entries that a row's bins select, so scoring is a few vectorised gathers.

Features come from the whole text. Defined results: null text counts as empty; empty texts are scored as any other;
labels that are null are not learned from; without labels, or with labels of one kind only, the tables are empty and
the score is the share of that kind (0.5 without any); rows that repeat a doc_id are scored each, and one text of them
(the least) is learned from; kept columns stay as they are, one called ``score`` too: the score is ``quality_score``
then; a long text is read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import tidy, unused
from .tokens import arrow_texts

#: Most labelled rows to learn from; beyond it a hash of the doc_id chooses.
SAMPLE_ROWS = 20_000

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "mark_share", "pipe_share", "high_share", "space_share",
    "distinct_share", "repeat_share", "top_word_share", "log_lines", "repeated_line_share", "line_words", "point_share", "end_share",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1  # capitals
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~|"]] = 3
_CLASS[[ord(c) for c in "!?\"'();:-"]] = 4
_CLASS[128:] = 5
_CLASS[[32, *range(9, 14)]] = 6
_CLASS[[ord("."), ord(",")]] = 7


def text_features(text: bytes) -> tuple[float, ...]:
    """The features of one text, in the order of NAMES."""
    n = len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / max(1, n)
    words = text.split()
    count = len(words)
    some = max(1, count)
    seen = Counter(words)
    same = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_count = max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return (
        np.log1p(n), np.log1p(count), (n - count) / some, kinds[1], kinds[2], kinds[3], kinds[4], text.count(b"|") / some, kinds[5], kinds[6],
        len(seen) / some, same / some, max(seen.values(), default=0) / some, np.log1p(len(lines)), 1 - len(set(lines)) / line_count, count / line_count, kinds[7], ends / line_count,
    )


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and an array of the text's features."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t) for t in arrow_texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], names=[*keep, "features"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, features array<double>")


@dataclass
class AdditiveModel:
    """Bin edges of the features, a table for each of them, and tables for pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.single):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with at most so many leaves, grown at the best split of any leaf."""
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(spans):
            g, w = np.cumsum(grad[a:b]), np.cumsum(weight[a:b])
            if b - a > 1:
                gain = g[:-1] ** 2 / (w[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + ridge) - g[-1] ** 2 / (w[-1] + ridge)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, a + at + 1)
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = grad[a:b].sum() / (weight[a:b].sum() + ridge)
    return out


def _quadrants(grad: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either side of a two-way histogram."""
    g, w = grad.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def parts(t: np.ndarray) -> list[np.ndarray]:
        a = t[:-1, :-1]
        return [a, t[:-1, -1:] - a, t[-1:, :-1] - a, t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + a]

    if min(grad.shape) < 2:
        return 0.0, np.zeros_like(grad)
    gp, wp = parts(g), parts(w)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gp, wp, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[i, j] / (y[i, j] + ridge) for x, y in zip(gp, wp, strict=True)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 80, rate: float = 0.15, leaves: int = 4, pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Learn the tables by cyclic boosting of the logistic loss."""
    if not len(y):
        return AdditiveModel()
    share = float(np.clip(y.mean(), 0.02, 0.98))
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(n) for n in sizes]
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, n in enumerate(sizes):
            grad, weight = slopes()
            step = rate * _tree(np.bincount(b[:, k], grad, n), np.bincount(b[:, k], weight, n), leaves, ridge)
            model.single[k] += step
            raw += step[b[:, k]]
    grad, weight = slopes()
    cell = lambda i, j, v: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda ij: -_quadrants(cell(*ij, grad), cell(*ij, weight), ridge)[0])[:pairs]
    tables = {ij: np.zeros((sizes[ij[0]], sizes[ij[1]])) for ij in ranked}
    for _ in range(rounds // 2):
        for i, j in ranked:
            grad, weight = slopes()
            step = rate * _quadrants(cell(i, j, grad), cell(i, j, weight), ridge)[1]
            tables[i, j] += step
            raw += step[b[:, i], b[:, j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text has the remainder 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 5, target: str = "quality") -> AdditiveModel:
    """Fit on labelled documents outside the held-out third, on a hash sample of ``sample_rows`` of them at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("_label")).filter("doc_id IS NOT NULL AND _label IN (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # two numbers a row, of sample_rows rows at most
    joined = joined.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))  # sample_rows rows, whatever repeats
    rows = with_features(joined, ["doc_id", "_label"]).select("doc_id", "_label", "features").toPandas().sort_values(["doc_id", "_label"], kind="stable")
    if not len(rows):
        return AdditiveModel()
    return fit(np.array(rows["features"].tolist()), rows["_label"].to_numpy().astype(float))


def score_name(keep: list[str]) -> str:
    """The name of the score beside these columns."""
    return unused("score", keep, "quality_")


def score(docs: DataFrame, model: AdditiveModel, keep: list[str]) -> DataFrame:
    """The kept columns and the score (see :func:`score_name`): the probability that the label is 1."""
    own = score_name(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in keep)).schema)
    columns = keep if "text" in keep else [*keep, "text"]
    at = columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in arrow_texts(batch.column(at))], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(x), pa.float64())], names=[*keep, own])

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, f"{kinds}, `{own}` double" if kinds else f"`{own}` double")
