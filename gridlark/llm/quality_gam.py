"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree a round to one feature's histogram of gradients, feature after feature, and adds its
leaves to that feature's lookup table; afterwards the pairs that would lower the loss most get tables over two features in
the same way. A score is the sum of one entry of each table, found by binning, so scoring is a few array additions a batch.

The fit sees a bounded sample of labelled rows (``FIT_ROWS``), drawn by hash of the id; all rows are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import crc_mod, least_hashed, slices

#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000
NAMES = ("words", "word_length", "capitals", "marked_ends", "symbols", "digits", "distinct", "top_word", "pairs", "lines", "repeated_lines", "line_words", "bare_marks", "short_words", "beyond_ascii", "characters")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = b"0123456789"
_BLANK = b" \t\n\x0b\f\r"
_PLAIN = _LETTERS + _DIGITS + _BLANK + bytes(range(128, 256)) + b".,;:'\"?-()"


def features(text: str | None) -> list[float]:
    """Shape of a text: rates of words, signs and repetition, none of them of its source or language."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda kept: 1 - len(raw.translate(None, kept)) / size
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(1 for w in words if w[-1] in "!#$%&*|<>{}[]^~=+_/\\@") / n,
        1 - share(_PLAIN) if raw else 0.0,
        share(_DIGITS),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
        sum(1 for w in words if len(w) <= 3) / n,
        share(bytes(range(128, 256))),
        len(set(text)) / min(size, 60),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables of features, and tables of pairs of them over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    start: float
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges of about equally full bins."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def gain(g, h, ridge):
    return g * g / (h + ridge)


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0: none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gains = gain(left_g, left_h, ridge) + gain(g.sum() - left_g, h.sum() - left_h, ridge) - gain(g.sum(), h.sum(), ridge)
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values over the bins of a tree of at most ``depth`` levels."""
    won, at = best_cut(g, h, ridge) if depth else (0.0, 0)
    if won <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([tree(g[:at], h[:at], depth - 1, ridge), tree(g[at:], h[at:], depth - 1, ridge)])


def tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values over a 2-d histogram: one cut of a feature, and one of the other on either side."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            parts = [(a[:at].sum(0), b[:at].sum(0)), (a[at:].sum(0), b[at:].sum(0))]
            won = sum(best_cut(*p, ridge)[0] + gain(p[0].sum(), p[1].sum(), ridge) for p in parts) - gain(a.sum(), b.sum(), ridge)
            if won > best[0]:
                low, high = (tree(*p, 1, ridge) for p in parts)
                out = np.vstack([np.tile(low, (at, 1)), np.tile(high, (len(a) - at, 1))])
                best = (won, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 48, coarse: int = 8, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Fit to rows ``x`` with labels 0 and 1. Without rows of both labels every score is the (smoothed) share of 1."""
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges = [cuts(x[:, k], bins) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], start)
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, values in enumerate(model.tables):
            g, h = slopes()
            step = rate * tree(np.bincount(at[k], g, len(values)), np.bincount(at[k], h, len(values)), 2, ridge)
            values += step
            total += step[at[k]]
    model.coarse = [cuts(x[:, k], coarse) for k in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]

    def histogram(i, j, values):
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(fine[i] * shape[1] + fine[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((tree2(histogram(i, j, g), histogram(i, j, h), ridge)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for won, i, j in ranked[:n_pairs] if won > 0}
    for _ in range(pair_rounds):
        for (i, j), values in model.pairs.items():
            g, h = slopes()
            step = rate * tree2(histogram(i, j, g), histogram(i, j, h), ridge)[1]
            values += step
            total += step[fine[i], fine[j]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, rows: int, seed: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents whose id isn't held out, the same ones on every run. Of texts
    that share an id one is taken, so that rows are as bounded as ids."""
    ids = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).filter(crc_mod("doc_id", modulus) != held)
    ids = least_hashed(ids.groupBy("doc_id").agg(F.max(column).alias("label")), rows, seed, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # of a bounded number of ids
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    found = labelled(docs, labels, "quality", 5, 0, rows).mapInArrow(measured, "doc_id long, x array<double>, y int").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(found.column("y").to_pylist(), float))


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Null texts are scored as empty ones, and empty texts get a score like any. Repeated rows get equal scores; a null id is
    kept and isn't held out (null). Columns of ``docs`` with the names of the new ones are replaced. Without usable labels all
    scores are 0.5. An empty table gives an empty result.
    """
    model = learn(docs, labels, rows)
    docs = docs.drop("held_out", "score", "predicted")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, "score"])

    out = docs.mapInArrow(score, type(docs.schema)([*docs.schema.fields]).add("score", "double"))
    return out.withColumn("held_out", crc_mod("doc_id", 5) == 0).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their columns."""
    columns = docs.columns
    renamed = docs.toDF(*[c if c in ("doc_id", "text") else f"c_{i}" for i, c in enumerate(columns)])
    return scored(renamed, labels).filter("predicted = 1").select(*renamed.columns).toDF(*columns)
