"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words and of their first letters learns from confirmed toxic texts and from texts of
which nothing is known. With ``prior`` the share of toxic texts, the risk on clean texts is the risk on unlabelled texts taken
as clean, less ``prior`` times that on toxic texts taken as clean. Once it falls below zero the fit has started to learn the
toxic texts by heart, and steps go against it instead (the non-negative correction). A feature is taken for being commoner
in toxic texts, so its weight never falls below zero: what few examples have together can't make one of them count as clean.

The fit sees bounded samples (``FIT_TOXIC``, ``FIT_UNKNOWN``), drawn by hash of the id; all rows are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import crc_mod, least_hashed, slices, written

#: Confirmed toxic rows, rows of unknown kind, and features that a fit takes at most.
FIT_TOXIC, FIT_UNKNOWN, FEATURES = 5_000, 15_000, 4_096
#: A feature must be so much commoner in toxic texts than in unknown ones, and by so many standard errors. Otherwise the many
#: words of a long text would add up.
LIFT, APART = 2.0, 4.0
#: Toxic texts that must have a feature: at least so many, and so often the root of their number, which grows more slowly than
#: chance finds do, so that rarer kinds of toxicity can be learned from more examples.
LEAST, ROOT = 3, 0.35
#: First letters of a word that are features beside the word itself.
STEMS = (4, 5)
_LETTERS = re.compile(r"[^\W\d_]+")


class Words:
    """Features of a text: of each run of letters the run and its stems. Chunks between blanks are remembered, within bounds."""

    def __init__(self, known: dict[str, int] | None = None, most: int = 300_000) -> None:
        self.known, self.most, self.seen = known, most, {}

    def of_chunk(self, chunk: str) -> tuple:
        found = {x for w in _LETTERS.findall(chunk) for x in (f"={w}", *(w[:k] for k in STEMS if len(w) >= k))}
        out = tuple(found) if self.known is None else tuple(self.known[x] for x in found if x in self.known)
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen[chunk] = out
        return out

    def __call__(self, text: str | None) -> set:
        seen, out = self.seen, set()
        for chunk in set((text or "").lower().split()):
            found = seen.get(chunk)
            out.update(self.of_chunk(chunk) if found is None else found)
        return out


def loss_slope(margin: np.ndarray) -> np.ndarray:
    """Slope of log(1 + exp(-margin))."""
    return -1 / (1 + np.exp(np.clip(margin, -30, 30)))


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, size: int, steps: int = 1000, rate: float = 0.05, ridge: float = 1e-5, allowed: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and offset from the feature ids of toxic and unknown rows."""
    weights, offset = np.zeros(size), float(np.log(prior / (1 - prior)))
    ends = np.cumsum([0, *map(len, rows)])
    flat, row = np.concatenate([*rows, np.empty(0, int)]).astype(int), np.repeat(np.arange(len(rows)), np.diff(ends))
    p, u = toxic, ~toxic
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        f = offset + np.bincount(row, weights[flat], len(rows))
        as_clean = np.logaddexp(0, f)
        clean_risk = as_clean[u].sum() / n_u - prior * as_clean[p].sum() / n_p
        slope_toxic = np.where(p, prior / n_p * loss_slope(f), 0.0)
        slope_clean = -loss_slope(-f) * np.where(u, 1 / n_u, -prior / n_p)
        slope = slope_toxic + slope_clean if clean_risk >= -allowed else -slope_clean
        g = np.append(np.bincount(flat, slope[row], size) + ridge * weights, slope.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, offset = np.maximum(weights - move[:-1], 0), offset - move[-1]
    return weights, offset


class Model:
    def __init__(self, known: dict[str, int], weights: np.ndarray, offset: float) -> None:
        self.known, self.weights, self.offset = known, weights.tolist(), offset

    def scorer(self):
        words, weights = Words(self.known), self.weights

        def score(text: str | None) -> float:
            f = self.offset + sum(weights[i] for i in words(text))
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, f))))

        return score


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_unknown: int, seed: int = 3) -> DataFrame:
    """(doc_id, text, toxic): confirmed toxic documents, and documents taken without a look at labels; none is held out. Of
    texts that share an id one is taken, so that rows are as bounded as ids."""
    own = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1)
    toxic, unknown = labels.filter("toxic = 1").filter(own).select("doc_id"), docs.filter(own).select("doc_id")
    toxic = least_hashed(toxic.distinct(), n_toxic, seed, "doc_id")
    unknown = least_hashed(unknown.distinct(), n_unknown, seed, "doc_id")
    ids = toxic.withColumn("toxic", F.lit(True)).unionByName(unknown.withColumn("toxic", F.lit(False)))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # of a bounded number of ids
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_unknown: int = FIT_UNKNOWN, n_features: int = FEATURES, prior: float | None = None) -> Model:
    """``prior``: the share of toxic texts; by default that among the labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(crc_mod("doc_id", 3) != 1).agg(F.avg("toxic")).first()[0]
    prior = min(0.5, max(1e-3, prior or known or 0.0))
    rows = written(sample(docs, labels, n_toxic, n_unknown), "toxic-sample")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, most = Words(), 400_000
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out():
            names = [x for k in seen for x in seen[k]]
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][x] if k == at else 0 for k in seen for x in seen[k]], pa.int64()) for at in (True, False))], names=["feature", "in_toxic", "in_unknown"])
            for c in seen.values():
                c.clear()
            return batch

        for b in slices(batches):
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen[toxic].update(words(text))
                if sum(map(len, seen.values())) > most:
                    yield out()
        yield out()

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    a, b = n.get(True, 0), n.get(False, 0)
    if not a or not b:
        return Model({}, np.zeros(0), -30.0)
    rate_t, rate_u = F.col("t") / a, F.col("u") / b
    both = (F.col("t") + F.col("u")) / (a + b)
    apart = (rate_t - rate_u) / F.sqrt(both * (1 - both) + 1e-9)
    counts = rows.mapInArrow(counted, "feature string, in_toxic long, in_unknown long").groupBy("feature").agg(F.sum("in_toxic").alias("t"), F.sum("in_unknown").alias("u"))
    telling = (F.col("t") >= max(LEAST, ROOT * a**0.5)) & (rate_t >= LIFT * rate_u) & (apart >= APART * (1 / a + 1 / b) ** 0.5)
    best = counts.filter(telling).select("feature", apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(n_features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(index)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([sorted(words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "toxic", "x"])

    found = rows.mapInArrow(indexed, "doc_id long, toxic boolean, x array<long>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    x = [np.array(v, int) for v in found.column("x").to_pylist()]
    return Model(index, *fit(x, np.array(found.column("toxic").to_pylist(), bool), prior, len(index)))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, others) with held_out, score and predicted.

    Null texts are scored as empty ones, and empty texts get a score like any. Repeated rows get equal scores; a null id is
    kept and isn't held out (null). Columns of ``docs`` with the names of the new ones are replaced. Without toxic labels all
    scores are next to 0. An empty table gives an empty result.
    """
    model = learn(docs, labels, **options)
    docs = docs.drop("held_out", "score", "predicted")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for b in slices(batches):
            scores = [one(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    out = docs.mapInArrow(score, type(docs.schema)([*docs.schema.fields]).add("score", "double"))
    return out.withColumn("held_out", crc_mod("doc_id", 3) == 1).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with their columns."""
    columns = docs.columns
    renamed = docs.toDF(*[c if c in ("doc_id", "text") else f"c_{i}" for i, c in enumerate(columns)])
    return scored(renamed, labels).filter("predicted = 0").select(*renamed.columns).toDF(*columns)
