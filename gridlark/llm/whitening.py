"""Embedding whitening: principal components of the distinct vectors, by MLlib's Gramian over exactly centred rows.

Entries are scaled to integers, so counts and sums are exact, and so is ``n * x - S``: a large common offset costs no digit. A
row centred that way is rounded once, when it is divided by ``n``. The Gramian of these rows over ``n`` is the covariance; its
eigenvectors are found on the driver (a matrix of the dimension, whatever the rows) and sent to the tasks, which whiten.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import written

#: Scale and offset of the integer entries, and the components that are returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Integer entries without the offset are within -BOUND and BOUND: beyond, doubles couldn't tell them apart anyway.
BOUND = 1 << 53
#: Components of less variance than this share of the largest one's are rounding: they can't be whitened.
LEAST = 1e-12
#: Rows that a task whitens at a time.
ROWS = 4096


def integers(vector: Column) -> Column:
    """floor(SCALE * c) + OFFSET of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))) + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Has a value in each entry, none of them infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def gramian(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """The sum of the outer products of an array column's rows, added up in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, numCols=d).computeGramianMatrix().toArray()


class Whitening:
    """Counts, sums and components of a fit list."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int = COMPONENTS) -> None:
        self.n = n
        #: n * x - S = n * (x - whole) - rest, with rest in [0, n): small numbers, however large x is
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = min(most, int((values > LEAST * max(values[0], 0)).sum())) if len(values) else 0
        self.trace = float(np.trace(covariance))
        self.values = values[:kept]
        self.project = vectors[:, :kept] / np.sqrt(values[:kept])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - S) squared; None where one is beyond a long."""
        near = x - self.whole
        if float(np.abs(near).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return (((self.n * near - self.rest) ** 2).sum(axis=1)).tolist()
        exact = (((self.n * near.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def prepared(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with the integer entries in ``x``; rows that can't be used go, as do those of another length than the
    commonest (of equally common ones the longer)."""
    rows = vectors.filter(usable(F.col(f"`{vector}`"))).withColumn("x", integers(F.col(f"`{vector}`")))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.filter(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def fitted(x: DataFrame, most: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of the distinct rows of ``x`` (x), and its identity error; None without rows.

    The error is the largest absolute entry of the whitened distinct rows' covariance minus the identity, measured over all
    of them.
    """
    fit = written(x.select("x").distinct(), "whitening-fit")
    head = fit.head(1)
    if not head:
        return None, None
    d = len(head[0]["x"])
    n, *sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d)]).first()
    sums = [int(s) for s in sums]
    whole, rest = F.lit([s // n for s in sums]).cast("array<bigint>"), F.lit([(s % n) / n for s in sums]).cast("array<double>")
    centred = F.zip_with(F.zip_with("x", whole, lambda a, b: a - b), rest, lambda a, b: a - b)
    model = Whitening(n, sums, gramian(fit.select(centred.alias("x")), "x", d) / n if d else np.zeros((0, 0)), most)
    k = len(model.values)
    if not k:
        return model, 0.0
    white = applied(fit.select(F.lit(None).cast("string").alias("id"), "x"), model)
    means = np.array(white.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first(), float)
    level = F.lit(means.tolist()).cast("array<double>")
    covariance = gramian(white.select(F.zip_with("w", level, lambda a, b: a - b).alias("w")), "w", k) / n
    return model, float(np.abs(covariance - np.eye(k)).max())


def applied(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w) of ``rows`` (id, x), both as they come; ``w``: the whitened vector."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # as large as the dimension times the components

    def whiten(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = sent.value
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                part = frame.iloc[start : start + ROWS]
                x = np.stack(part["x"].to_list())
                yield pd.DataFrame({"id": part["id"].to_numpy(), "deviation": pd.array(made.deviations(x), dtype="Int64"), "w": list(made.whitened(x))})

    return rows.select("id", "x").mapInPandas(whiten, "id string, deviation long, w array<double>")


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``vectors`` and each component: ``key``, component, n, deviation, whitened, explained,
    identity_error.

    Vectors that are null or have a null, infinite or undefined entry go. Keys may be null and may be repeated: each row comes
    out with its own key. Equal vectors count once for n and the covariance, and come out as often as they are. Entries beyond
    ``BOUND / SCALE`` count as that. Components are numbered by falling variance; those without variance (at most ``LEAST`` of
    the largest one's) can't be whitened and are left out, so a table of one distinct vector gives no rows. A deviation
    beyond a long is null. Vectors of another length than the commonest go. An empty table gives an empty result. Other
    columns are left aside, whatever their names.
    """
    rows = prepared(vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v")
    kind = dict(rows.dtypes)["id"]
    model, error = fitted(rows, most)
    names = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], names)
    shares = F.lit((model.values / model.trace).tolist())
    out = applied(rows.select(F.col("id").cast("string").alias("id"), "x"), model).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").cast(kind).alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
