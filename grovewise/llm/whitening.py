"""Whitening of integer vectors by the eigenvectors of their exactly centred covariance.

Sums of each dimension are whole numbers, so n * x - sum is exact and is divided once: the rows of the RowMatrix whose
Gramian, divided by n, is the covariance. Its eigenvectors are found on the driver (a matrix of dims x dims, whatever the
number of rows) and go to the workers, which whiten batch by batch. Nothing is shuffled but one sum a dimension and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import stored

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """What was fitted: rows, exact sums, eigenvalues by falling size, unit eigenvectors as columns, the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integer_vectors(embeddings: DataFrame, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, x array<long>) with x = floor(scale * c) + offset of every row whose vector isn't null and holds neither
    null nor non-finite entries. Null ids and repeated rows stay; other columns are ignored."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where(sound).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")).alias("x"))


def gramian(rows: DataFrame, column: str | Column, n: int) -> np.ndarray:
    """The sum of outer products of the ``n`` vectors of ``column`` (array<double>), by MLlib in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n).computeGramianMatrix().toArray()


def exact_sums(rows: DataFrame) -> tuple[int, np.ndarray, int]:
    """The number of rows, the sum of each dimension of ``x`` and the largest magnitude: one row a dimension and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, most = 0, np.int64(0), 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                n, total, most = n + len(x), total + x.sum(axis=0), max(most, int(np.abs(x).max()))
        if n:
            yield pd.DataFrame({"dim": np.arange(len(total)), "total": total, "n": n, "most": most})

    found = rows.select("x").mapInPandas(run, "dim int, total long, n long, most long").groupBy("dim").agg(F.sum("total"), F.sum("n"), F.max("most")).orderBy("dim").collect()
    return (int(found[0][2]), np.array([r[1] for r in found], np.int64), max(r[3] for r in found)) if found else (0, np.zeros(0, np.int64), 0)


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening:
    """Fitted on all ``rows`` (x array<long>, one width). Components of an eigenvalue that is nought by the precision of
    doubles can't be whitened and are left out: fewer than ``components`` where the rows span fewer dimensions."""
    n, sums, most = exact_sums(rows)
    if n * most >= 1 << 62:
        raise ArithmeticError(f"{n} rows of entries up to {most} can't be centred exactly in 64 bits")
    # An array literal: as many numbers as dimensions.
    centred = F.zip_with("x", F.array(*map(F.lit, sums.tolist())).cast("array<long>"), lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n)))
    covariance = gramian(rows, centred, n) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    vectors = vectors[:, :some] * np.sign(vectors[np.abs(vectors[:, :some]).argmax(axis=0), np.arange(some)])
    return Whitening(n, sums, values[:some].copy(), vectors.copy(), float(np.trace(covariance)))


def squared(deviation: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of integers; None where it exceeds 64 bits."""
    if int(np.abs(deviation).max(initial=0)) ** 2 * deviation.shape[1] < 1 << 63:
        return (deviation * deviation).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (int((row * row).sum()) for row in deviation.astype(object))]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (vec_id, x) as (vec_id, deviation, whitened array<double>): the exact sum over dimensions of
    (n * x - sum) ** 2, null where it exceeds 64 bits, and the whitened components."""
    n, sums, onto = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                deviation = np.stack(batch["x"].to_numpy()) * np.int64(n) - sums
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "deviation": pd.array(squared(deviation), "Int64"), "whitened": list(deviation / n @ onto)})

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInPandas(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened``, as it came out, minus the identity."""
    means = whitened.agg(*(F.avg(F.col("whitened")[i]) for i in range(components))).first()
    centred = F.zip_with("whitened", F.array(*map(F.lit, means)), lambda w, m: w - m)
    return float(np.abs(gramian(whitened, centred, n) / n - np.eye(components)).max())


def whitened_components(rows: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each row of ``rows`` (vec_id, x
    array<long>) and component.

    Vectors of one width are one fit list; each width is fitted by itself, one after the other, so widths should be few.
    Vectors without dimensions, a single vector and equal vectors have no component and so no row; an empty table gives
    none. Repeated rows and null ids stay. The order of rows and their places don't change sums, but the last bits of the
    Gramian.
    """
    spark, out = rows.sparkSession, []
    widths = [r[0] for r in rows.groupBy(F.size("x")).count().orderBy("size(x)").collect()]
    for width in widths:
        some = rows.where(F.size("x") == width)
        model = fit_whitening(some, components) if width else None
        if model is None or not len(model.values):
            continue
        k = len(model.values)
        whitened = stored(whiten(some, model), "whitened")
        error = identity_error(whitened, model.n, k)
        explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
        long = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        out.append(long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error")))
    if not out:
        return spark.createDataFrame([], RESULT)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
