"""Whitening of embeddings: exact whole-number sums, the Gramian of exactly centred rows, local eigenvectors.

An entry c becomes the whole number x = floor(1024 * c) + 100000. With n rows and sums S the centred row n * x - S is exact in
64 bits; divided by n as doubles, the rows go to MLlib's ``RowMatrix``, whose Gramian over n is the covariance. Its
eigenvectors are found on the driver (a table of dimensions squared, however many rows) and the whitening matrix, one column a component,
is broadcast to the tasks that apply it. The covariance of what comes out is then measured, in two passes over the written result.

Defined results: rows whose vector is null, or holds a null or a non-finite entry, are dropped; so are, which no embedding should
be, rows with an entry of 2**30 or more in size, and rows whose vector is not of the commonest length (of equally common ones the
longest). Null and repeated ids and repeated rows are rows like any other. Directions without variance (an eigenvalue of at most
1e-12 of the largest) cannot be whitened and give no component; so a single row, equal rows and empty tables give an empty result.
``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 30
#: An eigenvalue of at most this share of the largest is none.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What whitening needs: rows, sums, eigenvalues (falling) and unit eigenvectors (columns), with the sum of all eigenvalues."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): the usable vectors as whole numbers, all of one length."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)
    vec = F.col(f"`{vec_col}`")
    usable = rows.where(vec.isNotNull() & (F.size(vec) > 0)).where(F.forall(vec, lambda c: F.coalesce(ok(c), F.lit(False))))
    usable = usable.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    lengths = usable.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return usable.where(F.size("x") == (lengths[0]["length"] if lengths else 0))


def fitted(x: DataFrame, width: int) -> Whitening | None:
    """Components over the rows of ``x`` (vec_id, x), each of ``width`` whole numbers; None where there are no rows."""
    sums = x.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(width)]).first()
    n = sums["n"]
    if not n:
        return None
    total = np.array([sums[f"s{j}"] for j in range(width)], dtype=np.int64)
    wide = F.lit(n).cast("long")
    means = F.array(*[F.lit(int(s)).cast("long") for s in total])
    centred = x.select(array_to_vector(F.zip_with("x", means, lambda v, s: (v * wide - s).cast("double") / wide)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, width)
    covariance = matrix.computeGramianMatrix().toArray() / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return Whitening(n, total, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)))


def whitened_rows(x: DataFrame, fit: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, z): the first components of each row, each of variance one."""
    spark = x.sparkSession
    scaled = spark.sparkContext.broadcast((fit.n, fit.sums, fit.vectors[:, :components] / np.sqrt(fit.values[:components])))

    def apply(batches):
        n, sums, matrix = scaled.value
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["x"].to_numpy()).astype(np.int64)
            off = rows * n - sums
            if float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [d if (d := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in off]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": pd.array(deviation, dtype="Int64"), "z": list((off / n) @ matrix)})

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInPandas(released(apply), f"vec_id {kind}, deviation long, z array<double>")


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``rows.z`` minus the identity, centred before multiplying."""
    z = [F.get("z", F.lit(i)) for i in range(components)]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    off = [c - F.lit(means[f"m{i}"]) for i, c in enumerate(z)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    entries = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(entries[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> tuple[DataFrame, Whitening | None, float | None]:
    """The whitened rows (vec_id, deviation, z), with the fit and the measured distance of their covariance from the identity."""
    scratch = Scratch(rows.sparkSession, "whitening")
    x = scratch.keep(whole_vectors(rows, id_col, vec_col), "x")
    first = x.first()
    fit = fitted(x, len(first["x"])) if first else None
    many = min(components, int((fit.values > FLAT * fit.values[0]).sum())) if fit and fit.values[0] > 0 else 0
    if not many:
        kind = x.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, deviation long, z array<double>"), fit, None
    out = scratch.keep(whitened_rows(x, fit, many), "z")
    scratch.drop("x")
    return out, fit, identity_error(out, many)


def whitening_digest(rows: DataFrame) -> DataFrame:
    """Contract columns: one row for each usable vector and component."""
    out, fit, error = whitened(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    n, shares = (fit.n, [float(v) / fit.trace for v in fit.values[:8]]) if fit and error is not None else (0, [])
    each = out.select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("place"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
