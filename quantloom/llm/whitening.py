"""Whitened embeddings: covariance by polarisation, principal components, unit variances.

A variance of a sum of two dimensions is the sum of their variances and twice their covariance.  So tasks add up, exactly and in
integers, only squares of centred values: of every dimension and of every sum of two dimensions.  The differences of these
variances give all covariances; one small matrix per vector length is assembled from them and decomposed.

Entries become integers, floor(1024 c) + 100000.  Squares are taken of distances from the integer next to the mean, and the rest of the mean
is subtracted at the end in whole numbers, so the covariance is that around the exact mean, without cancellation.

Rules.  Vectors that are null, empty, or hold null or non-finite entries are left out.  Vectors of different lengths are fitted apart,
each length with its own n.  Repeated rows and ties count one by one; a null vec_id is a row like any other; other columns are ignored; an empty
table gives an empty result.  Entries beyond 2^53 / 1024 in size are held at that bound, where doubles stop being exact integers.  A component without variance
(fewer vectors than components, constant dimensions) has null ``whitened`` and doesn't count in ``identity_error``; without any
variance ``explained`` is null.  A ``deviation`` that doesn't fit a long is null, and so is ``identity_error`` where no component has variance.
"""

from __future__ import annotations

import functools
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stage

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Integers of doubles are exact up to here.
EXACT = float(2**53)
#: Partial sums held by a task before it hands them on, and cells of a block of rows.
HELD, CELLS = 1 << 20, 1 << 20
#: A component of less variance than this share of the total has none.
NONE = 1e-12

#: Entries of the components that a task holds; vectors of more lengths than fit are projected in several passes.
MODEL_CELLS = 1 << 22

TOTALS = "dim int, at int, n long, total decimal(38,0)"
SQUARES = "dim int, i int, j int, q decimal(38,0)"
MODEL = "dim int, fitted long, near array<long>, rest array<long>, axes array<array<double>>, variances array<double>, trace double"


def usable(embedding: Column) -> Column:
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(embedding) > 0), F.lit(False))


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x, the vectors as integers."""
    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c * SCALE, F.lit(-EXACT)), F.lit(EXACT))).cast("long") + F.lit(OFFSET).cast("long")

    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    return v.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", whole).alias("x"))


def matrices(batch: pa.RecordBatch, name: str):
    """(length, matrix) of the vectors of each length."""
    column = batch.column(name)
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        some = column.take(pa.array(np.flatnonzero(sizes == dim)))
        yield dim, some.flatten().to_numpy().reshape(-1, dim)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, from halves that can't overflow."""
    return (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


def exact_squares(z: np.ndarray) -> np.ndarray:
    """Sums over rows of z_i^2 and of (z_i + z_j)^2, i < j, one list in order of (i, j), as Python integers."""
    dim = z.shape[1]
    step = max(CELLS // dim, 1)
    total = np.zeros(dim * (dim + 1) // 2, object)
    for at in range(0, len(z), step):
        block = z[at:at + step]
        most = 2 * int(max(block.max(), -block.min()))
        if most * most * len(block) >= 2**63:
            block = block.astype(object)
        columns = np.ascontiguousarray(block.T)
        part = [np.concatenate(((columns[i:i + 1] ** 2).sum(axis=1), ((columns[i + 1:] + columns[i]) ** 2).sum(axis=1))) for i in range(dim)]
        total += np.concatenate(part).astype(object)
    return total


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def add_up(batches):
    """Number and sums of the vectors of each length in a task."""
    held: dict[int, list] = {}

    def out():
        for dim, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), _decimals(total)],
                                             names=["dim", "at", "n", "total"])
        held.clear()

    for batch in batches:
        for dim, x in matrices(batch, "x"):
            have = held.setdefault(dim, [0, np.zeros(dim, object)])
            have[0] += len(x)
            have[1] = have[1] + exact_sum(x)
        if sum(held) > HELD:
            yield from out()
    yield from out()


def add_squares(batches):
    """Squares of centred values and of centred sums of two dimensions, added up over a task."""
    held: dict[int, np.ndarray] = {}

    def out():
        for dim, total in held.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total)],
                                             names=["dim", "i", "j", "q"])
        held.clear()

    for batch in batches:
        for dim, z in matrices(batch, "z"):
            held[dim] = held.get(dim, 0) + exact_squares(z)
        if sum(len(t) for t in held.values()) > HELD:
            yield from out()
    yield from out()


def covariance(n: int, rest: list[int], q: np.ndarray) -> np.ndarray:
    """Covariance matrix, divisor n, from squares around integers: ``rest`` is what their sums leave over.

    n q - t^2 is n^2 times a variance, t the sum of the distances; half the difference of the variances is a covariance.
    """
    dim = len(rest)
    i, j = np.triu_indices(dim)
    left = np.array(rest, object)
    t = np.where(i == j, left[i], left[i] + left[j])
    spread = np.zeros((dim, dim), object)
    spread[i, j] = n * q - t * t
    own = spread[np.arange(dim), np.arange(dim)]
    twice = np.where(i == j, 2 * own[i], spread[i, j] - own[i] - own[j])
    v = np.zeros((dim, dim))
    v[i, j] = v[j, i] = [int(c) / (2 * n * n) for c in twice]
    return v


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors as rows; the largest entry of each is positive."""
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most].T
    turn = np.sign(axes[np.arange(len(axes)), np.argmax(np.abs(axes), axis=1)])
    return values, axes * turn[:, None]


def fit(vectors: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """Integer vectors around ``near`` (vec_id, dim, z) and one model row per vector length.  Two passes over the vectors; a task hands on d sums, then d (d + 1) / 2."""
    x = integers(vectors)
    sums = x.select("x").mapInArrow(add_up, TOTALS).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    ahead = F.round(F.col("total") / F.col("n")).cast("long")  # any integer near the mean would do
    sums = sums.select("dim", "at", "n", ahead.alias("near"), (F.col("total") - F.col("n") * ahead).cast("long").alias("rest"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "near", "rest")))
    means = stage(sums.groupBy("dim").agg(F.first("n").alias("fitted"), ordered.alias("s")).select("dim", "fitted", F.col("s.near").alias("near"), F.col("s.rest").alias("rest")), "vector-means")
    z = x.join(means.select("dim", "near"), "dim").select("vec_id", "dim", F.zip_with("x", "near", lambda a, b: a - b).alias("z"))
    squares = z.select("z").mapInArrow(add_squares, SQUARES).groupBy("dim", "i", "j").agg(F.sum("q").alias("q"))
    gathered = squares.join(means, "dim").select("dim", "i", "j", "q", *[F.when((F.col("i") == 0) & (F.col("j") == 0), F.col(c)).alias(c) for c in ("fitted", "near", "rest")])

    def assemble(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        order = np.lexsort((j, i))
        given = table.slice(int(order[0]), 1)
        n, rest = given["fitted"][0].as_py(), given["rest"][0].as_py()
        q = table["q"].to_pylist()
        v = covariance(n, rest, np.array([int(q[k]) for k in order], object))
        values, axes = components(v, most)
        return pa.table({"dim": pa.array([dim], pa.int32()), "fitted": pa.array([n], pa.int64()), "near": pa.array(given["near"].to_pylist(), pa.list_(pa.int64())), "rest": pa.array([rest], pa.list_(pa.int64())),
                         "axes": pa.array([axes.tolist()], pa.list_(pa.list_(pa.float64()))), "variances": pa.array([values.tolist()], pa.list_(pa.float64())), "trace": pa.array([float(np.trace(v))])})

    return z, stage(gathered.groupBy("dim").applyInArrow(assemble, MODEL), "whitening-model")


def projections(z: np.ndarray, model: dict) -> list[pa.Array]:
    """n, deviation, whitened and explained of vectors of one length; sums run over the dimensions in order."""
    n, rest, variances = model["fitted"], model["rest"], np.array(model["variances"])
    count, kinds = len(z), len(variances)
    centred = np.ascontiguousarray((z - np.array(rest) / n).T)
    axes = np.array(model["axes"])
    dots = np.zeros((kinds, count))
    for d in range(len(rest)):
        dots += axes[:, d:d + 1] * centred[d]
    live = variances > model["trace"] * NONE
    whitened = dots / np.sqrt(np.where(live, variances, 1.0))[:, None]
    most = n * int(max(z.max(), -z.min())) + max(abs(r) for r in rest)
    if len(rest) * most * most < 2**63:
        deviation = ((n * z - np.array(rest)) ** 2).sum(axis=1).tolist()
    else:
        exact = ((n * z.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        deviation = [int(x) if x < 2**63 else None for x in exact]
    explained = [max(float(e), 0.0) / model["trace"] if model["trace"] > 0 else None for e in variances]
    ends = pa.array(np.arange(count + 1, dtype=np.int32) * kinds)
    return [pa.array([n] * count, pa.int64()), pa.array(deviation, pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(whitened.T.ravel(), mask=np.tile(~live, count))),
            pa.array([explained] * count, pa.list_(pa.float64()))]


def projected(z: DataFrame, model: DataFrame) -> DataFrame:
    """vec_id, dim, n, deviation, whitened, explained of vectors around integers (vec_id, dim, z)."""
    spark = z.sparkSession
    schema = StructType([z.schema["vec_id"], *spark.createDataFrame([], "dim int, n long, deviation long, whitened array<double>, explained array<double>").schema])

    def part(models: dict[int, dict]) -> DataFrame:
        shared = spark.sparkContext.broadcast(models)  # MODEL_CELLS entries, or one length

        def run(batches):
            for batch in batches:
                sizes = batch.column("dim").to_numpy()
                for dim in np.unique(sizes).tolist():
                    same = batch.filter(pa.array(sizes == dim))
                    _, vectors = next(matrices(same, "z"))
                    yield pa.RecordBatch.from_arrays([same.column("vec_id"), same.column("dim"), *projections(vectors, shared.value[dim])], names=schema.names)

        return z.where(F.col("dim").isin(*models)).mapInArrow(run, schema)

    parts, held, cells = [], {}, 0
    for r in model.toLocalIterator():
        size = len(r["axes"]) * r["dim"]
        if held and cells + size > MODEL_CELLS:
            parts.append(part(held))
            held, cells = {}, 0
        held[r["dim"]] = r.asDict()
        cells += size
    parts += [part(held)] if held else []
    return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (an array, component by component), explained (likewise) and identity_error of every usable vector."""
    z, model = fit(vectors, most)
    row = stage(projected(z, model), "whitened")
    return row.join(F.broadcast(identity_error(row, most)), "dim").drop("dim")  # a row per length; an exchange by length would send all vectors of one to one task


def identity_error(whitened: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per vector length the largest absolute entry of the whitened vectors' covariance less the identity."""
    w = [F.get(F.col("whitened"), k) for k in range(most)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    sums = whitened.groupBy("dim").agg(*[F.avg(w[i]).alias(f"m{i}") for i in range(most)], *[F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs])
    off = [F.abs(F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") - float(i == j)) for i, j in pairs]
    return sums.select("dim", F.array_max(F.array(*off)).alias("identity_error"))
