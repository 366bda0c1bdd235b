"""Linear systems: sparse ones by Krylov iterations, tall dense ones by a tree of QR factors."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loops import cut, scratch


@dataclass
class Buckets:
    """Tables bucketed by a key in the shared folder, so that what joins or groups by it again moves neither side."""

    spark: SparkSession
    names: list[str] = field(default_factory=list)

    def save(self, df: DataFrame, key: str) -> DataFrame:
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"buckets_{uuid.uuid4().hex}"
        df.repartition(count, key).write.option("path", scratch(self.spark, "buckets")).bucketBy(count, key).sortBy(key).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self, keep: int = 0) -> None:
        """Take all names but the last ``keep`` out of the catalog."""
        while len(self.names) > keep:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(0)}")


@dataclass
class Solution:
    """``x`` holds (col, x); the rest reports on the iterations."""

    x: DataFrame
    iterations: int
    residual: float
    reason: str


def entries(matrix: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(row, col, value), repeated places summed; entries with a null are left out."""
    rows = matrix.select(F.col(keys[0]).alias("row"), F.col(keys[1]).alias("col"), F.col(value).cast("double").alias("value"))
    return rows.where("row is not null and col is not null and value is not null").groupBy("row", "col").agg(F.sum("value").alias("value"))


def right_side(b: DataFrame, key: str, value: str) -> DataFrame:
    rows = b.select(F.col(key).alias("row"), F.col(value).cast("double").alias("x")).where("row is not null and x is not null")
    return rows.groupBy("row").agg(F.sum("x").alias("x"))


def norm(df: DataFrame, x: Column) -> float:
    return math.sqrt(df.agg(F.sum(x * x)).first()[0] or 0.0)


def lsqr(
    matrix: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("row", "col"),
    value: str = "value",
    damp: float = 0.0,
    eps_a: float = 1e-10,
    eps_b: float = 1e-10,
    most: int = 100,
    scaled: bool = True,
) -> Solution:
    """Least squares of a sparse system by Golub-Kahan bidiagonalisation (LSQR).

    ``matrix`` has a row an entry (``keys``, ``value``), ``b`` has (row, value)
    under the same names; rows that one of them lacks are zero there. Minimises
    ||Ax - b||^2 + damp^2 ||x||^2. ``scaled`` divides columns by their norms, a
    diagonal preconditioner (not used with ``damp``, which weighs x as it is).
    Stops when ||A'r|| <= eps_a ||A|| ||r||, ||r|| <= eps_b ||b||, or after
    ``most`` rounds; without a unique solution it gives the one of least norm.

    The matrix stands in the shared folder, bucketed by row, and never moves: a
    product with it joins the vector by row, or by column where Spark broadcasts
    it if it measures small; what is shuffled are partial sums a column. Each
    round writes both vectors, which also cuts the lineage, and brings two
    numbers to the driver. An empty matrix gives no rows, a zero ``b`` zeros.
    """
    spark = matrix.sparkSession
    tables, moving = Buckets(spark), Buckets(spark)
    cells = entries(matrix, keys, value)
    stored = tables.save(cells, "row")
    scaled = scaled and damp == 0
    size = F.sqrt(F.sum(F.col("value") * F.col("value")))
    unit = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0) if scaled else F.lit(1.0)
    columns = stored.groupBy("col").agg(size.alias("size")).select("col", unit.alias("unit"))
    columns = cut(columns)
    if scaled:
        stored = tables.save(stored.join(columns, "col").select("row", "col", (F.col("value") / F.col("unit")).alias("value")), "row")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def times(v: DataFrame) -> DataFrame:
        return stored.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("ax"))

    def transposed(u: DataFrame) -> DataFrame:
        return stored.join(u, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("x")).alias("ax"))

    u = moving.save(right_side(b, keys[0], value), "row")
    beta = b_norm = norm(u, F.col("x"))
    start = columns if beta == 0 else columns.join(transposed(u.select("row", (F.col("x") / beta).alias("x"))), "col", "left").withColumn("v", zero("ax"))
    start = start.withColumn("v", F.lit(0.0)) if beta == 0 else start
    state = cut(start.select("col", "unit", "v", F.lit(0.0).alias("w"), F.lit(0.0).alias("x")))
    alpha = norm(state, F.col("v"))
    a_norm = norm(stored, F.col("value"))
    step_x, step_w, phi_bar, rho_bar, lost, rounds = 0.0, 0.0, beta, alpha, 0.0, 0
    reason, residual = ("zero", beta) if alpha == 0 else ("rounds", beta)
    while alpha > 0 and rounds < most:
        rounds += 1
        # what the last round left to do: v by its norm, w by the old w, x by the old w
        v, w, x = F.col("v") / alpha, F.col("v") / alpha - step_w * F.col("w"), F.col("x") + step_x * F.col("w")
        now = state.select("col", "unit", v.alias("v"), w.alias("w"), x.alias("x"))
        both = times(now.select("col", F.col("v").alias("x"))).join(u, "row", "full")
        u = moving.save(both.select("row", (zero("ax") - alpha / beta * zero("x")).alias("x")), "row")
        beta = norm(u, F.col("x"))
        if beta > 0:
            back = transposed(u.select("row", (F.col("x") / beta).alias("x")))
            state = cut(now.join(back, "col", "left").select("col", "unit", (zero("ax") - beta * F.col("v")).alias("v"), "w", "x"))
            alpha = norm(state, F.col("v"))
        else:
            state, alpha = cut(now.withColumn("v", F.lit(0.0))), 0.0
        moving.forget(1)
        damped = math.hypot(rho_bar, damp)
        lost, phi_bar = math.hypot(lost, damp / damped * phi_bar), rho_bar / damped * phi_bar
        rho = math.hypot(damped, beta)
        c, s = damped / rho, beta / rho
        theta, rho_bar, phi, phi_bar = s * alpha, -c * alpha, c * phi_bar, s * phi_bar
        step_x, step_w = phi / rho, theta / rho
        residual = math.hypot(phi_bar, lost)
        if residual <= eps_b * b_norm:
            reason = "residual"
            break
        if abs(phi_bar * alpha * c) <= eps_a * a_norm * residual:
            reason = "gradient"
            break
    x = cut(state.select("col", ((F.col("x") + step_x * F.col("w")) / F.col("unit")).alias("x")))
    moving.forget()
    tables.forget()
    return Solution(x, rounds, residual, reason)


def conjugate_gradients(
    matrix: DataFrame, b: DataFrame, keys: Sequence[str] = ("row", "col"), value: str = "value", eps: float = 1e-10, most: int = 200, scaled: bool = True, start: DataFrame | None = None
) -> Solution:
    """Solution of a sparse symmetric positive definite system by conjugate gradients.

    ``matrix`` holds both triangles; ``b`` has (row, value), ``start`` (col, x)
    a first guess, both with zeros where they have no row. ``scaled`` uses the
    diagonal as preconditioner. Stops when ||r|| <= eps ||b|| or after ``most``
    rounds; raises if the matrix proves not to be positive definite. Stored,
    joined and cut as in ``lsqr``: one product and one written table a round.
    """
    spark = matrix.sparkSession
    tables, moving = Buckets(spark), Buckets(spark)
    stored = tables.save(entries(matrix, keys, value), "row")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def times(v: DataFrame) -> DataFrame:
        """A is its own transpose: the join is by the bucketed row, partial sums go by column."""
        return stored.join(v, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("x")).alias("ax")).withColumnRenamed("col", "row")

    diagonal = stored.where(F.col("row") == F.col("col")).select("row", F.col("value").alias("d"))
    own = stored.select("row").distinct().join(diagonal, "row", "left").join(right_side(b, keys[0], value), "row", "left")
    if own.where(zero("d") <= 0).limit(1).count():
        raise ValueError("a positive definite matrix has a positive diagonal")
    own = own.select("row", (F.col("d") if scaled else F.lit(1.0)).alias("d"), zero("x").alias("b"))
    if start is None:
        table = own.select("row", "d", F.lit(0.0).alias("x"), F.col("b").alias("r"), "b")
    else:
        guess = right_side(start.select(F.col("col").alias("row"), F.col("x").alias("value")), "row", "value")
        table = own.join(guess, "row", "left").select("row", "d", "b", zero("x").alias("x"))
        table = table.join(times(guess), "row", "left").select("row", "d", "x", (F.col("b") - zero("ax")).alias("r"), "b")
    table = moving.save(table.select("row", "d", "x", "r", (F.col("r") / F.col("d")).alias("p"), "b"), "row")
    sums = lambda t, *terms: [v or 0.0 for v in t.agg(*[F.sum(x) for x in terms]).first()]
    rz, rr, bb = sums(table, F.col("r") * F.col("p"), F.col("r") * F.col("r"), F.col("b") * F.col("b"))
    rounds, reason = 0, "residual"
    x = table.select(F.col("row").alias("col"), "x")
    while math.sqrt(rr) > eps * math.sqrt(bb) and rr > 0:
        if rounds == most:
            reason = "rounds"
            break
        rounds += 1
        product = times(table.select("row", F.col("p").alias("x")))
        table = moving.save(table.join(product, "row", "left").select("row", "d", "x", "r", "p", zero("ax").alias("q")), "row")
        (pq,) = sums(table, F.col("p") * F.col("q"))
        if pq <= 0:
            raise ValueError("the matrix is not positive definite")
        r = F.col("r") - rz / pq * F.col("q")
        after, rr = sums(table, r * r / F.col("d"), r * r)
        table = table.select("row", "d", (F.col("x") + rz / pq * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + after / rz * F.col("p")).alias("p"))
        x = table.select(F.col("row").alias("col"), "x")
        rz = after
        if rounds > 1:
            moving.forget(2)
    x = cut(x)
    moving.forget()
    tables.forget()
    return Solution(x, rounds, math.sqrt(rr), reason)


# tall dense systems


def qr_factor(rows: DataFrame, columns: Sequence[Column], fan: int = 64) -> np.ndarray:
    """The triangle R of a tall matrix with ``columns``: R'R = A'A, found without squaring A.

    Each task folds its rows, a batch at a time, into one triangle; triangles
    meet ``fan`` at a time until one is left. What moves is a triangle a task,
    d * d numbers. Rows with a null, NaN or infinite column are left out.
    """
    d = len(columns)
    whole = rows.select(F.array(*[c.cast("double") for c in columns]).alias("a"))
    whole = whole.where(~F.exists("a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)))

    def folded(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        return r

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = folded(batch.column(0).flatten().to_numpy().reshape(-1, d) for batch in batches if batch.num_rows)
        if len(r):
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(table: pa.Table) -> pa.Table:
        r = folded(np.array(x).reshape(-1, d) for x in table["r"].to_pylist())
        return pa.table({"node": table["node"].slice(0, 1), "r": [r.ravel()]})

    shape = "node long, r array<double>"
    left = cut(whole.mapInArrow(fold, shape))
    while left.count() > fan:
        left = cut(left.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInArrow(merge, shape))
    return folded(np.array(r.r).reshape(-1, d) for r in left.orderBy("node").collect())


@dataclass
class Fit:
    """Coefficients in the order of the columns, and what the factor tells of the system."""

    coefficients: np.ndarray
    rank: int
    reciprocal_condition: float
    null_space: np.ndarray
    residual: float


def least_squares(rows: DataFrame, columns: Sequence[Column], target: Column, threshold: float = 0.0) -> Fit:
    """Dense least squares of ``target`` on ``columns`` over all rows, degenerate systems included.

    The triangle of the columns and the target is solved through singular
    values; those at most ``threshold`` (by default what rounding leaves) times
    the greatest count as zero, and the solution of least norm is returned,
    beside an orthonormal basis of the null space. Works where the normal
    equations, whose condition is the square, fail. No rows give zeros, rank 0.
    """
    d = len(columns)
    r = qr_factor(rows, [*columns, target])
    r = np.vstack([r, np.zeros((max(0, d + 1 - len(r)), d + 1))])
    u, s, vt = np.linalg.svd(r[:, :d], full_matrices=False)
    least = (threshold or max(r.shape) * np.finfo(float).eps) * (s[0] if len(s) else 0.0)
    rank = int((s > least).sum())
    x = vt[:rank].T @ ((u[:, :rank].T @ r[:, d]) / s[:rank])
    condition = float(s[-1] / s[0]) if len(s) and s[0] > 0 else 0.0
    return Fit(x, rank, condition, vt[rank:].T, float(np.linalg.norm(r[:, :d] @ x - r[:, d])))
