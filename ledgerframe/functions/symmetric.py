"""Small symmetric matrices as column expressions: a packed array of the upper triangle, row by row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import bound

#: Squarings of the matrix: weights of other axes fall by the ratio of eigenvalues to the power 2**SQUARINGS.
SQUARINGS = 32


def place(i: int, j: int, n: int) -> int:
    """Where entry (i, j) of an n x n matrix stands in the packed array."""
    i, j = min(i, j), max(i, j)
    return i * n - i * (i - 1) // 2 + j - i


def principal_axis(matrix: Column, n: int, anchor: int) -> Column:
    """Unit eigenvector of the largest eigenvalue of a packed positive semidefinite matrix, signed so that entry `anchor` is >= 0.

    The matrix is squared and scaled to trace 1 again and again, which leaves the projector on that axis; the column
    with the largest diagonal entry is the axis. Null where an entry is missing or not finite, or all are 0.
    """
    at = lambda m, i, j: F.get(m, F.lit(place(i, j, n)))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    trace = lambda m: sum((at(m, i, i) for i in range(1, n)), at(m, 0, 0))
    scaled = lambda m: bound(m, lambda x: bound(trace(x), lambda t: F.transform(x, lambda e: e / t)))
    square = lambda m: F.array(*[sum((at(m, i, k) * at(m, k, j) for k in range(1, n)), at(m, i, 0) * at(m, 0, j)) for i, j in pairs])
    start = scaled(matrix)
    projector = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), start, lambda m, _: scaled(square(m)))

    def column_of(p: Column) -> Column:
        best = F.array_max(F.array(*[F.struct(at(p, i, i).alias("d"), F.lit(-i).alias("i"), F.array(*[at(p, i, j) for j in range(n)]).alias("v")) for i in range(n)]))["v"]
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        signed = lambda v: F.when(F.get(v, F.lit(anchor)) < 0, -norm(v)).otherwise(norm(v))
        return bound(best, lambda v: bound(signed(v), lambda s: F.transform(v, lambda x: x / s)))

    usable = F.forall(matrix, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (trace(matrix) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), bound(projector, column_of))
