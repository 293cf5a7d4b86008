"""The Hilbert curve over a square grid, level by level as a fold over one small struct.

A fold keeps the expression as small for 31 levels as for one, where an unrolled one would double with each level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVELS = 31


def levels(n_vertices: int) -> int:
    k = (n_vertices - 1).bit_length() if n_vertices > 1 else 0
    if k > MAX_LEVELS:
        raise ValueError(f"{n_vertices} vertices need a grid of more than 2^{MAX_LEVELS} a side")
    return k


def side(n_vertices: int) -> int:
    """The smallest power of two that is at least the number of vertices."""
    return 1 << levels(n_vertices)


def _turn(x: Column, y: Column, rx: Column, ry: Column, s: Column) -> tuple[Column, Column]:
    """A quadrant of side s turned or mirrored; what is above the quadrant's bits is dropped."""
    low = s - 1
    return (F.when(ry == 1, x).when(rx == 1, low - y.bitwiseAND(low)).otherwise(y), F.when(ry == 1, y).when(rx == 1, low - x.bitwiseAND(low)).otherwise(x))


def encode(x: Column, y: Column, k: int) -> Column:
    """Place on the curve of the cell (x, y) of a grid with 2^k cells a side."""
    if k == 0:
        return F.lit(0).cast("long")

    def step(state: Column, s: Column) -> Column:
        rx = F.when(state["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(state["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        nx, ny = _turn(state["x"], state["y"], rx, ry, s)
        return F.struct(nx.alias("x"), ny.alias("y"), (state["d"] + s * s * (3 * rx).bitwiseXOR(ry)).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(1 << i).cast("long") for i in range(k - 1, -1, -1)]), start, step, lambda state: state["d"])


def decode(d: Column, k: int) -> Column:
    """struct(x, y) of a place on the curve."""

    def step(state: Column, s: Column) -> Column:
        t = F.expr("1").cast("long")
        rx = F.shiftright(state["t"], 1).bitwiseAND(t)
        ry = state["t"].bitwiseXOR(rx).bitwiseAND(t)
        nx, ny = _turn(state["x"], state["y"], rx, ry, s)
        return F.struct((nx + s * rx).alias("x"), (ny + s * ry).alias("y"), F.shiftright(state["t"], 2).alias("t"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), d.cast("long").alias("t"))
    if k == 0:
        return F.struct(zero.alias("x"), zero.alias("y"))
    return F.aggregate(F.array(*[F.lit(1 << i).cast("long") for i in range(k)]), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
