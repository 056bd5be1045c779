"""Periodic boxes, cells, slabs and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_centred(x: Column, box: float) -> Column:
    """Into [-box/2, box/2), one wrap."""
    return F.when(x >= box / 2, x - box).when(x < -box / 2, x + box).otherwise(x)


def wrap_origin(x: Column, box: float) -> Column:
    """Into [0, box), any number of wraps."""
    return x - F.floor(x / box) * box


def cell(x: Column, cpd: int) -> Column:
    """Cell index of a coordinate of the unit box centred on 0."""
    return F.pmod(F.floor((x + 0.5) * cpd), F.lit(cpd)).cast("int")


def cell_centre(i: Column, cpd: int) -> Column:
    return (i - (cpd - 1) / 2) / cpd


def slab(x: Column, cpd: int, box: float = 1.0) -> Column:
    """Slab of a coordinate in a box centred on 0."""
    return F.pmod((x / box + 0.5) * cpd, F.lit(float(cpd))).cast("int")


def minimum_image(d: Column, box: float = 1.0) -> Column:
    """The shortest periodic image of a difference, halves to even."""
    return d - box * F.bround(d / box)


def distance2(a: tuple[Column, ...], b: tuple[Column, ...], box: float | None = None) -> Column:
    parts = [x - y if box is None else minimum_image(x - y, box) for x, y in zip(a, b, strict=True)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def boxes_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column, box: float) -> Column:
    """Whether two periodic intervals share a point."""
    ahead = F.pmod(low_b - low_a, F.lit(box))
    behind = F.pmod(low_a - low_b, F.lit(box))
    return (ahead <= high_a - low_a) | (behind <= high_b - low_b)


def legendre(ell: int, mu: Column) -> Column:
    """Legendre polynomials of even order up to 6."""
    m2 = mu * mu
    return {0: lambda: F.lit(1.0) + 0 * m2, 2: lambda: (3 * m2 - 1) / 2, 4: lambda: (35 * m2 * m2 - 30 * m2 + 3) / 8, 6: lambda: (231 * m2 * m2 * m2 - 315 * m2 * m2 + 105 * m2 - 5) / 16}[ell]()


def tsc_weight(d: Column, offset: int) -> Column:
    """Weight of the cell ``offset`` cells from the nearest, for a point ``d`` cells from that cell's centre."""
    if offset == 0:
        return 0.75 - d * d
    side = 0.5 + d * offset
    return 0.5 * side * side


def tsc_window(k: Column, cell_size: float, aliased: bool = True) -> Column:
    """What a power spectrum of a triangular-cloud grid is divided by, along one axis."""
    half = k * cell_size / 2
    s2 = F.sin(half) * F.sin(half)
    if aliased:
        return 1 - s2 + 2 * s2 * s2 / 15
    return F.when(half == 0, F.lit(1.0)).otherwise(F.pow(F.sin(half) / half, F.lit(6.0)))


def line_of_sight(pos: tuple[Column, Column, Column], vel: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Velocity along the line of sight, towards growing polar angle, and towards growing azimuth."""
    x, y, z = pos
    flat = F.sqrt(x * x + y * y)
    r = F.sqrt(x * x + y * y + z * z)
    radial = (vel[0] * x + vel[1] * y + vel[2] * z) / r
    theta = (vel[0] * x * z / flat + vel[1] * y * z / flat - vel[2] * flat) / r
    phi = (vel[1] * x - vel[0] * y) / flat
    return radial, theta, phi


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, by the trigonometric solution."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    safe = F.when(p > 0, p).otherwise(F.lit(1.0))
    a, b, c = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    d, e, f = xy / safe, xz / safe, yz / safe
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    angle = F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    high = q + 2 * p * F.cos(angle)
    low = q + 2 * p * F.cos(angle + 2 * 3.141592653589793 / 3)
    return high, 3 * q - high - low, low


def eigensystem(tensors: DataFrame, names: tuple[str, ...] = ("xx", "yy", "zz", "xy", "xz", "yz")) -> DataFrame:
    """Symmetric 3 x 3 matrices with their eigenvalues ``e1 >= e2 >= e3`` and unit eigenvectors ``v11 .. v33`` (``v12``: y of the first).

    An eigenvector is orthogonal to all rows of A - e: of the cross products of
    its rows the longest is taken.  Where eigenvalues coincide axes stand in.
    Steps are columns of their own, since expressions that nest would repeat
    what they share.
    """

    def cross(a, b):
        return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    xx, yy, zz, xy, xz, yz = (F.col(n) for n in names)
    out = tensors.withColumns({f"e{i + 1}": e for i, e in enumerate(symmetric_eigenvalues(xx, yy, zz, xy, xz, yz))})
    scale = xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
    for i, instead in ((1, (1, 0, 0)), (3, (0, 0, 1))):
        e = F.col(f"e{i}")
        rows = ((xx - e, xy, xz), (xy, yy - e, yz), (xz, yz, zz - e))
        out = out.withColumns({f"__{p}{k}": c for p, (m, n) in enumerate(((0, 1), (0, 2), (1, 2))) for k, c in enumerate(cross(rows[m], rows[n]))})
        out = out.withColumns({f"__s{p}": sum((F.col(f"__{p}{k}") * F.col(f"__{p}{k}") for k in range(3)), F.lit(0.0)) for p in range(3)}).withColumn("__most", F.greatest("__s0", "__s1", "__s2"))
        pick = lambda k: F.when(F.col("__s0") == F.col("__most"), F.col(f"__0{k}")).when(F.col("__s1") == F.col("__most"), F.col(f"__1{k}")).otherwise(F.col(f"__2{k}"))
        found = F.col("__most") > 1e-24 * scale * scale
        out = out.withColumns({f"v{i}{k + 1}": F.when(found, pick(k) / F.sqrt("__most")).otherwise(F.lit(float(instead[k]))) for k in range(3)})
        out = out.drop("__most", *[f"__s{p}" for p in range(3)], *[f"__{p}{k}" for p in range(3) for k in range(3)])
    third, first = ([F.col(f"v{i}{k + 1}") for k in range(3)] for i in (3, 1))
    return out.withColumns({f"v2{k + 1}": c for k, c in enumerate(cross(third, first))})


def lattice_offset(x: Column, site: Column, ppd: int, box: float = 1.0) -> Column:
    """Displacement of a coordinate from its lattice site, by the shortest image."""
    return minimum_image(x - (site / ppd - 0.5) * box, box)
