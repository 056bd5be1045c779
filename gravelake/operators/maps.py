"""Pixel maps, histograms and grids."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelake.functions.geometry import legendre, tsc_weight
from gravelake.functions.healpix import coarser


def coadd(pixels: DataFrame, weights: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each pixel: counts and weights added."""
    return pixels.groupBy(*(by or []), "pix").agg(F.sum("n").alias("n"), *[F.sum(w).alias(w) for w in weights])


def dense(sparse: DataFrame, npix: int, weights: list[str]) -> DataFrame:
    """All ``npix`` pixels, with counts and weighted means (0 where empty)."""
    every = sparse.sparkSession.range(npix).withColumnRenamed("id", "pix")
    full = every.join(sparse, "pix", "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("pix", n.alias("n"), *[(F.coalesce(w, F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(w) for w in weights])


def coarsen(pixels: DataFrame, factor: int, weights: list[str]) -> DataFrame:
    """``factor`` times wider pixels from counts and mean weights: counts added, means weighted by counts."""
    rows = pixels.withColumn("pix", coarser(F.col("pix"), factor))
    return rows.groupBy("pix").agg(F.sum("n").alias("total"), *[F.sum(F.col(w) * F.col("n")).alias(w) for w in weights]).select("pix", F.col("total").alias("n"), *[(F.col(w) / F.greatest("total", F.lit(1))).alias(w) for w in weights])


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    return [low * (high / low) ** (i / bins) for i in range(bins + 1)]


def which_bin(x: Column, edges: list[float], closed: bool = False) -> Column:
    """0-based bin [low, high) of x, null outside; ``closed``: the last bin includes its upper edge."""
    n = len(edges) - 1
    i = sum(((x >= e).cast("int") for e in edges[:-1]), F.lit(0)) - 1
    inside = (x >= edges[0]) & ((x <= edges[-1]) if closed else (x < edges[-1]))
    return F.when(inside, F.least(i, F.lit(n - 1)))


def radial_histogram(df: DataFrame, radius: Column, value: Column, edges: list[float]) -> DataFrame:
    """``bin, rmin, rmax, n, mean_r, mean_value``; an empty bin has its centre as radius and value 0."""
    got = df.select(which_bin(radius, edges).alias("bin"), radius.alias("r"), value.alias("v")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("v").alias("v"))
    table = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, rmin double, rmax double")
    return table.join(got, "bin", "left").select("bin", "rmin", "rmax", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("r", (F.col("rmin") + F.col("rmax")) / 2).alias("mean_r"), F.coalesce("v", F.lit(0.0)).alias("mean_value"))


def wedge_histogram(grid: DataFrame, edges: list[float], ells: list[int], box: float, half_z: int | None = None) -> DataFrame:
    """Bins of wavenumber with multipoles, from a grid ``kx, ky, kz, power`` in signed mode numbers.

    With ``half_z`` the grid holds kz >= 0 only and modes with 0 < kz < half_z
    count twice.  The last bin is closed.
    """
    k = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz")) * (2 * 3.141592653589793 / box)
    times = F.when((F.col("kz") > 0) & (F.col("kz") < half_z), 2).otherwise(1) if half_z else F.lit(1)
    mu = F.when(k > 0, F.col("kz") * (2 * 3.141592653589793 / box) / k).otherwise(F.lit(0.0))
    rows = grid.select(which_bin(k, edges, closed=True).alias("bin"), k.alias("k"), mu.alias("mu"), times.alias("times"), "power").filter("bin is not null")
    modes = F.sum("times")
    return rows.groupBy("bin").agg(modes.cast("long").alias("n_modes"), (F.sum(F.col("k") * F.col("times")) / modes).alias("k_mean"), *[((2 * l + 1) * F.sum(F.col("power") * legendre(l, F.col("mu")) * F.col("times")) / modes).alias(f"p{l}") for l in ells])


def tsc_grid(points: DataFrame, n: int, weight: Column | None = None, dims: int = 3) -> DataFrame:
    """Triangular-cloud assignment of points of the unit box centred on 0 to an n**dims periodic grid: ``ix, iy[, iz], mass``.

    The weights for the 3**dims cells around are added up by the points' own
    cell first, so that cells are copied and not points.
    """
    axes = "xyz"[:dims]
    g = {c: (F.col(c) + 0.5) * n for c in axes}
    near = {c: F.floor(g[c] + 0.5) for c in axes}
    rows = points.select(*[F.pmod(near[c], F.lit(n)).alias(f"i{c}") for c in axes], *[(g[c] - near[c]).alias(f"d{c}") for c in axes], (weight if weight is not None else F.lit(1.0)).alias("w"))
    around = list(itertools.product((-1, 0, 1), repeat=dims))
    sums = []
    for k, offsets in enumerate(around):
        mass = F.col("w")
        for c, o in zip(axes, offsets, strict=True):
            mass = mass * tsc_weight(F.col(f"d{c}"), o)
        sums.append(F.sum(mass).alias(f"m{k}"))
    cells = rows.groupBy(*[f"i{c}" for c in axes]).agg(*sums)
    parts = [F.struct(*[F.pmod(F.col(f"i{c}") + o, F.lit(n)).alias(f"i{c}") for c, o in zip(axes, offsets, strict=True)], F.col(f"m{k}").alias("mass")) for k, offsets in enumerate(around)]
    spread = cells.select(F.explode(F.array(*parts)).alias("s"))
    return spread.groupBy(*[F.col(f"s.i{c}").alias(f"i{c}") for c in axes]).agg(F.sum("s.mass").alias("mass"))


def cylindrical_histogram(grid: DataFrame, across: list[float], along: list[float], value: str = "power") -> DataFrame:
    """``bin_across, bin_along, n, mean`` of a grid ``kx, ky, kz`` by distance from the z axis and height, both in grid units."""
    rho = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))
    rows = grid.select(which_bin(rho, across).alias("bin_across"), which_bin(F.abs(F.col("kz")).cast("double"), along).alias("bin_along"), F.col(value).alias("v"))
    return rows.filter("bin_across is not null and bin_along is not null").groupBy("bin_across", "bin_along").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def exponents(order: int) -> list[tuple[int, int, int]]:
    """(a, b, c) with a + b + c <= order; the place in the list is the linear index of a multipole."""
    return [(a, b, c) for a in range(order + 1) for b in range(order + 1 - a) for c in range(order + 1 - a - b)]


def taylor(points: DataFrame, coefficients: DataFrame, by: list[str], order: int) -> DataFrame:
    """``points`` with ``value``: the sum of m{abc} x**a y**b z**c / (a! b! c!) with the coefficients of their cell; x, y, z relative to its centre."""
    value = F.lit(0.0)
    for a, b, c in exponents(order):
        term = F.col(f"m{a}{b}{c}") / float(math.factorial(a) * math.factorial(b) * math.factorial(c))
        for name, e in zip("xyz", (a, b, c), strict=True):
            for _ in range(e):
                term = term * F.col(name)
        value = value + term
    names = [f"m{a}{b}{c}" for a, b, c in exponents(order)]
    return points.join(coefficients.select(*by, *names), by).withColumn("value", value).drop(*names)


def multipoles(points: DataFrame, by: list[str], order: int) -> DataFrame:
    """Sums of x**a * y**b * z**c with a + b + c <= order, by group; x, y, z relative to the group's centre."""
    powers = exponents(order)
    term = lambda a, b, c: F.sum(F.pow("x", F.lit(float(a))) * F.pow("y", F.lit(float(b))) * F.pow("z", F.lit(float(c)))).alias(f"m{a}{b}{c}")
    return points.groupBy(*by).agg(*[term(*p) for p in powers])
