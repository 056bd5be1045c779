"""Power spectra and correlation functions of gridded fields.

Gridding, binning and combining are DataFrame operations; only the Fourier
transform runs in one task, on one grid of n**3 cells, whose size the caller
sets (``MOST_CELLS`` at most, some 0.6 GB with the transform) and which does not
grow with the particles.  Cells come into the grid batch by batch, and modes
leave it plane by plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelake.operators.maps import tsc_grid, wedge_histogram, which_bin

MOST_CELLS = 256**3


def _window(n: int, aliased: bool) -> np.ndarray:
    k = np.fft.fftfreq(n) * math.pi
    if aliased:
        s2 = np.sin(k) ** 2
        return 1 - s2 + 2 * s2**2 / 15
    return np.sinc(k / math.pi) ** 6


def _checked(n: int) -> None:
    if n**3 > MOST_CELLS:
        raise ValueError(f"a grid of {n}**3 cells is larger than {MOST_CELLS}")


def _filled(frames: Iterator[pd.DataFrame], n: int, columns: tuple[str, ...]) -> list[np.ndarray]:
    grids = [np.zeros((n, n, n)) for _ in columns]
    for pdf in frames:
        for g, c in zip(grids, columns, strict=True):
            g[pdf["ix"], pdf["iy"], pdf["iz"]] = pdf[c]
    return grids


def modes(grid: DataFrame, n: int, box: float = 1.0, other: DataFrame | None = None, window: bool = True, aliased: bool = True) -> DataFrame:
    """``kx, ky, kz, power`` of the overdensity of ``mass`` (with ``other``: of the cross spectrum), kz >= 0."""
    _checked(n)
    rows = grid.select("ix", "iy", "iz", F.col("mass").alias("a"))
    if other is not None:
        rows = rows.withColumn("b", F.lit(0.0)).unionByName(other.select("ix", "iy", "iz", F.lit(0.0).alias("a"), F.col("mass").alias("b"))).groupBy("ix", "iy", "iz").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    columns = ("a", "b") if other is not None else ("a",)

    def transform(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [np.fft.rfftn(g / g.mean() - 1) for g in _filled(frames, n, columns)]
        w = _window(n, aliased) if window else np.ones(n)
        k = (np.fft.fftfreq(n) * n).astype(np.int64)
        half = n // 2 + 1
        ky, kz = (v.ravel() for v in np.meshgrid(k, np.arange(half), indexing="ij"))
        for i in range(n):
            power = (fields[0][i] * fields[-1][i].conj()).real * (box**3 / n**6) / (w[i] * w[:, None] * w[None, :half])
            yield pd.DataFrame({"kx": k[i], "ky": ky, "kz": kz, "power": power.ravel()})

    return rows.repartition(1).mapInPandas(transform, "kx bigint, ky bigint, kz bigint, power double")


def bin_edges(n: int, box: float = 1.0, bins: int | None = None) -> list[float]:
    """``n / 4`` linear bins from 0 to the Nyquist wavenumber."""
    bins = bins or n // 4
    return [math.pi * n / box * i / bins for i in range(bins + 1)]


def power_spectrum(particles: DataFrame, n: int, box: float = 1.0, edges: list[float] | None = None, ells: tuple[int, ...] = (0,), weight=None) -> DataFrame:
    """``bin, n_modes, k_mean, p0 ..`` of particles of the unit box, in units of ``box``."""
    grid = tsc_grid(particles, n, weight)
    return wedge_histogram(modes(grid, n, box), edges or bin_edges(n, box), list(ells), box, half_z=n // 2)


def correlation(grid: DataFrame, n: int, edges: list[float], box: float = 1.0) -> DataFrame:
    """``bin, n, r, xi``: the two-point function from the inverse transform of the power."""

    _checked(n)

    def transform(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (g,) = _filled(frames, n, ("mass",))
        f = np.fft.rfftn(g / g.mean() - 1)
        xi = np.fft.irfftn(f * f.conj(), s=(n, n, n), axes=(0, 1, 2)) / n**3
        i = (np.fft.fftfreq(n) * n).astype(np.int64)
        y2 = i[:, None] ** 2 + i[None, :] ** 2
        for x in range(n):
            yield pd.DataFrame({"r": np.sqrt(i[x] ** 2 + y2).ravel() * (box / n), "xi": xi[x].ravel()})

    lags = grid.select("ix", "iy", "iz", "mass").repartition(1).mapInPandas(transform, "r double, xi double")
    return lags.withColumn("bin", which_bin(F.col("r"), edges)).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("xi").alias("xi"))


def stacked(spectra: DataFrame) -> DataFrame:
    """Spectra ``run, bin, n_modes, k_mean, p0`` of several runs averaged by modes, with the scatter between runs."""
    w = F.col("n_modes")
    return spectra.groupBy("bin").agg(F.count(F.lit(1)).alias("runs"), F.sum(w).alias("n_modes"), (F.sum(F.col("k_mean") * w) / F.sum(w)).alias("k_mean"), (F.sum(F.col("p0") * w) / F.sum(w)).alias("p0"), F.stddev("p0").alias("scatter"))


def rebinned_theory(theory: DataFrame, mode_grid: DataFrame, edges: list[float], box: float) -> DataFrame:
    """A tabulated spectrum ``k, p`` (a few thousand rows) interpolated in log-log at every mode, then binned like the modes."""
    table = theory.orderBy("k").toPandas()
    lk, lp = np.log(table["k"].to_numpy()), np.log(table["p"].to_numpy())

    @F.pandas_udf("double")
    def at(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k > 0, np.exp(np.interp(np.log(np.maximum(k, 1e-300)), lk, lp)), 0.0))

    k = F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2 + F.col("kz") ** 2) * (2 * math.pi / box)
    return mode_grid.withColumn("power", at(k)).groupBy(which_bin(k, edges, closed=True).alias("bin")).agg(F.avg("power").alias("p"), F.count(F.lit(1)).alias("modes")).filter("bin is not null")


def transfer_multipoles(model: DataFrame, target: DataFrame, edges: list[float], box: float, ells: tuple[int, ...] = (0, 2)) -> DataFrame:
    """Per bin of k the least-squares coefficients t_l of target = model * sum t_l L_l(mu); both ``kx, ky, kz, power``.

    The normal equations are sums; only the small solve of each bin is Python.
    """
    from gravelake.functions.geometry import legendre

    k = F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2 + F.col("kz") ** 2) * (2 * math.pi / box)
    both = model.join(target.withColumnRenamed("power", "goal"), ["kx", "ky", "kz"]).withColumns({"bin": which_bin(k, edges, closed=True), "mu": F.when(k > 0, F.col("kz") * (2 * math.pi / box) / k).otherwise(F.lit(0.0))}).filter("bin is not null")
    term = [F.col("power") * legendre(e, F.col("mu")) for e in ells]
    m = len(ells)
    sums = both.groupBy("bin").agg(*[F.sum(term[i] * term[j]).alias(f"a{i}{j}") for i in range(m) for j in range(i, m)], *[F.sum(term[i] * F.col("goal")).alias(f"b{i}") for i in range(m)])

    def solve(frames):
        for pdf in frames:
            a = np.zeros((len(pdf), m, m))
            for i in range(m):
                for j in range(i, m):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}{j}"]
            b = np.stack([pdf[f"b{i}"] for i in range(m)], 1)
            t = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)]) if len(pdf) else np.zeros((0, m))
            yield pd.DataFrame({"bin": pdf["bin"], **{f"t{e}": t[:, i] for i, e in enumerate(ells)}})

    return sums.mapInPandas(solve, "bin int, " + ", ".join(f"t{e} double" for e in ells))
