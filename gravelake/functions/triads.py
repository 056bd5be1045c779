"""Orthonormal triads packed in 16 bits.

Fixed values of the format: 12 caps (largest axis, second axis, its sign), 11
rings of 2k+1 cells, 45 azimuths; a code is (121 * cap + ring cell) * 45 + azimuth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS, TURNS = 11, 45
_SCALE = float(1 / np.sqrt(1 - 1 / np.sqrt(2)))
#: Axes in the order (remaining, second, largest) for each cap divided by two.
_ORDER = np.array([(2, 1, 0), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (0, 1, 2)])
#: The plane in which the minor axis is measured, by largest axis.
_PLANE = np.array([(1, 2), (2, 0), (0, 1)])


def pack(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Codes of (n, 3) major and minor axes; signs of axes are not kept."""
    major = major / np.linalg.norm(major, axis=1, keepdims=True)
    rank = np.argsort(np.abs(major), axis=1)
    rows = np.arange(len(major))
    big = rank[:, 2]
    major = major * np.where(major[rows, big] < 0, -1, 1)[:, None]
    second, other = rank[:, 1], rank[:, 0]
    half = np.array([int(np.flatnonzero((_ORDER == (o, s, b)).all(1))[0]) for o, s, b in zip(other, second, big, strict=True)], np.int64) if len(major) else np.zeros(0, np.int64)
    negative = major[rows, second] < 0
    yy, xx, zz = np.abs(major[rows, second]), major[rows, other], major[rows, big]
    s, r = yy / zz, xx / (yy + 1e-10)
    t = _SCALE * np.sqrt(np.maximum(1 - 1 / np.sqrt(1 + s * s), 0))
    ring = np.minimum(np.floor(RINGS * t).astype(np.int64), RINGS - 1)
    place = np.clip(np.floor(0.5 * (r + 1) * (2 * ring + 1)).astype(np.int64), 0, 2 * ring)
    cell = RINGS * RINGS * (2 * half + negative) + ring * ring + place
    p, q = minor[rows, _PLANE[big, 0]], minor[rows, _PLANE[big, 1]]
    sign = np.where(q < 0, -1, 1)
    turn = np.floor(TURNS * np.arctan2(q * sign, p * sign) / np.pi).astype(np.int64) % TURNS
    return cell * TURNS + turn


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Major and minor axes at the centres of the cells."""
    cell, turn = np.divmod(np.asarray(code, np.int64), TURNS)
    cap, inner = np.divmod(cell, RINGS * RINGS)
    ring = np.floor(np.sqrt(inner)).astype(np.int64)
    place = inner - ring * ring
    t = (ring + 0.5) / RINGS
    c = 1 - (t / _SCALE) ** 2
    s = np.sqrt(np.maximum(1 / (c * c) - 1, 0))
    r = 2 * (place + 0.5) / (2 * ring + 1) - 1
    rows = np.arange(len(cell))
    half, negative = np.divmod(cap, 2)
    order = _ORDER[half]
    major = np.zeros((len(cell), 3))
    major[rows, order[:, 2]], major[rows, order[:, 1]], major[rows, order[:, 0]] = 1, s * np.where(negative == 1, -1, 1), r * s
    major /= np.linalg.norm(major, axis=1, keepdims=True)
    big = order[:, 2]
    angle = (turn + 0.5) * np.pi / TURNS
    minor = np.zeros((len(cell), 3))
    p, q = _PLANE[big, 0], _PLANE[big, 1]
    minor[rows, p], minor[rows, q] = np.cos(angle), np.sin(angle)
    minor[rows, big] = -(major[rows, p] * minor[rows, p] + major[rows, q] * minor[rows, q]) / major[rows, big]
    return major, minor / np.linalg.norm(minor, axis=1, keepdims=True)


@F.pandas_udf(T.LongType())
def pack_triad(ax: pd.Series, ay: pd.Series, az: pd.Series, cx: pd.Series, cy: pd.Series, cz: pd.Series) -> pd.Series:
    return pd.Series(pack(np.stack([ax, ay, az], 1), np.stack([cx, cy, cz], 1)))


@F.pandas_udf(T.StructType([T.StructField(f"{n}{c}", T.DoubleType()) for n in "mn" for c in "xyz"]))
def unpack_triad(code: pd.Series) -> pd.DataFrame:
    major, minor = unpack(code.to_numpy())
    return pd.DataFrame({f"{n}{c}": v[:, i] for n, v in (("m", major), ("n", minor)) for i, c in enumerate("xyz")})
