"""Operators against brute force, invariants and analytic cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake.functions import bits, cosmology, geometry, healpix, packing, sampling
from gravelake.operators import graph, halos, lightcone, maps, merging, neighbours, ordered, phase_space, power
from gravelake.plans import queries
from gravelake.plans.views import halos as view_halos
from gravelake.sources.lattice import lattice, plane_wave


def points(spark, n, seed=1, clumps=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)) - 0.5
    for i in range(clumps):
        centre = rng.random(3) - 0.5
        x[i * 60 : (i + 1) * 60] = centre + rng.normal(size=(60, 3)) * 0.004
    x -= np.floor(x + 0.5)
    v = rng.normal(size=(n, 3))
    rows = [(i, *map(float, x[i]), *map(float, v[i])) for i in range(n)]
    return x, v, spark.createDataFrame(rows, "pid long, x double, y double, z double, vx double, vy double, vz double").cache()


def periodic(x):
    d = x[:, None] - x[None]
    d -= np.rint(d)
    return (d**2).sum(2)


@pytest.mark.parametrize("radius", [0.02, 0.12, 0.3, 0.45, 0.7])
def test_pairs(spark, radius):
    x, _, df = points(spark, 250)
    d2 = periodic(x)
    want = {(i, j) for i in range(250) for j in range(i + 1, 250) if d2[i, j] < radius**2}
    got = [(r.a, r.b) for r in neighbours.self_pairs(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    both = neighbours.pairs_within(df.select("pid", "x", "y", "z"), df.select("pid", "x", "y", "z"), radius).filter("pid != r_pid")
    assert both.count() == 2 * len(want)


def held(x, r):
    """Pairs (i, j) with i within the larger radius of j, without cells or a reach."""
    pairs = set()
    for at in range(0, len(x), 200):
        d = x[at : at + 200, None] - x[None]
        d -= np.rint(d)
        i, j = np.nonzero(((d**2).sum(2) < r[None] ** 2) & (r[None] > r[at : at + 200, None]))
        pairs |= {(int(a) + at, int(b)) for a, b in zip(i, j, strict=True)}
    return pairs


def test_containing(spark):
    """Radii over all levels, among them none, one below the finest cells and one of more than the box."""
    x, _, df = points(spark, 400, 4, clumps=3)
    r = np.exp(np.random.default_rng(5).uniform(np.log(0.002), np.log(0.4), 400))
    r[:6] = 0, -1, 1e-8, 0.5, 1.5, 1 / 3
    df = df.select("pid", "x", "y", "z").join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "pid long, r double"), "pid")
    got = [(p.pid, p.r_pid) for p in neighbours.containing(df).collect()]
    want = held(x, r)
    assert len(got) == len(set(got)) and set(got) == want and want
    assert neighbours.containing(df.limit(0)).count() == 0


def test_parents_have_no_reach(spark):
    """All containments of the halo table, which has radii above 0.016, against brute force."""
    sf_dir = "/root/testdata/sf0.01"
    h = view_halos(spark, sf_dir).select("id", "x", "y", "z", "r", "vmax").toPandas()
    want = {}
    for i, j in held(h[["x", "y", "z"]].to_numpy(), h.r.to_numpy()):
        want.setdefault(int(h.id[i]), []).append((h.vmax[j], int(h.id[j])))
    got = {p.id: (p.parent, p.containers) for p in queries.parents(spark, sf_dir).collect()}
    assert h.r.max() > 0.016 and got
    assert got == {i: (min(v)[1], len(v)) for i, v in want.items()}


def test_density_force_and_knn(spark):
    x, _, df = points(spark, 300)
    d2, b = periodic(x), 0.15
    near = (d2 < b * b) & ~np.eye(300, dtype=bool)
    want = np.where(near, b * b - d2, 0).sum(1)
    got = {r.pid: r.density for r in neighbours.kernel_density(df, b).collect()}
    assert np.allclose([got[i] for i in range(300)], want)
    dx = x[:, None] - x[None]
    dx -= np.rint(dx)
    for kernel, f in (("plummer", lambda q: (q + 0.01) ** -1.5), ("cubic_plummer", lambda q: 1 / (q**1.5 + 0.001))):
        acc = -(np.where(near, f(d2), 0)[:, :, None] * dx).sum(1)
        rows = {r.pid: (r.ax, r.ay, r.az) for r in neighbours.near_force(df, df, b, 0.1, kernel).collect()}
        assert np.allclose([rows[i] for i in range(300)], acc)
    k = neighbours.nearest(df.select("pid", "x", "y", "z"), df.select("pid", "x", "y", "z"), 5, b, "pid", "pid")
    for r in k.groupBy("pid").agg(F.collect_set("r_pid").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        order = np.argsort(d2[r.pid], kind="stable")[: int(r.n)]
        assert set(r.s) == set(order.tolist())


def test_components_and_chase(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    rows = [(0, -1, 5), (1, 0, 3), (2, 1, 9), (3, 4, 1), (4, 5, 7), (5, 3, 7), (6, 3, 2), (7, -1, 1)]
    got = {r.k: r.t for r in graph.chase(spark.createDataFrame(rows, "k long, t long, s long"), "k", "t", "s").collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 4, 4: None, 5: 4, 6: 4, 7: None}


def test_lattice_invariants(spark):
    p = lattice(spark, 8)
    want = {x | y << 16 | z << 32 for x in range(8) for y in range(8) for z in range(8)}
    assert {r.pid for r in p.collect()} == want
    moved = p.withColumns({c: geometry.cell(F.col(c) + 0.3 / 8, 4) for c in "xyz"}).groupBy("x", "y", "z").count()
    assert {r["count"] for r in moved.collect()} == {8}
    w = plane_wave(spark, 8, 0.01).agg(F.sum("vx").alias("s"), F.max("vx").alias("m")).first()
    assert abs(w.s) < 1e-9 and w.m == pytest.approx(0.01)


def test_words(spark):
    df = spark.createDataFrame([(7, 123, 30000, 5.5, 0.123456, -321.0)], "a long, b long, c long, d double, x double, v double")
    pid = bits.make_pid(F.col("a"), F.col("b"), F.col("c"))
    r = df.select(bits.spread(bits.contiguous(pid)).alias("s"), pid.alias("p"), bits.unpack_density(bits.pack_density(pid, F.col("d") * 1000, 1.0), 1.0).alias("d"), packing.unpack_rvint_position(packing.pack_rvint(F.col("x"), F.col("v"))).alias("x"), packing.unpack_rvint_velocity(packing.pack_rvint(F.col("x"), F.col("v"))).alias("v"), packing.unpack_short_velocity(packing.pack_short_velocity(F.col("v"), 1000.0), 1000.0).alias("w"), packing.truncate_mantissa(F.col("x"), 30).alias("t"), sampling.murmur(F.lit(12345)).alias("h")).first()
    assert r.s == r.p == 7 | 123 << 16 | 30000 << 32
    assert r.d == pytest.approx(5500, rel=0.02) and abs(r.x - 0.123456) < 1e-6 and abs(r.v + 321) < 3 and abs(r.w + 321) < 0.05
    assert r.t == np.array([np.array([0.123456]).view(np.uint64)[0] >> 30 << 30], np.uint64).view(float)[0]
    assert r.h == murmur3((12345).to_bytes(8, "little"), 0xBEEF)


def murmur3(data, seed):
    m = 0xFFFFFFFF
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_sky(spark):
    """Equal areas, and neighbours nest: four children for each parent."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "x double, y double, z double")
    fine = df.select(healpix.nested_pixel(F.col("x"), F.col("y"), F.col("z"), 8).alias("f"), healpix.nested_pixel(F.col("x"), F.col("y"), F.col("z"), 4).alias("c"))
    assert fine.filter(healpix.coarser(F.col("f"), 2) != F.col("c")).count() == 0
    counts = np.array([r["count"] for r in fine.groupBy("c").count().collect()])
    assert len(counts) == 192 and abs(counts - 40000 / 192).max() < 6 * math.sqrt(40000 / 192)


def test_eigenvalues(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 3, 3))
    a = a + a.transpose(0, 2, 1)
    df = spark.createDataFrame([(float(m[0, 0]), float(m[1, 1]), float(m[2, 2]), float(m[0, 1]), float(m[0, 2]), float(m[1, 2])) for m in a], "xx double, yy double, zz double, xy double, xz double, yz double")
    got = np.array([list(r) for r in df.select(*geometry.symmetric_eigenvalues(*[F.col(c) for c in df.columns])).collect()])
    assert np.allclose(got, np.linalg.eigvalsh(a)[:, ::-1], atol=1e-9)


def test_tsc_conserves_mass(spark):
    _, _, df = points(spark, 500)
    g = maps.tsc_grid(df, 8)
    assert g.agg(F.sum("mass")).first()[0] == pytest.approx(500) and g.filter("mass < 0").count() == 0
    even = maps.tsc_grid(lattice(spark, 8), 8)
    assert {round(r.mass, 9) for r in even.collect()} == {1.0}


def test_power_of_a_wave(spark):
    """A displaced lattice has its power in the mode of the displacement, of the amplitude of linear theory."""
    amplitude, n = 0.002, 16
    modes = power.modes(maps.tsc_grid(plane_wave(spark, n, amplitude), n), n, window=True)
    top = modes.orderBy(F.desc("power")).first()
    assert (abs(top.kx), top.ky, top.kz) == (1, 0, 0)
    assert top.power == pytest.approx((amplitude * 2 * math.pi / 2) ** 2, rel=0.1)
    spectrum = power.power_spectrum(plane_wave(spark, n, amplitude), n, ells=(0, 2)).collect()
    assert sum(r.n_modes for r in spectrum) > 1000
    x, _, df = points(spark, 2000)
    shot = power.power_spectrum(df, 16).filter("bin > 0").agg(F.avg("p0")).first()[0]
    assert shot == pytest.approx(1 / 2000, rel=0.15)
    g = maps.tsc_grid(df, 16)
    xi = power.correlation(g, 16, [0.0, 0.01, 0.2, 0.4]).collect()
    assert sum(r.n for r in xi) > 500
    same = power.modes(g, 16, other=g).join(power.modes(g, 16).withColumnRenamed("power", "p"), ["kx", "ky", "kz"]).filter("abs(power - p) > 1e-12").count()
    assert same == 0
    m = power.modes(g, 16)
    t = power.transfer_multipoles(m, m.withColumn("power", F.col("power") * 3), [0.0, 25.0, 50.0], 1.0).collect()
    assert all(r.t0 == pytest.approx(3) and abs(r.t2) < 1e-6 for r in t)


def test_greedy_spheres():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(400, 3)) * 0.002, np.array([0.03, 0, 0]) + rng.normal(size=(200, 3)) * 0.0015
    x = np.vstack([a, b])
    density = np.exp(-(a**2).sum(1) / 1e-5), 0.9 * np.exp(-((b - [0.03, 0, 0]) ** 2).sum(1) / 1e-5)
    halo = halos.greedy_spheres(x, np.concatenate(density), 1e5, 200.0, 0.005, min_np=1e-4)
    first, second = halo[:400], halo[400:]
    assert (first == 0).mean() > 0.8 and (second == 1).mean() > 0.8
    alone = halos.greedy_spheres(np.zeros((1, 3)), np.ones(1), 1e5, 200.0, 0.005)
    assert alone.tolist() == [0]


def test_halo_statistics(spark):
    x, v, df = points(spark, 400, clumps=0)
    df = df.withColumn("grp", F.col("pid") % 3)
    for r in halos.halo_statistics(df, "grp").collect():
        own = np.arange(400) % 3 == r.grp
        d2 = ((x[own] - x[own].mean(0)) ** 2).sum(1)
        v2 = ((v[own] - v[own].mean(0)) ** 2).sum(1)
        s = np.sort(d2)
        n = own.sum()
        assert r.r100 == pytest.approx(math.sqrt(s[-1]))
        assert r.r33 == round(math.sqrt(s[n // 3] / s[-1]) * 32000) and r.r98 == round(math.sqrt(s[n * 49 // 50] / s[-1]) * 32000)
        assert r.sigma_r90 == pytest.approx(math.sqrt(v2[d2 < s[n * 9 // 10]].sum() / (n * 9 // 10)))


def test_prefix_offsets(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(1000)]
    rng.shuffle(rows)
    got = {r.id: r.n_start for r in ordered.prefix_offsets(spark.createDataFrame(rows, "id long, n long"), ["id"], ["n"]).collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n


def test_merging(spark):
    near = spark.createDataFrame([(1, 10, 0.5), (1, 11, 1.5), (1, 12, 2.0), (2, 12, 0.1)], "halo long, prog long, dist double")
    later = spark.createDataFrame([(1, p, 1.0 + (p >= 105)) for p in range(100, 110)] + [(2, p, 1.0) for p in range(200, 206)], "halo long, pid long, rho double")
    earlier = spark.createDataFrame([(10, p) for p in range(100, 105)] + [(11, p) for p in range(105, 109)] + [(12, 109), (12, 200), (12, 201)], "prog long, pid long")
    shared = merging.associations(earlier, later, near)
    got = {r.halo: (r.main_prog, r.n_prog) for r in merging.claimed_progenitors(shared).collect()}
    assert got == {1: (11, 2), 2: (12, 1)}  # the third candidate of halo 1 finds one particle left
    sizes = spark.createDataFrame([(10, 5), (11, 20), (12, 3)], "prog long, n_tagged long")
    lists = {r.halo: r for r in merging.progenitor_lists(shared, sizes).collect()}
    assert lists[1].progenitors == [10] and lists[1].is_split and lists[2].progenitors == [12] and not lists[2].is_split
    every = merging.with_sentinels(merging.progenitor_lists(shared, sizes), spark.createDataFrame([(1,), (2,), (3,)], "halo long")).collect()
    assert {r.halo: (r.main_prog, r.progenitors) for r in every}[3] == (-999, [0])
    snaps = [spark.createDataFrame(rows, "id long, n long, main_prog long") for rows in ([(1, 40, 5), (2, 90, 6)], [(5, 100, 8), (6, 80, -999)], [(8, 60, -999)])]
    branches = merging.main_branches(snaps)
    peak = {(r.branch, r.snap): r.peak_n for r in branches.collect()}
    assert peak == {(1, 2): 60, (1, 1): 100, (1, 0): 100, (2, 1): 80, (2, 0): 90}
    cleaned = merging.needs_cleaning(branches)
    assert [r.branch for r in cleaned.collect()] == [1]
    rules = spark.createDataFrame([(1, 5, 8, 99), (2, 6, 9, 99), (3, 7, 7, 50), (4, 4, 4, 10**6)], "id long, id_peak long, main_prog long, lost long")
    around = spark.createDataFrame([(i, o, k) for i, os in {1: (1, 20, 21), 2: (2, 22, 23, 24), 3: (3, 25, 23), 4: (4, 20)}.items() for k, o in enumerate(os, 1)], "id long, other long, place int")
    known = spark.createDataFrame([(1, 10, 5, [8]), (2, 95, 6, [9]), (3, 1, 7, [7]), (4, 1, 4, [4]), (20, 90, 5, [0]), (21, 91, 5, [0]), (22, 90, 0, [1]), (23, 80, 0, [9]), (24, 94, 0, [9]), (25, 70, 0, [0])], "other long, mass long, other_peak long, progenitors array<long>")
    # 1: the heavier of two with its peak; 2: itself is heaviest there, then the first that lists its progenitor; 3: the most massive neighbour; 4: none.
    assert {r.id: r.target for r in merging.merge_targets(rules, around, known).collect()} == {1: 21, 2: 23, 3: 23}
    assert merging.eligible(spark.createDataFrame([(50, 5), (49, 9), (99, 4)], "n long, n_tagged long")).count() == 1
    put = merging.merged_particles(spark.createDataFrame([(1, 0, 5), (2, 5, 3)], "halo long, start long, count long"), spark.createDataFrame([(9, 1), (9, 2)], "host long, halo long"))
    assert sorted((r.halo, r.new_start) for r in put.collect()) == [(1, 0), (2, 5)]


def test_groups_over_batches(spark):
    """Groups of one to thirty rows in batches of four: each is seen whole, once."""
    import pandas as pd

    rng = random.Random(2)
    rows = [(g, i) for g in range(60) for i in range(rng.choice([1, 2, 3, 4, 5, 30]))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        one = lambda pdf: pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)], "total": [int(pdf["i"].sum())]})
        got = halos.by_groups(spark.createDataFrame(rows, "g long, i long"), "g", "i", one, "g long, n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = {g: sum(r[0] == g for r in rows) for g in range(60)}
    assert sorted((r.g, r.n, r.total) for r in got) == [(g, n, n * (n - 1) // 2) for g, n in sizes.items()]


def test_greedy_shells(spark):
    fold = lambda widths, target: [r.g for r in ordered.carried_groups(spark.createDataFrame([(i, float(w)) for i, w in enumerate(widths)], "i long, w double"), "i", "w", target, "g").orderBy("i").collect()]
    assert fold([1, 2, 1, 2], 2.0) == [0, 0, 1, 2]
    assert fold([1, 10, 1, 1], 3.0) == [0, 1, 2, 3]
    assert fold([], 3.0) == []


def test_eigensystem(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(50, 3, 3))
    m = m + m.transpose(0, 2, 1)
    names = {"xx": (0, 0), "yy": (1, 1), "zz": (2, 2), "xy": (0, 1), "xz": (0, 2), "yz": (1, 2)}
    df = spark.createDataFrame([(i, *(float(a[p]) for p in names.values())) for i, a in enumerate(m)] + [(50, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0)], "i long, " + ", ".join(f"{n} double" for n in names))
    for r in geometry.eigensystem(df).collect():
        if r.i == 50:
            assert [r.e1, r.e2, r.e3, r.v11, r.v22, r.v33] == [2, 2, 2, 1, 1, 1]
            continue
        w, v = np.linalg.eigh(m[r.i])
        assert np.allclose([r.e3, r.e2, r.e1], w)
        for k in (1, 2, 3):
            assert abs(np.dot([r[f"v{k}{c}"] for c in (1, 2, 3)], v[:, 3 - k])) == pytest.approx(1, abs=1e-6)


def test_light_cone(spark):
    df = spark.createDataFrame([(1, 0.42, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0), (3, 0.46, 0.0, 0.0, -0.02, 0.0, 0.0)], "pid long, x double, y double, z double, wx double, wy double, wz double")
    got = {r.pid: (r.frac, r.px) for r in lightcone.crossings(df, 0.45, 0.40).collect()}
    assert set(got) == {1} and got[1][0] == pytest.approx(0.6)
    assert lightcone.images(df, 1).count() == 81
    cells = spark.createDataFrame([(i, j, k) for i in range(5) for j in range(5) for k in range(5)], "ci int, cj int, ck int")
    assert 0 < lightcone.cells_in_shell(cells, 5, 0.45, 0.40, 0.05).count() < 125


def test_phase_space(spark):
    x, v, df = points(spark, 120)
    df = df.withColumn("grp", (F.col("pid") % 2).cast("long"))
    links = phase_space.phase_space_links(df, "grp", 1.0)
    want = set()
    for g in (0, 1):
        own = np.flatnonzero(np.arange(120) % 2 == g)
        s = np.hstack([x[own] / math.sqrt(x[own].var(0).sum() / 3), v[own] / math.sqrt(v[own].var(0).sum() / 3)])
        d2 = ((s[:, None] - s[None]) ** 2).sum(2)
        want |= {(int(own[i]), int(own[j])) for i in range(len(own)) for j in range(i + 1, len(own)) if d2[i, j] < 1}
    assert {(r.a, r.b) for r in links.collect()} == want
    b = {r.grp: r for r in phase_space.basic_properties(df, "grp").collect()}
    assert b[0].r == pytest.approx(math.sqrt(x[::2].var(0).sum()))
    j = {r.grp: r for r in phase_space.angular_momentum(df, "grp").collect()}
    full = np.cross(x[::2] - x[::2].mean(0), v[::2] - v[::2].mean(0)).sum(0)
    assert np.allclose([j[0].jx, j[0].jy, j[0].jz], full)
    pot = {r.pid: r.potential for r in phase_space.grouped_potential(df, "grp").collect()}
    d = np.sqrt(((x[::2][:, None] - x[::2][None]) ** 2).sum(2) + 1e-12)
    np.fill_diagonal(d, np.inf)
    assert np.allclose([pot[i] for i in range(0, 120, 2)], (1 / d).sum(1))
    rng = np.random.default_rng(1)
    e = rng.normal(size=(3000, 3)) * [3, 2, 1]
    s = phase_space.shapes(spark.createDataFrame([(1, *map(float, r)) for r in e], "g long, x double, y double, z double"), "g").first()
    assert s.b_to_a == pytest.approx(2 / 3, abs=0.1) and s.c_to_a == pytest.approx(1 / 3, abs=0.1) and abs(s.ax) > 0.95
    c = np.exp(np.linspace(0, math.log(12), 4000))
    radius = np.interp(rng.random(4000) * (math.log(11) - 10 / 11), np.log1p(c - 1) - (c - 1) / c, c - 1)
    ball = rng.normal(size=(4000, 3))
    ball *= (radius / np.sqrt((ball**2).sum(1)))[:, None]
    nfw = phase_space.nfw_scale(spark.createDataFrame([(1, *map(float, r)) for r in ball], "g long, x double, y double, z double"), "g").first()
    assert nfw.rs == pytest.approx(1.0, rel=0.35)
    tree = spark.createDataFrame([(1, None, 5), (2, 1, 3), (3, 2, 1), (4, 1, 2)], "id long, parent long, n long")
    assert {r.id: r.total for r in phase_space.child_totals(tree).collect()} == {1: 11, 2: 4, 3: 1, 4: 2}
    so = phase_space.overdensity_masses(df, "grp", 60.0, {"m1": 1.0, "m50": 50.0}).collect()
    assert all(r.m1 is None or 0 < r.m1 <= 60 for r in so)


def test_child_totals_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(75)], "id long, parent long, n long")
    assert {r.id: r.total for r in phase_space.child_totals(chain).collect()} == {i: 75 - i for i in range(75)}
    with pytest.raises(ValueError):
        phase_space.child_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "id long, parent long, n long"))


def test_cosmology(spark):
    flat = cosmology.Cosmology(0.3, 0.7)
    eds = cosmology.Cosmology(1.0, 0.0)
    h = eds.history()
    assert h["t"][-1] == pytest.approx(2 / 3, rel=1e-6) and h["growth"][-1] == pytest.approx(1, rel=1e-4) and h["f"][-1] == pytest.approx(1, rel=1e-4)
    assert flat.history()["t"][-1] == pytest.approx(0.9641, abs=2e-4)
    assert flat.history()["growth"][-1] == pytest.approx(0.7789, abs=2e-3)
    assert eds.comoving_distance(3.0)[0] == pytest.approx(2 * 2997.92458 * 0.5, rel=1e-6)
    z = flat.redshift_at(flat.comoving_distance([0.5, 2.0]))
    assert np.allclose(z, [0.5, 2.0], rtol=1e-4)
    assert flat.virial_density(0.0) == pytest.approx(337, abs=3) and eds.virial_density(1.0) == pytest.approx(18 * np.pi**2)
    table = cosmology.epochs(spark, flat, [0.0, 0.5, 1.0]).collect()
    assert [r.z for r in table] == [0.0, 0.5, 1.0] and table[0].eta_k > table[1].eta_k
    assert flat.drift_factor(0.5, 0.6) > flat.kick_factor(0.5, 0.6) > 0
