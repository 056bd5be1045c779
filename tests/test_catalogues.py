"""Catalogue programs, sky maps, packed triads."""

import numpy as np
from pyspark.sql import functions as F

from gravelake.functions import triads
from gravelake.plans import catalogues, skymaps
from gravelake.sources import codecs
from gravelake.sources.lattice import lattice


def test_triads(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5000, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    c = np.cross(a, rng.normal(size=(5000, 3)))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    code = triads.pack(a, c)
    assert code.min() >= 0 and code.max() < 65340
    major, minor = triads.unpack(code)
    assert np.degrees(np.arccos(np.minimum(np.abs((major * a).sum(1)), 1))).max() < 8
    assert np.abs((major * minor).sum(1)).max() < 1e-9
    assert np.degrees(np.arccos(np.minimum(np.abs((minor * c).sum(1)), 1))).max() < 15
    assert (triads.pack(-a, -c) == code).mean() > 0.999
    df = spark.createDataFrame([tuple(map(float, (*x, *y))) for x, y in zip(a[:50], c[:50], strict=True)], "ax double, ay double, az double, cx double, cy double, cz double")
    got = [r.c for r in df.select(triads.pack_triad(*df.columns).alias("c")).collect()]
    assert got == code[:50].tolist()
    assert spark.createDataFrame([(int(code[0]),)], "c long").select(triads.unpack_triad("c").alias("t")).select("t.mx").first()[0] == major[0, 0]


def test_catalogues(spark, tmp_path):
    h = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 3), (1, 3, 0, 2), (2, 4, 0, 9)], "file int, id long, start long, n long")
    assert {r.id: r.start for r in catalogues.reindexed(h, {"start": "n"}).collect()} == {1: 0, 2: 5, 3: 8, 4: 10}
    p = lattice(spark, 6, (1.0, 0.0, 0.0))
    assert catalogues.unique_and_complete(p, 6).first().asDict() == {"missing": 0, "repeated": 0, "foreign": 0}
    broken = p.filter("pid != 0").union(p.limit(0)).union(p.filter("pid = 1"))
    assert catalogues.unique_and_complete(broken.withColumn("pid", F.when(F.col("pid") == 2, 999).otherwise(F.col("pid"))), 6).first().asDict() == {"missing": 2, "repeated": 1, "foreign": 1}
    assert catalogues.to_initial_conditions(p, str(tmp_path / "ic"), 3, 1.0, 500.0, 2.0, flip=True, contiguous=True) == 216
    back = spark.read.parquet(str(tmp_path / "ic"))
    assert back.agg(F.max("x")).first()[0] < 250 and back.first().vx == -2.0 and back.agg(F.max("pid")).first()[0] == 5 | 5 << 15 | 5 << 30
    t = catalogues.transposed(p.withColumn("slab", F.floor((F.col("x") + 0.5) * 3)))
    plain = np.arange(216).reshape(6, 6, 6)  # x, y, z
    for slab in range(3):
        want = np.moveaxis(plain[2 * slab : 2 * slab + 2], 2, 0).ravel()
        rows = sorted((r for r in t.collect() if r.slab == slab), key=lambda r: r.place)
        assert [(r.pid & 0x7FFF) * 36 + (r.pid >> 16 & 0x7FFF) * 6 + (r.pid >> 32) for r in rows] == want.tolist()
        assert all(r.x == (r.pid & 0x7FFF) / 6 - 0.5 for r in rows)  # coordinates stay
    assert dict(catalogues.to_single_precision(p).dtypes)["x"] == "float"
    zel = spark.createDataFrame([(1, 2, 3, 0.5, 0.0, -0.5)], "i long, j long, k long, x double, y double, z double")
    r = catalogues.zel_to_absolute(zel, 4, 8.0).first()
    assert (r.x, r.y, r.z, r.pid) == (-1.5, 0.0, 1.5, 1 | 2 << 16 | 3 << 32)
    cone = spark.createDataFrame([(1, 5), (2, 0)], "index long, interpolated_n long")
    assert catalogues.light_cone_lookup(cone, spark.createDataFrame([(1, 7.0), (2, 8.0)], "index long, mass double"), ["mass"]).collect()[0].mass_slice == 7.0
    for i in (3, 1):
        (tmp_path / f"halo_{i:03d}.txt").write_text(f"Step = {i}\nRedshift = 0.5\n")
    assert [r.number for r in catalogues.grouped_files(spark, str(tmp_path / "halo_*.txt"), r"(halo)_(\d+)").collect()] == [1, 3]
    assert sorted(r.Step for r in catalogues.state_rows(spark, str(tmp_path / "halo_*.txt")).collect()) == ["1", "3"]


def test_maps(spark, tmp_path):
    for step in (3, 4, 5):
        folder = tmp_path / f"Step{step:04d}"
        folder.mkdir()
        ids = np.array([1, 2, 2 | 1 << 31], np.uint32)
        (folder / "a.heal").write_bytes(codecs.encode_fixed({"id": ids, "n": np.array([1, 2, 3]), "w0": np.array([1.0, 4.0, 9.0])}, "heal1"))
    sparse = skymaps.read_step_maps(spark, str(tmp_path / "Step*/*"), 1, 3, 4)
    assert sparse.count() == 6
    full = {r.pix: (r.n, r.w0) for r in skymaps.shell_map(sparse, 1, ["w0"]).collect()}
    assert len(full) == 12 and full[1] == (2, 1.0) and full[2] == (10, 2.6) and full[0] == (0, 0.0)
    halo = {r.pix: r.n for r in skymaps.shell_map(sparse, 1, ["w0"], halo=True).filter("n > 0").collect()}
    assert halo == {2: 6}
    fine = skymaps.shell_map(sparse, 2, ["w0"], coarser_by=2)
    assert fine.count() == 12 and fine.agg(F.sum("n")).first()[0] == 12
    skymaps.write_map(skymaps.shell_map(sparse, 1, ["w0"]), str(tmp_path / "m"), 1, ["w0"], kind="density")
    about = spark.read.parquet(str(tmp_path / "m/about")).first()
    assert about.pixels == 12 and about.nside == 1 and about.kind == "density" and about.n == 1.0
