"""Programs of several steps."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake.plans import halo_finding, stepping
from gravelake.sources.lattice import lattice
from gravelake.streaming import cones


def test_two_clumps(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 3)) * 0.003, np.array([0.499, 0.2, 0.2]) + rng.normal(size=(200, 3)) * 0.003, rng.random((500, 3)) - 0.5])
    x -= np.floor(x + 0.5)
    rows = [(i, *map(float, p), *map(float, rng.normal(size=3))) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, vx double, vy double, vz double")
    found = halo_finding.find_halos(df, 1000, halo_finding.Finding(min_np=1.0, min_l1=20, share_a=0.3, share_b=0.3))
    halos = found["halos"].collect()
    sizes = sorted(h.n for h in halos)
    assert len(sizes) == 2 and 150 <= sizes[0] <= 205 and 250 <= sizes[1] <= 305
    members = found["members"].collect()
    assert len({m.pid for m in members}) == len(members) == sum(sizes)
    for h in halos:
        assert h.l0_n >= h.n and len(h.l2_n) == 5 and h.ntaggedA <= h.npoutA
    assert {0, sorted(halos, key=lambda h: h.l1)[0].npoutA} == {h.npoutA_start for h in halos}
    taken = found["halo_particles"].count() + found["field_particles"].count()
    in_sample = df.filter(halo_finding.subsample(F.col("pid"), 0.3, 0.3).isNotNull()).count()
    assert taken == in_sample
    halo_finding.write_catalogue(found, str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat/halos")).count() == 2


def test_lattice_feels_nothing(spark, tmp_path):
    """Symmetric neighbours cancel; a moving lattice keeps every particle; finished steps are not run again."""
    p = lattice(spark, 6, (0.05, 0.0, 0.0)).withColumns({f"a{c}": F.lit(0.0) for c in "xyz"})
    path = str(tmp_path / "run")
    log = stepping.run_steps(p, path, 3, [(0.5, 0.5), (0.5, 0.5)], stepping.near_only(0.2, 0.01)).collect()
    assert [r.np for r in log] == [216, 216] and log[-1].max_acceleration < 1e-9
    last = spark.read.parquet(f"{path}/particles/step=1")
    assert last.select("pid").distinct().count() == 216
    assert stepping.steps_done(spark, path) == 2
    again = stepping.run_steps(p, path, 3, [(0.5, 0.5)] * 3, stepping.near_only(0.2, 0.01)).collect()
    assert [r.step for r in again] == [0, 1, 2]
    with pytest.raises(RuntimeError, match="crossed"):
        stepping.run_steps(lattice(spark, 4, (0.4, 0.0, 0.0)).withColumns({f"a{c}": F.lit(0.0) for c in "xyz"}), str(tmp_path / "late"), 8, [(0.0, 1.0)], lambda d: d)
    assert stepping.choose_step(0.1, {"dlna": 0.02, "output": 0.01, "drift": 0.5}) == (0.01, "output")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), 0, i % 40, 0, i // 20, 0.3, 0.1 * (i % 7), 0.2, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, lc int, pid long, image int, step int, px double, py double, pz double, w double")
    df.repartition(5).write.parquet(source)
    stream = cones.step_stream(spark, source, df.schema, 8)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    q = cones.write_by_step(cones.first_crossings(stream, "3 hours"), out, check)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("pid").distinct().count() == 40
    q = cones.write_by_step(cones.first_crossings(cones.step_stream(spark, source, df.schema, 8), "3 hours"), out, check)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 40  # nothing new, nothing twice
    batch = cones.shell_maps(df, 4)
    assert batch.agg(F.sum("n")).first()[0] == 100
    events = spark.createDataFrame([(t0 + dt.timedelta(minutes=7 * i), i % 3, "a", float(i)) for i in range(60)], "ts timestamp, user_id long, event_type string, value double")
    assert cones.event_windows(events).agg(F.sum("n")).first()[0] == 60
    assert cones.event_windows(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 120
    assert cones.event_sessions(events, "30 minutes").count() == 3
