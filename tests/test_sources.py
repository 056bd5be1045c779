"""Formats, headers, parameters, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake import params
from gravelake.sources import codecs, files
from gravelake.sources.lattice import lattice


def columns(n=500, seed=0):
    rng = np.random.default_rng(seed)
    out = {c: rng.random(n) - 0.5 for c in "xyz"} | {f"v{c}": rng.normal(size=n) * 0.01 for c in "xyz"}
    return out | {"pid": rng.integers(0, 1 << 40, n)}


@pytest.mark.parametrize("size", [9, 14])
def test_packed_round_trip(size):
    c = columns()
    got = codecs.packed(codecs.encode_packed(c, size, 11, 1), size)
    cell = np.clip(np.floor((np.stack([c[a] for a in "xyz"], 1) + 0.5) * 11), 0, 10)
    order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
    for a in "xyz":
        assert np.abs(got[a] - c[a][order]).max() < 1 / 11 / 2000
        assert np.abs(got[f"v{a}"] - c[f"v{a}"][order]).max() < 1 / 11 / 2000
    if size == 14:
        assert (got["pid"] == c["pid"][order]).all()
    with pytest.raises(ValueError):
        codecs.packed(b"\x01" * (size + 1), size)
    assert len(codecs.packed(b"", size)["x"]) == 0


def test_cell_record_bits():
    """One cell record, one particle, by hand."""
    fields = lambda *v: bytes(codecs._pack12(np.array([v]))[0])
    head = bytearray(fields(-2048, 5 - 2000, 1 - 2000, 2 - 2000, 3 - 2000, 4 - 2000))
    head[0] = 255
    got = codecs.packed(bytes(head) + fields(100, -200, 0, 1000, 0, -1000), 9)
    assert got["x"][0] == pytest.approx((100 / 2000 + 2.5) / 5 - 0.5) and got["y"][0] == pytest.approx((-200 / 2000 + 3.5) / 5 - 0.5)
    assert got["vx"][0] == pytest.approx(0.5 / 5) and got["vz"][0] == pytest.approx(-0.5 / 5)


def test_read_and_write(spark, tmp_path):
    c = columns(300)
    for i in range(3):
        part = {k: v[i * 100 : (i + 1) * 100] for k, v in c.items()}
        (tmp_path / f"a{i}.rvdoublepid").write_bytes(params.write_header({"NP": 100, "Name": "test"}) + codecs.encode_fixed(part, "rvdoublepid"))
    df = files.read(spark, str(tmp_path), "rvdoublepid", pattern="*.rvdoublepid", header=True)
    assert df.count() == 300 and df.select("file").distinct().count() == 3
    rows = df.orderBy("pid").toPandas()
    order = np.argsort(c["pid"])
    assert np.allclose(rows["x"], c["x"][order]) and (rows["pid"] == c["pid"][order]).all()
    narrow = files.read(spark, str(tmp_path / "a0.rvdoublepid"), "rvdoublepid", columns=["x", "vz", "z"], header=True, box=1.0, units=500.0, zspace=True)
    assert narrow.columns == ["x", "vz", "z", "file"] and narrow.agg(F.max("x")).first()[0] > 200
    heads = files.headers(spark, str(tmp_path / "*.rvdoublepid"))
    assert heads.filter("name = 'NP' and value = '100'").count() == 3
    assert files.checksums(spark, str(tmp_path / "*.rvdoublepid")).count() == 3
    own = files.read(spark, str(tmp_path / "a1.rvdoublepid"), lambda b: {"n": np.array([len(b)])}, schema="n bigint")
    assert own.first().n == 4096 + 100 * 56
    spark.dataSource.register(files.RecordFiles)
    out = tmp_path / "out"
    df.select("x", "y", "z", "vx", "vy", "vz", "pid").write.format("records").option("record", "rvdoublepid").mode("append").save(str(out))
    back = files.read(spark, str(out), "rvdoublepid", pattern="*.rvdoublepid")
    assert back.count() == 300 and back.agg(F.sum("pid")).first()[0] == int(c["pid"].sum())


def test_slabs(spark, tmp_path):
    assert files.by_slab(lattice(spark, 6), str(tmp_path / "slabs"), 3) == 216
    got = {r.slab: r["count"] for r in spark.read.parquet(str(tmp_path / "slabs")).groupBy("slab").count().collect()}
    assert got == {0: 72, 1: 72, 2: 72}


def test_headers():
    text = '# a comment\nNP = 512\nOmega = 0.3D0 1.5e2\nName = "a # b" \\\n  "c"\nFlag = true\n##\nhidden = 1\n##\nvector a b\n1 2.5\n3 4.5\n\nLast = x'
    got = params.parse_header(text, {"NP"})
    assert got == {"NP": 512, "Omega": [0.3, 150.0], "Name": ["a # b", "c"], "Flag": True, "a": [1, 3], "b": [2.5, 4.5], "Last": "x"}
    with pytest.raises(KeyError):
        params.parse_header("A = 1", {"B"})
    with pytest.raises(KeyError):
        params.parse_header("A = 1", known={"B"})
    packed = params.write_header({"NP": 3, "L": [1.5, 2.5], "S": "t"})
    assert len(packed) % 4096 == 0
    body, start = params.split_header(packed + b"data")
    assert params.parse_header(body) == {"NP": 3, "L": [1.5, 2.5], "S": "t"} and (packed + b"data")[start:] == b"data"


def test_parameters(tmp_path):
    (tmp_path / "base.par").write_text("NP = 64**3\nBox = 100.\n")
    text = '#include "base.par"\nSpacing = @Box@ / @Cells@\nCells = 2*4\nDir = "$ROOT$/x"\nList = (1, 2.5, "a")\nMaybe = "@_Absent@end"\nCopy = @List@\nWords = 0.1 0.2\n'
    got = params.parse_parameters(text, tmp_path, {"ROOT": "/r"})
    assert got["NP"] == 64**3 and got["Spacing"] == 12.5 and got["Dir"] == "/r/x" and got["List"] == [1, 2.5, "a"] and got["Maybe"] == "end" and got["Copy"] == [1, 2.5, "a"] and got["Words"] == [0.1, 0.2]
    assert params.parse_parameters('A = __import__("os").getcwd()')["A"].startswith("__import__")
    with pytest.raises(ValueError):
        params.parse_parameters("A = @B@\nB = @A@")


def test_products(spark, tmp_path):
    from gravelake.sources import products

    path = f"file://{tmp_path}/cat"
    df = spark.range(50).withColumn("x", F.col("id") * 0.5).repartition(3)
    df.write.parquet(path)
    manifest = products.checksums(spark, path).collect()
    schema = "name string, crc long, size long"
    known = spark.createDataFrame(manifest, schema)
    assert len(manifest) == 3 and products.verify(spark, path, known).count() == 0
    assert products.merged_manifest([known.limit(2), known]).count() == 3
    changed = spark.createDataFrame([(manifest[0].name, 1, 1), (manifest[1].name, manifest[1].crc, manifest[1].size), ("gone", 5, 5)], schema)
    assert {(r.name, r.fault) for r in products.verify(spark, path, changed).collect()} == {(manifest[0].name, "changed"), ("gone", "missing"), (manifest[2].name, "foreign")}
    with pytest.raises(ValueError):
        products.merged_manifest([known, changed])
    with pytest.raises(ValueError):
        products.check_kinds([df, df.select("id")])
    assert products.packed_column(["a", "pack9"]) == "pack9"
    for columns in (["a"], ["pid", "rvint"]):
        with pytest.raises(ValueError):
            products.packed_column(columns)
    assert not products.is_finished(spark, path)
    products.finish(spark, path)
    assert products.is_finished(spark, path)
    products.write_header(spark, f"{path}/header", {"Redshift": 0.5, "SimName": "a b"}, "Test")
    assert products.read_header(spark, f"{path}/header") == {"Redshift": 0.5, "SimName": "a b", "OutputType": "Test"}
    from gravelake.sources.lattice import lattice

    p = lattice(spark, 4).withColumns({"ax": F.lit(1.0), "ay": F.lit(0.0), "az": F.lit(0.0), "dens": F.lit(4.0), "aux": F.col("pid"), **{f"v{c}": F.lit(1.0) for c in "xyz"}})
    products.write_time_slice(p, f"{path}/slice", {"Redshift": 1.0}, 2, unkick=0.5)
    part = products.read_slice(spark, f"{path}/slice", ("vel",), groups="field", keep=F.col("y") < 0)
    assert part.columns == ["slab", "vx", "vy", "vz"] and part.count() == 32 and part.first().vx == 0.5
    assert "pid" not in part._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
