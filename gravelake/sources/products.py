"""Products of a run, written and read through Spark's own file access: time slices, light cones, superslabs, tables, checksums.

A product is a folder.  Its last file is a marker, written when everything else
is there; what reads a product can ask for it.  Header texts are tables of one
text column, written as plain text files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gravelake.functions import bits, packing
from gravelake.functions.geometry import slab as slab_of
from gravelake.params import parse_header

MARKER = "_FINISHED"
#: Which columns a reader must have for what it is asked for, by product.
CONTENTS = {"pos": ("x", "y", "z"), "vel": ("vx", "vy", "vz"), "pid": ("pid",), "aux": ("aux",)}
#: The particle columns of packed files, the first that a file has is read.
PACKED = ("rvint", "pack9", "packedpid", "pid")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_header(spark: SparkSession, path: str, values: dict[str, object], kind: str) -> None:
    """A header: ``name = value`` lines, texts in quotes, and the kind of output."""
    line = lambda k, v: f'{k} = "{v}"' if isinstance(v, str) else f"{k} = {v}"
    _write_text(spark, path, "\n".join(line(k, v) for k, v in {**values, "OutputType": kind}.items()) + "\n")


def read_header(spark: SparkSession, path: str) -> dict[str, object]:
    return parse_header(spark.read.text(path, wholetext=True).first()[0])


def finish(spark: SparkSession, path: str) -> None:
    _write_text(spark, f"{path}/{MARKER}", "done\n")


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether the product's marker is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def _by_slab(rows: DataFrame, path: str, parts: int = 8) -> None:
    """Files in folders by slab; a dense slab's rows are dealt to ``parts`` tasks by a hash of the identifier."""
    rows.repartition("slab", F.pmod(F.xxhash64("pid"), F.lit(parts))).sortWithinPartitions("slab", "pid").write.mode("overwrite").partitionBy("slab").parquet(path)


def write_time_slice(particles: DataFrame, path: str, state: dict[str, object], cpd: int, unkick: float = 0.0, density_unit: float = 1.0) -> None:
    """A snapshot: ``field`` has the particles outside large-scale groups, ``L0`` the others, each by slab.

    ``particles``: ``x y z vx vy vz ax ay az dens aux``.  Velocities lose the
    last half kick; the density goes compressed into the auxiliary word.
    """
    spark = particles.sparkSession
    velocity = {f"v{c}": F.col(f"v{c}") - F.col(f"a{c}") * unkick for c in "xyz"}
    rows = particles.withColumns({**velocity, "aux": bits.pack_density(F.col("aux"), F.col("dens"), density_unit), "slab": slab_of(F.col("x"), cpd)})
    rows = rows.select(*"xyz", "vx", "vy", "vz", "aux", bits.pid(F.col("aux")).alias("pid"), "slab")
    inside = bits.test_flag(F.col("aux"), "L0")
    for name, some in (("field", rows.filter(~inside)), ("L0", rows.filter(inside))):
        _by_slab(some, f"{path}/{name}")
        write_header(spark, f"{path}/{name}_header", state, f"{name}TimeSlice")
    finish(spark, path)


def write_light_cone(met: DataFrame, path: str, step: int, before: dict[str, object], after: dict[str, object], box: float = 1.0, nside: int = 64) -> None:
    """What cones met in a step, into ``path/Step%04d``: packed positions and velocities, identifiers, a sparse sky map, and the states before and after.

    ``met``: ``pid, px, py, pz, vx, vy, vz``; positions in units of ``box``, velocities in km/s.
    """
    from gravelake.functions.geometry import line_of_sight
    from gravelake.functions.healpix import nested_pixel

    spark, folder = met.sparkSession, f"{path}/Step{step:04d}"
    place = tuple(F.col(f"p{c}") for c in "xyz")
    packed = [packing.pack_rvint(F.col(f"p{c}") / box, F.col(f"v{c}")).alias(f"p{c}") for c in "xyz"]
    met.select("pid", *packed).write.mode("overwrite").parquet(f"{folder}/rvint")
    along = line_of_sight(place, tuple(F.col(f"v{c}") for c in "xyz"))
    sky = met.select(nested_pixel(*place, nside).alias("pix"), *[w.alias(f"w{i}") for i, w in enumerate(along)])
    sky.groupBy("pix").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(3)]).write.mode("overwrite").parquet(f"{folder}/heal")
    write_header(spark, f"{folder}/header_read", before | {"HealpixWeightScheme": "vel3"}, "LightCone")
    write_header(spark, f"{folder}/header_write", after | {"HealpixWeightScheme": "vel3"}, "LightCone")
    finish(spark, folder)


def write_superslabs(halos: DataFrame, particles: DataFrame, path: str, chunk: int) -> None:
    """Halos and their particles in superslabs of ``chunk`` slabs, with particle starts that count within a superslab.

    ``halos``: ``id, slab, npout`` and more; ``particles``: ``id, rank`` (the
    place inside the halo) and more.  Starts are sums over the halos before in
    one superslab; a superslab is one file's worth of halos.
    """
    superslab = F.expr(f"slab div {int(chunk)}").cast("int")
    own = Window.partitionBy("superslab").orderBy("slab", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = halos.withColumn("superslab", superslab).withColumn("npstart", F.coalesce(F.sum("npout").over(own), F.lit(0)).cast("long"))
    placed.repartition("superslab").sortWithinPartitions("superslab", "slab", "id").write.mode("overwrite").partitionBy("superslab").parquet(f"{path}/halo_info")
    info = halos.sparkSession.read.parquet(f"{path}/halo_info").select("id", "superslab", "npstart")
    rows = particles.join(info, "id").withColumn("place", (F.col("npstart") + F.col("rank")).cast("long")).drop("npstart", "rank")
    rows.repartition("superslab", F.expr("place div 1048576")).sortWithinPartitions("superslab", "place").write.mode("overwrite").partitionBy("superslab").parquet(f"{path}/particles")
    finish(halos.sparkSession, path)


def concatenated(parts: list[DataFrame], path: str, order: list[str]) -> DataFrame:
    """Files of one kind put together, in order, and read back; their columns must agree."""
    check_kinds(parts)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    finish(parts[0].sparkSession, path)
    return parts[0].sparkSession.read.parquet(path)


def check_kinds(parts: list[DataFrame]) -> None:
    """An error unless all tables have the same columns of the same types."""
    kinds = {tuple(sorted(p.dtypes)) for p in parts}
    if len(kinds) != 1:
        raise ValueError(f"tables of {len(kinds)} kinds: {sorted(kinds)}")


def packed_column(columns: list[str]) -> str:
    """Which packed column a table has: exactly one of ``PACKED``."""
    found = [c for c in PACKED if c in columns]
    if len(found) != 1:
        raise ValueError(f"a file must have one of {PACKED}; it has {found}")
    return found[0]


def read_slice(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("pos",), groups: str = "both", keep: Column | None = None, key: Callable[[str], object] | None = None) -> DataFrame:
    """A time slice's particles: only the folders and columns that are asked for are read.

    ``wanted``: of ``CONTENTS``; ``groups``: ``field``, ``L0`` or ``both``;
    ``keep``: a filter on the rows; ``key``: the order of the folders, for
    sources where it matters.
    """
    folders = sorted(["field", "L0"] if groups == "both" else [groups], key=key)
    columns = [c for w in wanted for c in CONTENTS[w]]
    out = None
    for f in folders:
        rows = spark.read.parquet(f"{path}/{f}")
        rows = (rows if keep is None else rows.filter(keep)).select("slab", *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def write_table(table: DataFrame, path: str, order: str, notes: dict[str, object]) -> None:
    """A spectrum or pair-count table (one row for each bin, some thousands at most) as CSV, with its notes in a header beside it."""
    table.coalesce(1).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)
    write_header(table.sparkSession, f"{path}_header", notes, "Table")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def spectrum_table(binned: DataFrame, edges: list[float]) -> DataFrame:
    """``kmin, kmax, kavg, power[, P2, ..], N_modes`` from binned modes."""
    bins = binned.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, kmin double, kmax double")
    more = [F.col(c).alias(f"P{c[1:]}") for c in binned.columns if c.startswith("p") and c != "p0"]
    return bins.join(binned, "bin").select("kmin", "kmax", F.col("k_mean").alias("kavg"), F.col("p0").alias("power"), *more, F.col("n_modes").alias("N_modes"))


def checksums(spark: SparkSession, path: str, pattern: str = "*.parquet", root: str | None = None) -> DataFrame:
    """``name, crc, size`` of all files below a folder, in the JVM; names are paths below ``root`` (the folder itself)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    top = re.escape((root or path).rstrip("/").rsplit("/", 1)[-1])
    return files.select(F.regexp_replace("path", f"^.*?/{top}/", "").alias("name"), F.crc32("content").alias("crc"), F.col("length").alias("size"))


def verify(spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """Files that are missing, foreign or changed against a manifest; none if all is well."""
    now = checksums(spark, path, pattern).withColumnsRenamed({"crc": "crc_now", "size": "size_now"})
    both = manifest.join(now, "name", "full")
    fault = F.when(F.col("crc_now").isNull(), "missing").when(F.col("crc").isNull(), "foreign").when((F.col("crc") != F.col("crc_now")) | (F.col("size") != F.col("size_now")), "changed")
    return both.select("name", fault.alias("fault")).filter("fault is not null")


def merged_manifest(parts: list[DataFrame]) -> DataFrame:
    """Manifests of several writers as one, by name; an error if two disagree about a file."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("name").agg(F.count_distinct("crc", "size").alias("kinds"), F.first("crc").alias("crc"), F.first("size").alias("size"))
    if not one.filter("kinds > 1").isEmpty():
        raise ValueError("manifests disagree about a file")
    return one.drop("kinds").orderBy("name")
