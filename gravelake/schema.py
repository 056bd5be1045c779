"""Schemas of particles, cells, halos, maps and catalogues: the one source of column types."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "longs": T.ArrayType(T.LongType())}
    return [T.StructField(n, kinds[k]) for n, k in (p.split(":") for p in spec.split())]


PARTICLES = T.StructType(_fields("pid:long x:double y:double z:double vx:float vy:float vz:float ax:float ay:float az:float dens:float aux:long aux2:int slab:int cj:int ck:int"))
CELLS = T.StructType(_fields("slab:int cj:int ck:int start:long start_with_ghost:long count:int active:int mean_square_velocity:float max_component_velocity:float max_component_acceleration:float"))
PIXELS = T.StructType(_fields("step:int lc:int pix:long is_halo:bool n:long w0:double w1:double w2:double"))
CONE_PARTICLES = T.StructType(_fields("step:int lc:int image_x:int image_y:int image_z:int pid:long x:double y:double z:double vx:double vy:double vz:double"))
EDGES = T.StructType(_fields("src:long dst:long"))
COMPONENTS = T.StructType(_fields("pid:long l0_id:long"))
ASSOCIATIONS = T.StructType(_fields("halo:long progenitors:longs main_prog:long main_frac:double is_split:bool"))
EPOCHS = T.StructType(_fields("z:double a:double t:double eta_k:double eta_d:double growth:double f:double h:double distance:double"))
HALOS = T.StructType(
    _fields("id:long npstartA:long npstartB:long npoutA:long npoutB:long ntaggedA:long ntaggedB:long N:long L0_N:long L2_N:longs")
    + _fields(" ".join(f"{n}_{c}:float" for n in ("x", "v") for c in ("x", "y", "z")))
    + _fields("r100:float r10:int r25:int r33:int r50:int r67:int r75:int r90:int r95:int r98:int sigma_r90:float sigma_radial:float sigma_tangential:float mean_speed:float sigma2_r50:float vmax:float r_vmax:float")
)
