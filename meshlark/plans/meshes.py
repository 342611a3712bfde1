"""Queries over meshes and boxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import geometry
from meshlark.plans.bindings import r6
from meshlark.plans.dynamics import BOX_SQL, _boxes
from meshlark.plans.files import MESH_SQL, box_mesh
from meshlark.plans.registry import query

POINTS = [f"{a}{k}" for k in (1, 2, 3) for a in "xyz"]
_ROUNDED = ", ".join(f"round({c},6)+0.0 AS {c}" for c in POINTS)


def _points(mesh: DataFrame, *keys: str) -> DataFrame:
    return mesh.select(*keys, *[(r6(c) + 0.0).alias(c) for c in POINTS])


def _axis(spark: SparkSession, n: int, index: str, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(index), (F.col("id") + 0.5).alias(name))


_INSIDE = f"""
SELECT i, j, k FROM (SELECT i, j, k, (SELECT max(z1) FROM ({BOX_SQL}) b WHERE i+0.5 BETWEEN x0 AND x1 AND j+0.5 BETWEEN y0 AND y1) AS roof
  FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(5)) AS k)) WHERE k+0.5<=roof
"""


@query(_INSIDE)
def solid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose centre is not above the highest surface over it."""
    return geometry.solid_cells(box_mesh(spark), _axis(spark, 5, "i", "x"), _axis(spark, 4, "j", "y"), _axis(spark, 5, "k", "z"))


@query(f"SELECT i+1 AS i, j+1 AS j, min(k)+1 AS ks, max(k)+1 AS ke FROM ({_INSIDE}) GROUP BY ALL")
def solid_runs(spark: SparkSession, d: str) -> DataFrame:
    return geometry.solid_runs(box_mesh(spark), _axis(spark, 5, "i", "x"), _axis(spark, 4, "j", "y"), _axis(spark, 5, "k", "z"))


@query(f"SELECT id, {_ROUNDED} FROM ({MESH_SQL}) WHERE (x1+x2+x3)/3 BETWEEN 0.5 AND 4.0 AND (y1+y2+y3)/3 BETWEEN 0.5 AND 2.5")
def cropped_mesh(spark: SparkSession, d: str) -> DataFrame:
    return _points(geometry.crop(box_mesh(spark), (0.5, 0.5), (4.0, 2.5)), "id")


_LOW = ", ".join([c if c[0] != "z" else f"{c}-1.0 AS {c}" for c in POINTS])


@query(f"SELECT id, {', '.join(c if c[0] != 'z' else f'greatest({c},0.0) AS {c}' for c in POINTS)} FROM (SELECT id, {_LOW} FROM ({MESH_SQL})) WHERE greatest(z1, z2, z3)>=0")
def seated_mesh(spark: SparkSession, d: str) -> DataFrame:
    low = box_mesh(spark).withColumns({f"z{k}": F.col(f"z{k}") - 1.0 for k in (1, 2, 3)})
    return _points(geometry.seat_floor(low), "id")


def _turned_sql(source: str, degrees: float, *carry: str) -> str:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turned = ", ".join(f"cx+{c}*(x{k}-cx)-{s}*(y{k}-cy) AS x{k}, cy+{s}*(x{k}-cx)+{c}*(y{k}-cy) AS y{k}, z{k}" for k in (1, 2, 3))
    middle = "SELECT " + ", ".join(f"(min(least({a}1,{a}2,{a}3))+max(greatest({a}1,{a}2,{a}3)))/2 AS c{a}" for a in "xy")
    return f"SELECT {', '.join([*carry, turned])} FROM ({source}) m, ({middle} FROM ({source}))"


@query(f"SELECT id, {_ROUNDED} FROM ({_turned_sql(MESH_SQL, 30.0, 'id')})")
def rotated_mesh(spark: SparkSession, d: str) -> DataFrame:
    return _points(geometry.rotate(box_mesh(spark), 30.0), "id")


@query(f"SELECT DISTINCT {', '.join(POINTS)} FROM ({MESH_SQL})")
def cleaned_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Nearly equal corners welded, flat and repeated triangles gone."""
    mesh = box_mesh(spark)
    flat = mesh.withColumns({f"{a}3": F.col(f"{a}2") for a in "xyz"})
    near = mesh.withColumns({c: F.col(c) + 1e-12 for c in POINTS})
    welded = geometry.clean(geometry.weld(mesh.unionByName(flat).unionByName(near)))
    return _points(welded)


@query(f"SELECT id, {', '.join(POINTS)} FROM ({MESH_SQL})")
def rewound_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose triangles are wound the wrong way round, turned outward again."""
    middles = _boxes(spark).select("box", *[((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(f"m{a}") for a in "xyz"])
    flipped = box_mesh(spark).withColumn("box", F.floor(F.col("id") / 12)).withColumns({f"{a}{k}": F.col(f"{a}{5 - k}") for a in "xyz" for k in (2, 3)})
    return _points(geometry.outward(flipped.join(middles, "box"), (F.col("mx"), F.col("my"), F.col("mz"))), "id")


@query(f"""
WITH m AS (SELECT DISTINCT {', '.join(POINTS)} FROM ({MESH_SQL}) WHERE (x1+x2+x3)/3 BETWEEN 0.0 AND 2.4 AND (y1+y2+y3)/3 BETWEEN 0.0 AND 9.0),
t AS ({_turned_sql('SELECT * FROM m', 90.0)}), b AS (SELECT {', '.join(c if c[0] != 'z' else f'CASE WHEN {c}<0.5 THEN 0.0 ELSE {c} END AS {c}' for c in POINTS)} FROM t)
SELECT {', '.join(f'round({c}-({dict(x=-1.0, y=2.0, z=1.5)[c[0]]}),6)+0.0 AS {c}' if c[0] != 'z' else f'round(greatest({c}-1.5,0.0),6)+0.0 AS {c}' for c in POINTS)} FROM b WHERE greatest(z1, z2, z3)>=1.5
""")
def prepared_mesh(spark: SparkSession, d: str) -> DataFrame:
    """A case's mesh from raw triangles: cropped, cleaned, turned, set on its base, moved and seated."""
    got = geometry.prepare(box_mesh(spark), low=(0.0, 0.0), high=(2.4, 9.0), degrees=90.0, origin=(-1.0, 2.0, 1.5), base=0.5)
    return _points(got)


_FACE_SQL = "SELECT a AS axis, unnest(range(n+1)) AS k, CAST(unnest(range(n+1)) AS DOUBLE) AS coord FROM (VALUES ('x', 5), ('y', 4), ('z', 5)) AS t(a, n)"


def _faces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k, float(k)) for a, n in (("x", 5), ("y", 4), ("z", 5)) for k in range(n + 1)], "axis string, k long, coord double")


_SPAN_SQL = f"""
SELECT box, f.axis, min(k) FILTER (coord>=lo) AS first, min(k) FILTER (coord>=hi)-1 AS last FROM ({_FACE_SQL}) f JOIN (
  SELECT box, 'x' AS axis, x0 AS lo, x1 AS hi FROM ({BOX_SQL}) UNION ALL SELECT box, 'y', y0, y1 FROM ({BOX_SQL}) UNION ALL SELECT box, 'z', z0, z1 FROM ({BOX_SQL})) s ON s.axis=f.axis GROUP BY ALL
"""


@query(_SPAN_SQL)
def box_spans(spark: SparkSession, d: str) -> DataFrame:
    return geometry.box_index(_boxes(spark), _faces(spark))


@query(f"""
WITH s AS (SELECT box, max(first) FILTER (axis='x') AS xf, max(last) FILTER (axis='x') AS xl, max(first) FILTER (axis='y') AS yf, max(last) FILTER (axis='y') AS yl, max(first) FILTER (axis='z') AS zf, max(last) FILTER (axis='z') AS zl FROM ({_SPAN_SQL}) GROUP BY box)
SELECT kz, ky, kx, CAST(EXISTS (FROM s WHERE kx BETWEEN xf AND xl AND ky BETWEEN yf AND yl AND kz BETWEEN zf AND zl) AS BIGINT) AS solid
FROM (SELECT unnest(range(5)) AS kz), (SELECT unnest(range(4)) AS ky), (SELECT unnest(range(5)) AS kx)
""")
def box_mask(spark: SparkSession, d: str) -> DataFrame:
    """A grid's mask from a list of buildings."""
    return geometry.box_mask(spark, _boxes(spark), _faces(spark), {"z": 5, "y": 4, "x": 5})


@query("""
WITH t AS (SELECT i, j, (i*3.0+CASE WHEN j%2=1 THEN 1.5 ELSE 0 END)%9.0 AS x0, j*3.0 AS y0 FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j)), w AS (SELECT *, x0+2.0 AS x1 FROM t)
SELECT i, j, CAST(x0 AS DOUBLE) AS x0, CAST(least(x1,9.0) AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y0+2.0 AS DOUBLE) AS y1, 5.0::DOUBLE AS z1 FROM w
UNION ALL SELECT i, j, 0.0, CAST(x1-9.0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(y0+2.0 AS DOUBLE), 5.0 FROM w WHERE x1>9.0
""")
def tiled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A regular array of buildings, every other row shifted, wrapping at the edge."""
    return geometry.tiled_boxes(spark, 3, 4, 2.0, 3.0, 5.0, 9.0, shift=1.5).select("i", "j", "x0", "x1", "y0", "y1", "z1")
