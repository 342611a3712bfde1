"""Meshes, masks and halos as tables.

A mesh is ``tri(id, x1, y1, z1, ..., z3)``. Triangles find their columns by binary search on the axes; cells and
boxes meet in range joins on small dimension tables, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators.temporal import column_runs

MESH = "id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double"
CORNERS = [(f"x{k}", f"y{k}", f"z{k}") for k in (1, 2, 3)]


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of STL files, text or binary, as one soup; an error if there are none."""

    def parse(content: bytes) -> np.ndarray:
        if content[:5] == b"solid" and b"facet" in content[:1024]:
            numbers = [line.split()[1:4] for line in content.decode("ascii", "replace").splitlines() if line.strip().startswith("vertex")]
            return np.array(numbers, float).reshape(-1, 9)
        kind = np.dtype([("n", "<3f4"), ("v", "<9f4"), ("a", "<u2")])
        return np.frombuffer(content, kind, offset=84)["v"].astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                t = parse(bytes(content))
                out = pd.DataFrame(t, columns=[c for corner in CORNERS for c in corner])
                out.insert(0, "id", np.arange(len(t)))
                yield out

    mesh = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, MESH)
    if mesh.isEmpty():
        raise ValueError(f"no triangle in {path}")
    return mesh


def crop(mesh: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Triangles whose centroid is inside a rectangle."""
    cx, cy = ((F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3 for a in "xy")
    return mesh.where(cx.between(low[0], high[0]) & cy.between(low[1], high[1]))


def seat_floor(mesh: DataFrame) -> DataFrame:
    """Without triangles wholly below the floor, others not below it."""
    kept = mesh.where(F.greatest("z1", "z2", "z3") >= 0)
    return kept.withColumns({f"z{k}": F.greatest(F.col(f"z{k}"), F.lit(0.0)) for k in (1, 2, 3)})


def rotate(mesh: DataFrame, degrees: float) -> DataFrame:
    """Turned about the vertical through the middle of its bounding box."""
    b = mesh.agg(*[f(g(*[F.col(f"{a}{k}") for k in (1, 2, 3)])).alias(f"{a}_{n}") for a in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))]).first()
    cx, cy = (b["x_lo"] + b["x_hi"]) / 2, (b["y_lo"] + b["y_hi"]) / 2
    c, s = float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))
    out = {}
    for k in (1, 2, 3):
        x, y = F.col(f"x{k}") - cx, F.col(f"y{k}") - cy
        out[f"x{k}"], out[f"y{k}"] = cx + c * x - s * y, cy + s * x + c * y
    return mesh.withColumns(out)


def clean(mesh: DataFrame) -> DataFrame:
    """Without triangles of no area, and each set of corners once."""
    ux, uy, uz = (F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz")
    vx, vy, vz = (F.col(f"{a}3") - F.col(f"{a}1") for a in "xyz")
    area = F.pow(uy * vz - uz * vy, 2) + F.pow(uz * vx - ux * vz, 2) + F.pow(ux * vy - uy * vx, 2)
    corners = F.sort_array(F.array(*[F.struct(*[F.col(c).alias(c[0]) for c in corner]) for corner in CORNERS]))
    return mesh.where(area > 0).withColumn("__c", corners).dropDuplicates(["__c"]).drop("__c")


#: Cells that an axis of columns or levels has at most; its centres are an array of the plan.
AXIS = 1 << 20


def axis_centres(axis: DataFrame, index: str, centre: str) -> Column:
    """Cell centres in order as one array; an error unless cells are numbered from 0 and the axis is short enough."""
    rows = axis.select(index, F.col(centre).cast("double").alias("c")).orderBy(index).limit(AXIS + 1).collect()
    if len(rows) > AXIS or [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError(f"an axis has cells 0, 1, 2, ..., at most {AXIS}")
    return F.split(F.lit(",".join(repr(r["c"]) for r in rows)), ",").cast("array<double>") if rows else F.array().cast("array<double>")


def first_at(centres: Column, value: Column, *, over: bool = False) -> Column:
    """The first cell whose centre is at least ``value`` (``over``: above it), by binary search; their number, if none is."""
    start = F.struct(F.lit(0).alias("a"), F.size(centres).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        low = F.get(centres, mid) <= value if over else F.get(centres, mid) < value
        return F.when(s["a"] >= s["b"], s).when(low, F.struct((mid + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(AXIS.bit_length())), start, halve, lambda s: s["a"])


def crossings(mesh: DataFrame, xs: DataFrame, ys: DataFrame, slack: float = 0.0) -> DataFrame:
    """``(i, j, z)``: where the vertical through each column's centre meets a triangle.

    Each triangle goes to the columns of its own bounding box, found by binary search on the axes; there is no join.
    """
    got = mesh
    for n, axis, c in (("i", xs, "x"), ("j", ys, "y")):
        centres = axis_centres(axis, n, c)
        corners = [f"{c}{k}" for k in (1, 2, 3)]
        first, last = first_at(centres, F.least(*corners)), first_at(centres, F.greatest(*corners), over=True) - 1
        got = got.withColumn(n, F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn(c, F.get(centres, F.col(n)))
    dx, dy = F.col("x") - F.col("x3"), F.col("y") - F.col("y3")
    e1x, e1y, e2x, e2y = F.col("x1") - F.col("x3"), F.col("y1") - F.col("y3"), F.col("x2") - F.col("x3"), F.col("y2") - F.col("y3")
    twice = F.nullif(e1x * e2y - e2x * e1y, F.lit(0.0))
    a, b = (dx * e2y - e2x * dy) / twice, (e1x * dy - dx * e1y) / twice
    got = got.withColumn("__a", a).withColumn("__b", b).where((F.col("__a") >= -slack) & (F.col("__b") >= -slack) & (F.col("__a") + F.col("__b") <= 1 + slack))
    z = F.col("__a") * F.col("z1") + F.col("__b") * F.col("z2") + (1 - F.col("__a") - F.col("__b")) * F.col("z3")
    return got.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), z.alias("z"))


def roof_heights(mesh: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """``(i, j, height)``: the highest surface over each column that has one; ``xs(i, x)`` and ``ys(j, y)`` are columns' centres."""
    return crossings(mesh, xs, ys, 1e-12).groupBy("i", "j").agg(F.max("z").alias("height"))


def height_raster(mesh: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Heights over all columns, 0 where nothing stands: ``(i, j, height)``."""
    n = xs.count()
    every = ys.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("i", "j")
    return every.join(roof_heights(mesh, xs, ys), ["i", "j"], "left").withColumn("height", F.coalesce("height", F.lit(0.0)))


def raster_lines(raster: DataFrame) -> DataFrame:
    """A raster as text, the last row first: ``(j, line)``."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "height"))), lambda s: F.format_string("%.3f", s["height"])), " ")
    return raster.groupBy("j").agg(row.alias("line")).orderBy(F.col("j").desc())


def solid_cells(mesh: DataFrame, xs: DataFrame, ys: DataFrame, zs: DataFrame) -> DataFrame:
    """``(i, j, k)`` of cells whose centre is not above the roof; ``zs(k, z)``."""
    roofs = roof_heights(mesh, xs, ys)
    return roofs.join(F.broadcast(zs), F.col("z") <= F.col("height")).select("i", "j", "k")


def solid_runs(mesh: DataFrame, xs: DataFrame, ys: DataFrame, zs: DataFrame) -> DataFrame:
    """Vertical runs of solid cells, counted from 1; an error if there is none."""
    out = column_runs(solid_cells(mesh, xs, ys, zs).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), (F.col("k") + 1).alias("k")))
    if out.isEmpty():
        raise ValueError("the mesh fills no cell")
    return out


def run_statements(runs: DataFrame) -> DataFrame:
    """Runs as assignments of an array of blocked cells, in order."""
    text = F.format_string("blocked(%d, %d, %d:%d) = 1", "i", "j", "ks", "ke")
    return runs.orderBy("i", "j", "ks").select("i", "j", "ks", text.alias("line"))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells ``(.., x_lo, x_hi, ..)`` that lie wholly in a box ``(box, x0, x1, y0, y1, z0, z1)``."""
    inside = [(F.col(f"{a}_lo") >= F.col(f"{a}0") - tolerance) & (F.col(f"{a}_hi") <= F.col(f"{a}1") + tolerance) for a in "xyz"]
    return cells.join(F.broadcast(boxes), inside[0] & inside[1] & inside[2], "left_semi")


def box_index(boxes: DataFrame, faces: DataFrame) -> DataFrame:
    """``(box, axis, first, last)``: the cells that a box spans, by the faces ``(axis, k, coord)`` it covers."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}0").alias("lo"), F.col(f"{a}1").alias("hi")) for a in "xyz"]))
    long = boxes.select("box", sides.alias("s")).select("box", "s.*")
    at = long.join(F.broadcast(faces), "axis").groupBy("box", "axis")
    return at.agg(F.min(F.when(F.col("coord") >= F.col("lo"), F.col("k"))).alias("first"), (F.min(F.when(F.col("coord") >= F.col("hi"), F.col("k"))) - 1).alias("last"))


#: The faces of a box: two triangles for each side, corners by (x, y, z) of 0 and 1: fixed values.
BOX_FACES = [
    ((0, 0, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 0), (0, 1, 0), (1, 1, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1)), ((0, 0, 1), (1, 1, 1), (0, 1, 1)),
    ((0, 0, 0), (1, 0, 0), (1, 0, 1)), ((0, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (1, 1, 1), (1, 1, 0)), ((0, 1, 0), (0, 1, 1), (1, 1, 1)),
    ((0, 0, 0), (0, 0, 1), (0, 1, 1)), ((0, 0, 0), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1)), ((1, 0, 0), (1, 1, 1), (1, 0, 1)),
]


def box_triangles(boxes: DataFrame) -> DataFrame:
    """Twelve triangles for each box."""
    faces = F.array(*[F.struct(F.lit(n).cast("long").alias("face"), *[F.col(f"{a}{v}").alias(f"{a}{k}") for k, corner in enumerate(face, 1) for a, v in zip("xyz", corner)]) for n, face in enumerate(BOX_FACES)])
    return boxes.select("box", F.explode(faces).alias("f")).select("box", "f.*")


def tiled_boxes(spark: SparkSession, nx: int, ny: int, size: float, pitch: float, height: float, width: float, *, shift: float = 0.0) -> DataFrame:
    """A regular array of boxes, every other row shifted; a box over the far edge is split and wraps."""
    n = F.col("id")
    tiles = spark.range(nx * ny).select((n % nx).alias("i"), F.floor(n / nx).alias("j"))
    x0 = F.pmod(F.col("i") * pitch + F.when(F.col("j") % 2 == 1, F.lit(shift)).otherwise(F.lit(0.0)), F.lit(float(width)))
    rows = tiles.withColumn("x0", x0).withColumn("x1", x0 + size)
    whole = F.array(F.struct(F.col("x0").alias("a"), F.least("x1", F.lit(float(width))).alias("b")))
    rest = F.array(F.struct(F.lit(0.0).alias("a"), (F.col("x1") - width).alias("b")))
    parts = rows.withColumn("p", F.explode(F.when(F.col("x1") > width, F.concat(whole, rest)).otherwise(whole)))
    y0 = F.col("j") * pitch
    return parts.select("i", "j", F.col("p.a").alias("x0"), F.col("p.b").alias("x1"), y0.alias("y0"), (y0 + size).alias("y1"), F.lit(0.0).alias("z0"), F.lit(float(height)).alias("z1"))


def halo(cells: DataFrame, sizes: dict[str, int], width: int = 1, periodic: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` with a halo on each axis ``(k<axis> -> size)``: periodic, else the nearest cell. Later axes see earlier halos."""
    for axis, n in sizes.items():
        k = F.col(f"k{axis}")
        if axis in periodic:
            below, above = F.when(k >= n - width, k - n), F.when(k < width, k + n)
            places = F.array_compact(F.array(k, below, above))
        else:
            low = F.when(k == 0, F.sequence(F.lit(-width).cast("long"), F.lit(-1).cast("long")))
            high = F.when(k == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n + width - 1).cast("long")))
            none = F.array().cast("array<bigint>")
            places = F.concat(F.array(k.cast("long")), F.coalesce(low, none), F.coalesce(high, none))
        cells = cells.withColumn(f"k{axis}", F.explode(places))
    return cells


#: The 27 directions of the lattice, and the weight by the number of axes that a direction moves on: fixed values.
LATTICE_WEIGHTS = (8 / 27, 2 / 27, 1 / 54, 1 / 216)


def lattice_directions() -> Column:
    """The directions as an array of ``(q, cx, cy, cz, weight)``."""
    moves = [(x, y, z) for x in (0, 1, -1) for y in (0, 1, -1) for z in (0, 1, -1)]
    return F.array(*[F.struct(F.lit(q).cast("long").alias("q"), *[F.lit(c).alias(n) for n, c in zip(("cx", "cy", "cz"), m)], F.lit(LATTICE_WEIGHTS[sum(map(abs, m))]).alias("weight")) for q, m in enumerate(moves)])


def equilibrium(cells: DataFrame, *, third_order: bool = False) -> DataFrame:
    """Equilibrium populations of ``cells(.., rho, u, v, w)``: a row for each cell and direction."""
    rows = cells.withColumn("__d", F.explode(lattice_directions())).select("*", "__d.*").drop("__d")
    cu = 3 * (F.col("cx") * F.col("u") + F.col("cy") * F.col("v") + F.col("cz") * F.col("w"))
    uu = F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w")
    shape = 1 + cu + cu * cu / 2 - 1.5 * uu
    if third_order:
        shape = shape + cu * cu * cu / 6 - 1.5 * cu * uu
    return rows.withColumn("f", F.col("weight") * F.col("rho") * shape)


def moments(populations: DataFrame, keys: list[str]) -> DataFrame:
    """Density and velocity of cells, from their populations."""
    sums = populations.groupBy(*keys).agg(F.sum("f").alias("rho"), *[F.sum(F.col("f") * F.col(c)).alias(f"__{c}") for c in ("cx", "cy", "cz")])
    rho = F.greatest(F.col("rho"), F.lit(1e-12))
    return sums.select(*keys, "rho", (F.col("__cx") / rho).alias("u"), (F.col("__cy") / rho).alias("v"), (F.col("__cz") / rho).alias("w"))


def radius_neighbours(points: DataFrame, nodes: DataFrame, radius: float, most: int) -> DataFrame:
    """``(node, point, distance)``: up to ``most`` nearest points within ``radius`` of each node."""
    from meshlark.operators.sweep import top_rows

    near = points.withColumns({f"__c{d}": F.floor(F.col(d) / radius) for d in "xyz"})
    around = nodes.select("node", *[F.col(d).alias(f"__{d}") for d in "xyz"])
    for d in "xyz":
        around = around.withColumn(f"__c{d}", F.explode(F.array(*[F.floor(F.col(f"__{d}") / radius) + s for s in (-1, 0, 1)])))
    apart = F.sqrt(sum(F.pow(F.col(d) - F.col(f"__{d}"), 2) for d in "xyz"))
    pairs = near.join(around, ["__cx", "__cy", "__cz"]).select("node", "point", apart.alias("distance")).where(F.col("distance") <= radius)
    return top_rows(pairs, ["node"], ["distance", "point"], most)


def strided_nodes(points: DataFrame, n: int, count: int) -> DataFrame:
    """Up to ``n`` of ``count`` points, evenly by stride."""
    stride = max(1, count // n)
    return points.where((F.col("point") % stride == 0) & (F.col("point") / stride < n))


def fluid_cells(mesh: DataFrame, xs: DataFrame, ys: DataFrame, zs: DataFrame) -> DataFrame:
    """``(i, j, k, fluid)`` of all cells: 0 inside the closed mesh, by the number of surfaces above.

    Surfaces over a column are few, whatever the mesh's size; each cell counts those above it.
    """
    # Two triangles that share an edge over a centre are one surface there.
    hits = crossings(mesh, xs, ys).select("i", "j", F.round("z", 9).alias("z"))
    surfaces = hits.groupBy("i", "j").agg(F.collect_set("z").alias("surfaces"))
    centres, n_x = axis_centres(zs, "k", "z"), xs.count()
    columns = ys.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_x - 1).cast("long")))).select("i", F.col("j").cast("long").alias("j"))
    cells = columns.join(surfaces, ["i", "j"], "left").select("i", "j", F.coalesce("surfaces", F.array().cast("array<double>")).alias("surfaces"), F.posexplode(centres).alias("k", "z"))
    above = F.size(F.filter("surfaces", lambda s: s > F.col("z")))
    return cells.select("i", "j", F.col("k").cast("long").alias("k"), (1 - above % 2).cast("long").alias("fluid"))


def weld(mesh: DataFrame, digits: int = 9) -> DataFrame:
    """Corners that agree in so many digits become one."""
    return mesh.withColumns({c: F.round(c, digits) for corner in CORNERS for c in corner})


def outward(mesh: DataFrame, inside: tuple[Column, Column, Column]) -> DataFrame:
    """Triangles wound so that their normals point away from a point inside (of a convex part)."""
    nx, ny, nz = normal()
    away = sum(n * ((F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3 - p) for n, a, p in zip((nx, ny, nz), "xyz", inside, strict=True))
    wrong = away < 0
    swapped = {f"{a}{k}": F.when(wrong, F.col(f"{a}{5 - k}")).otherwise(F.col(f"{a}{k}")) for a in "xyz" for k in (2, 3)}
    return mesh.withColumns(swapped)


def normal() -> tuple[Column, Column, Column]:
    """The components of a triangle's normal, as long as twice its area."""
    ux, uy, uz = (F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz")
    vx, vy, vz = (F.col(f"{a}3") - F.col(f"{a}1") for a in "xyz")
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def stl_text(mesh: DataFrame, name: str = "mesh") -> DataFrame:
    """``(id, text)``: each triangle as a facet of a text STL file, six decimals, with its unit normal."""
    n = normal()
    size = F.nullif(F.sqrt(sum(c * c for c in n)), F.lit(0.0))
    # Adding 0 turns a negative zero into a plain one.
    facet = F.format_string("facet normal %.6f %.6f %.6f", *[F.coalesce(F.round(c / size, 6), F.lit(0.0)) + 0.0 for c in n])
    corners = [F.format_string("vertex %.6f %.6f %.6f", *[F.round(c, 6) + 0.0 for c in corner]) for corner in CORNERS]
    return mesh.select("id", F.concat_ws("\n", facet, F.lit("outer loop"), *corners, F.lit("endloop"), F.lit("endfacet")).alias("text"))


def write_stl(mesh: DataFrame, path: str, name: str = "mesh") -> None:
    """A mesh as one text STL file (one task writes it: meshes of solvers are some megabytes)."""
    body = stl_text(mesh, name).select(F.col("id").alias("o"), "text")
    frame = mesh.sparkSession.createDataFrame([(-1, f"solid {name}"), (2**62, f"endsolid {name}")], "o long, text string")
    body.unionByName(frame).coalesce(1).sortWithinPartitions("o").select("text").write.mode("overwrite").text(path)


def box_mask(spark: SparkSession, boxes: DataFrame, faces: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(kz, ky, kx, solid)`` of all cells of a grid: 1 in the cells that a box spans, by the faces it covers."""
    spans = box_index(boxes, faces).groupBy("box").pivot("axis", ["x", "y", "z"]).agg(F.first("first").alias("first"), F.first("last").alias("last"))
    for axis in "xyz":
        spans = spans.withColumn(f"k{axis}", F.explode(F.expr(f"case when {axis}_first <= {axis}_last then sequence({axis}_first, {axis}_last) end")))
    filled = spans.select("kz", "ky", "kx").distinct().withColumn("solid", F.lit(1).cast("long"))
    cells = spark.range(sizes["z"]).withColumnRenamed("id", "kz")
    for axis in "yx":
        cells = cells.withColumn(f"k{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[axis] - 1).cast("long"))))
    return cells.join(filled, ["kz", "ky", "kx"], "left").withColumn("solid", F.coalesce("solid", F.lit(0).cast("long")))


def flatten_base(mesh: DataFrame, below: float) -> DataFrame:
    """Corners under a height are put on the floor, so that parts stand on one plane."""
    return mesh.withColumns({f"z{k}": F.when(F.col(f"z{k}") < below, F.lit(0.0)).otherwise(F.col(f"z{k}")) for k in (1, 2, 3)})


def to_datum(mesh: DataFrame) -> DataFrame:
    """Moved so that the lowest corner is at 0."""
    low = mesh.agg(F.min(F.least("z1", "z2", "z3")).alias("__low"))
    return mesh.join(F.broadcast(low)).withColumns({f"z{k}": F.col(f"z{k}") - F.col("__low") for k in (1, 2, 3)}).drop("__low")


def prepare(
    mesh: DataFrame,
    *,
    low: tuple[float, float],
    high: tuple[float, float],
    degrees: float = 0.0,
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0),
    base: float = 0.0,
    ground: DataFrame | None = None,
) -> DataFrame:
    """A case's mesh: cropped, welded, cleaned, turned, set on a flat base and merged with its ground, which gives the
    datum, then moved to its origin and seated on the floor."""
    out = rotate(clean(weld(crop(mesh, low, high))), degrees)
    out = flatten_base(to_datum(out), base)
    if ground is not None:
        out = clean(out.unionByName(ground))
    moved = {f"{a}{k}": F.col(f"{a}{k}") - o for a, o in zip("xyz", origin) for k in (1, 2, 3)}
    return seat_floor(out.withColumns(moved))
