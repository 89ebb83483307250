"""Overlap of polygons, each given as one ring of points or as several rings.

Rings may be separate parts or holes: a point belongs to a shape if a ray from it
crosses the rings an odd number of times, or if it lies on one of them.

Shapes are spread over grid cells by their bounding box, paired within a cell,
and then tested exactly. Everything is a column expression; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a rectangle."""
    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _edges(ring: Column) -> Column:
    """Segments between neighbouring points; a ring that is not closed is closed."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _turn(p: Column, q: Column, r: Column) -> Column:
    """Positive when p, q, r turn left, zero when they lie on one line."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (F.least(a0, a1) <= F.greatest(b0, b1)) & (F.least(b0, b1) <= F.greatest(a0, a1))


def _segments_meet(s: Column, t: Column) -> Column:
    """Segments share a point: their boxes overlap and neither lies on one side of the other."""
    p, q, u, v = s["a"], s["b"], t["a"], t["b"]
    boxes = _overlap(p["x"], q["x"], u["x"], v["x"]) & _overlap(p["y"], q["y"], u["y"], v["y"])
    straddles = (F.signum(_turn(p, q, u)) * F.signum(_turn(p, q, v)) <= 0) & (
        F.signum(_turn(u, v, p)) * F.signum(_turn(u, v, q)) <= 0
    )
    return boxes & straddles


def _inside(point: Column, edges: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the ring an odd number of times."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > point["y"]) != (b["y"] > point["y"])
        slope = F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        at = a["x"] + (point["y"] - a["y"]) * slope
        return spans & (point["x"] < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def rings_meet(ring: Column | str, other: Column | str) -> Column:
    """Two polygons of one ring share at least one point, their borders included."""
    return shapes_meet(F.array(as_col(ring)), F.array(as_col(other)))


def shapes_meet(rings: Column | str, others: Column | str) -> Column:
    """Two shapes, each an array of rings, share at least one point, their borders included.

    If no borders meet, a shape lies in the other where any of its rings begins in it.
    """
    rings, others = as_col(rings), as_col(others)
    mine, theirs = F.flatten(F.transform(rings, _edges)), F.flatten(F.transform(others, _edges))
    borders = F.exists(mine, lambda s: F.exists(theirs, lambda t: _segments_meet(s, t)))
    return borders | F.exists(rings, lambda r: _inside(r[0], theirs)) | F.exists(others, lambda r: _inside(r[0], mine))


def _as_rings(df: DataFrame, shape: str) -> Column:
    """The shape as an array of rings, also where it is a single ring."""
    points = df.select(as_col(shape).alias("shape")).schema["shape"].dataType.elementType
    return as_col(shape) if points.typeName() == "array" else F.array(as_col(shape))


def _boxed(df: DataFrame, shape: str, tag: str, cell: float) -> DataFrame:
    """Bounding box columns and the grid level at which the box touches at most four cells.

    The cells of a level are twice as wide as those of the level below.
    """
    def bound(fn, axis):
        return fn(F.transform(F.flatten(as_col(shape)), lambda p: p[axis]))

    boxed = df.withColumns(
        {
            f"{tag}x0": bound(F.array_min, "x"),
            f"{tag}x1": bound(F.array_max, "x"),
            f"{tag}y0": bound(F.array_min, "y"),
            f"{tag}y1": bound(F.array_max, "y"),
        }
    )
    widest = F.greatest(F.col(f"{tag}x1") - F.col(f"{tag}x0"), F.col(f"{tag}y1") - F.col(f"{tag}y0"))
    level = F.when(widest > cell, F.ceil(F.log2(widest / cell))).otherwise(0).cast("int")
    return boxed.withColumn(f"{tag}level", level)


def _levels(boxed: DataFrame, tag: str) -> list[int]:
    """The levels that occur, a few dozen at most; runs a job."""
    return sorted(r[0] for r in boxed.select(f"{tag}level").distinct().collect() if r[0] is not None)


def _in_cells(boxed: DataFrame, tag: str, others: list[int], cell: float) -> DataFrame:
    """A row for each cell the box touches at its own level and at the coarser levels of the other table."""
    own = F.col(f"{tag}level")
    levels = F.array_union(F.array(own), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > own))
    spread = boxed.withColumn("_level", F.explode(levels))
    for axis in "xy":
        low, high = _cell(f"{tag}{axis}0", cell), _cell(f"{tag}{axis}1", cell)
        spread = spread.withColumn(f"_cell_{axis}", F.explode(F.sequence(low, high)))
    return spread


def _cell(bound: Column | str, cell: float) -> Column:
    return F.floor(as_col(bound) / (F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))))


def _paired(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_ring: str, right_ring: str, cell: float):
    """Both tables spread over cells, and the exact test for a pair that met in a cell."""
    a = _boxed(left.select(as_col(left_id).alias("_l"), _as_rings(left, left_ring).alias("_lr")), "_lr", "_l", cell)
    b = _boxed(right.select(as_col(right_id).alias("_r"), _as_rings(right, right_ring).alias("_rr")), "_rr", "_r", cell)
    here, there = _in_cells(a, "_l", _levels(b, "_r"), cell), _in_cells(b, "_r", _levels(a, "_l"), cell)
    same_level = F.col("_level") == F.greatest("_llevel", "_rlevel")
    boxes_meet = (
        (F.col("_lx0") <= F.col("_rx1")) & (F.col("_rx0") <= F.col("_lx1"))
        & (F.col("_ly0") <= F.col("_ry1")) & (F.col("_ry0") <= F.col("_ly1"))
    )
    return here, there, same_level & boxes_meet


_CELL = ["_level", "_cell_x", "_cell_y"]


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_ring: str = "ring",
    right_ring: str = "ring",
    cell: float = 1.0,
) -> DataFrame:
    """Id pairs of shapes that meet, each pair once.

    ``cell`` is the width of the finest cells; about the size of a typical box of
    the larger table is best. A wider box uses coarser cells, at most four of
    them, and each shape is repeated for the coarser levels that occur in the
    other table, so its copies do not depend on its size. A pair meets at the
    coarser of its two levels, and is reported from the one cell there that
    holds the lower left corner of the common box, so no distinct is needed.
    """
    here, there, meet = _paired(left, right, left_id, right_id, left_ring, right_ring, cell)
    first_common = (F.col("_cell_x") == _cell(F.greatest("_lx0", "_rx0"), cell)) & (
        F.col("_cell_y") == _cell(F.greatest("_ly0", "_ry0"), cell))
    pairs = here.join(there, _CELL).filter(meet & first_common)
    return pairs.filter(shapes_meet("_lr", "_rr")).select(
        F.col("_l").alias(left_id), F.col("_r").alias(right_id)
    )


def ids_overlapping(
    shapes: DataFrame, areas: DataFrame, shape_id: str, area_id: str, cell: float = 1.0
) -> DataFrame:
    """Distinct ids of the shapes that meet any of the areas; a semi-join, which stops at the first area that does."""
    here, there, meet = _paired(shapes, areas, shape_id, area_id, "ring", "ring", cell)
    other = there.withColumnsRenamed({c: f"{c}_there" for c in _CELL})
    same_cell = (F.col("_level") == F.col("_level_there")) & (F.col("_cell_x") == F.col("_cell_x_there")) & (
        F.col("_cell_y") == F.col("_cell_y_there"))
    found = here.join(other, same_cell & meet & shapes_meet("_lr", "_rr"), "left_semi")
    return found.select(F.col("_l").alias(shape_id)).distinct()
