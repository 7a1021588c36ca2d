"""Place joins on grid cells: equi joins on cells followed by the exact test.

Copies of one position are joined once and expanded afterwards, and crowded cells of the probed
side are split into salted shares, so no cell is handled whole by one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

HOT_CELL_ROWS = 50_000
MIN_CELL_M = 40.0


def with_cell(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col(x) / cell), "cy": F.floor(F.col(y) / cell)})


def salted_cell_join(left: DataFrame, right: DataFrame, salt_key: str, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Inner join on (cx, cy, salt); the right side of a crowded cell is spread over several salts.

    Cell sizes are counted with a partial aggregate first. Only the crowded cells, at most one per ``hot_rows`` rows, are
    sent to all tasks, so either side is shuffled once; the few left rows there are repeated per share. ``salt`` stays:
    what is grouped by (cx, cy, salt) and more is not shuffled again.
    """
    probe, spread = salted_cells(left, right, salt_key, hot_rows)
    return probe.join(spread, ["cx", "cy", "salt"])


def salted_cells(left: DataFrame, right: DataFrame, salt_key: str, hot_rows: int = HOT_CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``salted_cell_join`` with their ``salt``."""
    sizes = right.groupBy("cx", "cy").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("shares"))
    crowded = F.broadcast(sizes.where(F.col("shares") > 1))
    probe = (left.join(crowded, ["cx", "cy"], "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares"))
    spread = (right.join(crowded, ["cx", "cy"], "left")
              .withColumn("salt", F.pmod(F.xxhash64(salt_key), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares"))
    return probe, spread


def neighbour_cells(df: DataFrame) -> DataFrame:
    """Repeat each row for its own cell and the eight around it."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
            .withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy"))


def distance_join(left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """Pairs of points within ``limit``.

    ``left`` holds ``l_id, lx, ly`` and ``right`` holds ``r_id, rx, ry``. Points of equal position are
    joined as one place; ids come back only for places that are close.
    """
    places_l = with_cell(left.select("lx", "ly").distinct(), "lx", "ly", limit)
    places_r = with_cell(right.select("rx", "ry").distinct(), "rx", "ry", limit).withColumn("place", F.struct("rx", "ry"))
    dist = F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)
    near = (salted_cell_join(neighbour_cells(places_l), places_r, "place")
            .withColumn("dist", dist).where(F.col("dist") <= limit).select("lx", "ly", "rx", "ry", "dist"))
    return left.join(near, ["lx", "ly"]).join(right, ["rx", "ry"])


def line_cells(lines: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """One row per grid cell met by the box of each straight piece of ``pts``, grown by ``margin``."""
    piece = lines.select("*", F.explode(G.pieces(F.col("pts"))).alias("p"))
    boxes = G.cells_of_box(F.least("p.x0", "p.x1") - margin, F.least("p.y0", "p.y1") - margin,
                           F.greatest("p.x0", "p.x1") + margin, F.greatest("p.y0", "p.y1") + margin, cell)
    return piece.select("*", F.explode(boxes).alias("c")).select("*", "c.cx", "c.cy").drop("c")


# A line within a square of this side goes to one cell as a whole.
HOME_EXTENT_M, HOME_CELL_M = 200.0, 400.0


def homes(lines: DataFrame, line_id: str) -> tuple[DataFrame, DataFrame]:
    """Lines of small extent with their coordinates ``xs, ys`` in the cell of their middle, and the larger and incomplete ones as they are.

    ``lines`` holds ``pts`` and the column named by ``line_id``.
    """
    # a generator computes the columns once, however often they are used
    rows = lines.select(line_id, F.inline(F.array(F.struct("pts", F.col("pts.x").cast("array<double>").alias("xs"), F.col("pts.y").cast("array<double>").alias("ys")))))
    rows = rows.select("*", F.inline(F.array(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("xs", "ys") for n, f in (("low", F.array_min), ("high", F.array_max))]))))
    # null where a coordinate is missing
    whole = ~F.array_contains("xs", float("nan")) & ~F.array_contains("ys", float("nan")) & (F.size("xs") >= 2)
    small = F.coalesce(whole & (F.col("high_xs") - F.col("low_xs") <= HOME_EXTENT_M) & (F.col("high_ys") - F.col("low_ys") <= HOME_EXTENT_M), F.lit(False))
    middle = rows.where(small).withColumns({"x": (F.col("low_xs") + F.col("high_xs")) / 2, "y": (F.col("low_ys") + F.col("high_ys")) / 2})
    return with_cell(middle, "x", "y", HOME_CELL_M).select(line_id, "xs", "ys", "cx", "cy"), rows.where(~small).select(line_id, "pts")


def around_homes(rows: DataFrame, x0: str, x1: str, y0: str, y1: str, limit: float) -> DataFrame:
    """Rows repeated for every cell whose lines may be within ``limit`` of their box."""
    reach = limit + HOME_EXTENT_M / 2
    for cell, a, b in (("cx", x0, x1), ("cy", y0, y1)):
        low, high = (F.col(a), F.col(a)) if a == b else (F.least(a, b), F.greatest(a, b))
        rows = rows.withColumn(cell, F.explode(F.sequence(F.floor((low - reach) / HOME_CELL_M), F.floor((high + reach) / HOME_CELL_M))))
    return rows


def flat_pieces(pieces: DataFrame, column: str) -> tuple[DataFrame, dict[str, Column]]:
    """The pieces in ``column`` as columns of their own that are never null, and the columns by field.

    A piece that misses a coordinate of one end is the point at its other end; one without a whole end is left out.
    """
    p = F.col(column)
    start, end = [F.when(p[x].isNotNull() & p[y].isNotNull(), F.struct(p[x].alias("x"), p[y].alias("y"))) for x, y in (("x0", "y0"), ("x1", "y1"))]
    flat = pieces.withColumns({"_a": F.coalesce(start, end), "_b": F.coalesce(end, start), "_len": F.coalesce(p["len"], F.lit(0.0))}).drop(column)
    names = {field: f"{column}_{field}" for field in ("x0", "y0", "x1", "y1", "len")}
    flat = flat.withColumns(dict(zip(names.values(), (F.col("_a.x"), F.col("_a.y"), F.col("_b.x"), F.col("_b.y"), F.col("_len"))))).drop("_a", "_b", "_len")
    for name in names.values():
        flat = flat.where(F.col(name).isNotNull())
    return flat, {field: F.col(name) for field, name in names.items()}


def points_near_lines(points: DataFrame, lines: DataFrame, limit: float) -> DataFrame:
    """Distance of every point to every line within ``limit``.

    ``points`` holds ``p_id, x, y``, one place per ``p_id``; ``lines`` holds ``line_id, pts``. The
    pieces of a line are put into the cells around them, a point looks into its own cell only, so all that
    it meets of a line lies in one task. Cells are never smaller than a usual piece, so a piece meets few of them.
    """
    cell = max(2 * limit, MIN_CELL_M)
    cells = line_cells(lines.select("line_id", "pts"), cell, limit).select("line_id", "p", "cx", "cy")
    probe = with_cell(points.select("p_id", "x", "y"), "x", "y", cell)
    pairs = salted_cell_join(probe, cells, "line_id").withColumn(
        "dist", G.point_piece_distance(F.col("x"), F.col("y"), F.col("p"))).where(F.col("dist") <= limit)
    return pairs.groupBy("cx", "cy", "salt", "p_id", "line_id").agg(F.min("dist").alias("dist")).select("p_id", "line_id", "dist")


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of points and the rings that cover them, or lie within ``tolerance`` of them.

    ``points`` holds ``p_id, x, y``; ``rings`` holds ``ring_id, ring``.
    """
    box = G.bounds(F.col("ring"))
    covers = rings.select("ring_id", "ring", F.explode(G.cells_of_box(
        box["minx"] - tolerance, box["miny"] - tolerance, box["maxx"] + tolerance, box["maxy"] + tolerance, cell)).alias("c"))
    probe = with_cell(points.select("p_id", "x", "y"), "x", "y", cell)
    pairs = salted_cell_join(probe, covers.select("ring_id", "ring", "c.cx", "c.cy"), "ring_id")
    p = F.struct("x", "y")
    hit = G.ring_contains(p, F.col("ring")) | (G.point_line_distance(p, G.pieces(F.col("ring"))) <= max(tolerance, 1e-9))
    return pairs.where(hit).select("p_id", "ring_id")


def lines_meeting_rings(lines: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Pairs of lines and the rings that some piece of them meets, whether or not a vertex lies inside.

    ``lines`` holds ``line_id, pts``; ``rings`` holds ``ring_id, ring``.
    """
    box = G.bounds(F.col("ring"))
    covers = rings.select("ring_id", "ring", F.explode(G.cells_of_box(box["minx"], box["miny"], box["maxx"], box["maxy"], cell)).alias("c"))
    probe = line_cells(lines.select("line_id", "pts"), cell).select("line_id", "p", "cx", "cy")
    pairs = salted_cell_join(probe, covers.select("ring_id", "ring", "c.cx", "c.cy"), "ring_id")
    return pairs.where(G.piece_meets_ring(F.col("p"), F.col("ring"))).select("line_id", "ring_id").distinct()


def nearest_line(points: DataFrame, lines: DataFrame, limit: float) -> DataFrame:
    """Nearest line per point; ties go to the smaller id."""
    near = points_near_lines(points, lines, limit)
    return near.groupBy("p_id").agg(F.min(F.struct("dist", "line_id")).alias("best")).select(
        "p_id", "best.line_id", "best.dist")
