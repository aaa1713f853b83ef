"""Distributed point-in-polygon join over a grid of square cells.

Polygons are cut into the cells they touch, one row per polygon and cell. Each row keeps only the
edges that matter to points inside its cell, and a cell no edge reaches is known to be covered as a
whole. A cell that still holds many edges is divided further, so a coastline of any length costs a point no more
than a short ring. The different coordinates of the points meet the rows of their own cell by an equi-join, and
the points take what was found for their coordinates by another one. Nothing is gathered per cell, so
stacked polygons and crowded places stay rows that the adaptive join can split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.geometry import covers, crossings, edges_of, to_state_plane
from rentatlas.functions.numbers import null_if_nan
from rentatlas.operators.columns import assert_columns

MAX_CELLS_PER_SIDE = 64
#: A cell with more edges is divided into ``SPLIT`` by ``SPLIT``, at most ``LEVELS`` times.
MOST_EDGES = 64
SPLIT = 8
LEVELS = 6
BROADCAST_BYTES = 32 << 20
EDGE_BYTES = 48
CELL_BYTES = 256
WORK_COLUMNS = ["px", "py", "point_salt", "hit_x", "hit_y", "hit_salt", "hit"]


@dataclass(frozen=True)
class Grid:
    """Cell size (a power of two, so cell arithmetic is exact), tiers and index size bound.

    ``levels`` tells how often crowded cells are divided, ``sizes`` which cell sizes an index has.
    """

    cell: float
    tiers: int = 1
    index_bytes: int | None = None
    levels: int = 0
    sizes: tuple[float, ...] | None = None

    def tier_cell(self, tier: int) -> float:
        return self.cell * float(MAX_CELLS_PER_SIDE) ** tier

    @property
    def cell_sizes(self) -> tuple[float, ...]:
        """Sizes of the cells in which a point may find a polygon."""
        if self.sizes is not None:
            return self.sizes
        return tuple(
            self.tier_cell(k) / float(SPLIT) ** n
            for k in range(self.tiers) for n in range(self.levels + 1)
        )

    @property
    def fits_broadcast(self) -> bool:
        return self.index_bytes is not None and self.index_bytes <= BROADCAST_BYTES


@dataclass(frozen=True)
class SizeClass:
    """Polygons whose longer side is at most ``side`` and more than half of it."""

    side: float
    n: int
    edges: int
    climb: float
    attr_bytes: int = 0
    most_edges: int = 0


def add_state_plane(df: DataFrame, xy: tuple[str, str] = ("longitude", "latitude")) -> DataFrame:
    """Add ``x, y`` in metres; ``xy`` names the columns that hold the horizontal and vertical
    degrees, which older extracts have swapped. Rows without coordinates stay, with NULLs."""
    x, y = to_state_plane(*(null_if_nan(F.col(c)) for c in xy))
    return df.withColumns({"x": x, "y": y})


def polygon_layer(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Check a polygon table and keep ``poly_idx, rings`` and the attributes asked for.

    Rings that are NULL, or hold a point without coordinates, could not be read and fail the job;
    an empty geometry has no rings and covers nothing.
    """
    assert_columns(df, ["poly_idx", "rings", *attrs], "the polygon layer")
    broken = F.exists(
        F.flatten("rings"),
        lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]),
    )
    what = F.concat(F.lit("polygon "), F.coalesce(F.col("poly_idx").cast("string"), F.lit("?")),
                    F.lit(" has no readable rings"))
    rings = F.when(F.coalesce(broken, F.lit(True)), F.raise_error(what)).otherwise(F.col("rings"))
    return df.select(
        "poly_idx", rings.cast(df.schema["rings"].dataType).alias("rings"),
        *[a for a in attrs if a != "poly_idx"],
    )


def empty_polygons(df: DataFrame) -> int:
    """Polygons of a layer that an empty geometry leaves without any ring."""
    return df.where(F.size(F.flatten("rings")) == 0).count()


def _with_edges(polygons: DataFrame) -> DataFrame:
    boxed = polygons.withColumn("edges", edges_of(F.col("rings"))).where(F.size("edges") > 0)
    return boxed.withColumns(
        {
            "x0": F.array_min(F.transform("edges", lambda e: F.least(e["x1"], e["x2"]))),
            "x1": F.array_max(F.transform("edges", lambda e: F.greatest(e["x1"], e["x2"]))),
            "y0": F.array_min(F.transform("edges", lambda e: e["y1"])),
            "y1": F.array_max(F.transform("edges", lambda e: e["y2"])),
        }
    )


def _side() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def _cell_size(grid: Grid) -> Column:
    """Cell size of the tier a polygon belongs to by its longer side."""
    reach = F.greatest(_side() / (MAX_CELLS_PER_SIDE * grid.cell), F.lit(1.0))
    size = F.lit(grid.cell)
    for k in range(1, grid.tiers):
        larger = reach > float(MAX_CELLS_PER_SIDE) ** (k - 1)
        size = F.when(larger, F.lit(grid.tier_cell(k))).otherwise(size)
    return size


def layer_profile(polygons: DataFrame) -> list[SizeClass]:
    """Polygons, edges, vertical edge length and longest attributes per doubling of the side.

    One aggregate over the polygon layer alone. A double has about two thousand doublings, so
    the result is bounded however large the layer is.
    """
    climb = F.aggregate("edges", F.lit(0.0), lambda t, e: t + e["y2"] - e["y1"])
    attrs = F.lit(0)
    for c in polygons.columns:
        if c not in ("poly_idx", "rings"):
            text = F.col(f"`{c}`").cast("string")
            attrs = attrs + F.coalesce(F.octet_length(text), F.lit(0))
    side = F.when(_side() > 0, _side()).otherwise(1.0)
    rows = (
        _with_edges(polygons)
        .select(F.ceil(F.log2(side)).alias("k"), F.size("edges").alias("edges"),
                climb.alias("climb"), attrs.alias("attr_bytes"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("edges").alias("edges"),
             F.sum("climb").alias("climb"), F.max("attr_bytes").alias("attr_bytes"),
             F.max("edges").alias("most"))
        .orderBy("k")
        .collect()
    )
    return [
        SizeClass(2.0 ** r["k"], r["n"], r["edges"], r["climb"], r["attr_bytes"], r["most"])
        for r in rows
    ]


def choose_grid(profile: Sequence[SizeClass], cell: float | None = None) -> Grid:
    """Cell size from the median polygon; finer cells for longer rings.

    Cells are made coarser while that makes the index small enough to broadcast; a layer too
    large for that keeps the fine cells and is shuffled.
    """
    if not profile:
        return Grid(cell or 1.0, 1, 0)
    if cell is not None:
        return _bounded(profile, 2.0 ** math.ceil(math.log2(cell)))
    count, seen, median = sum(c.n for c in profile), 0, profile[-1].side
    for c in profile:
        seen += c.n
        if 2 * seen >= count:
            median = c.side
            break
    ring = sum(c.edges for c in profile) / count
    per_side = 2.0 ** round(math.log2(min(16.0, max(4.0, 2 * math.sqrt(ring)))))
    finest = median / per_side
    options = [_bounded(profile, finest * 2**k) for k in range(int(math.log2(per_side)) + 1)]
    return next((g for g in options if g.fits_broadcast), options[0])


def plan_grid(polygons: DataFrame, cell: float | None = None) -> Grid:
    return choose_grid(layer_profile(polygons), cell)


def _bounded(profile: Sequence[SizeClass], cell: float) -> Grid:
    tiers, reach = 1, MAX_CELLS_PER_SIDE * cell
    while profile[-1].side > reach:
        tiers, reach = tiers + 1, reach * MAX_CELLS_PER_SIDE
    total = 0.0
    for c in profile:
        size, reach = cell, MAX_CELLS_PER_SIDE * cell
        while c.side > reach:
            size, reach = size * MAX_CELLS_PER_SIDE, reach * MAX_CELLS_PER_SIDE
        across = c.side / size + 2
        # Every edge is kept in the rows of cells it spans, at most once per cell of the row.
        total += c.n * across**2 * (CELL_BYTES + c.attr_bytes)
        total += (c.climb / size + 2 * c.edges) * across * EDGE_BYTES
    most = max(c.most_edges for c in profile)
    levels = 0
    if most > MOST_EDGES:
        # So many that the longest ring, all in one cell, leaves a quarter of ``MOST_EDGES`` in each.
        levels = min(LEVELS, math.ceil(math.log(4 * most / MOST_EDGES, SPLIT)))
    return Grid(cell, tiers, int(total), levels)


@dataclass(frozen=True)
class PolygonIndex:
    """Cells of a layer: ``cell, cx, cy, poly_idx``, its attributes and the ``edges`` that matter."""

    rows: DataFrame
    grid: Grid
    attrs: tuple[str, ...]

    def where(self, condition: Column | str) -> PolygonIndex:
        """The polygons that meet a condition on the attributes."""
        return PolygonIndex(self.rows.where(condition), self.grid, self.attrs)


def index_polygons(
    polygons: DataFrame, attrs: Sequence[str], grid: Grid | None = None,
    last_only: bool = False, stage: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> PolygonIndex:
    """The index of a layer; ``last_only`` leaves out polygons that are never a ``last`` match.

    ``stage`` may write the cells and give them back. Where cells were divided, one aggregate over
    them measures the index and finds the cell sizes it has.
    """
    layer = polygon_layer(polygons, attrs)
    grid = grid or plan_grid(layer)
    if last_only:
        layer = last_of_same_rings(layer, attrs)
    rows = stage(grid_rows(layer, grid, attrs))
    return PolygonIndex(rows, measured(rows, grid) if grid.levels else grid, tuple(attrs))


def measured(rows: DataFrame, grid: Grid) -> Grid:
    """The grid with the bytes and the cell sizes of its rows, of which there are few."""
    size = F.lit(CELL_BYTES) + F.greatest(F.size("edges"), F.lit(0)) * EDGE_BYTES
    for c in rows.columns:
        if c not in ("cell", "cx", "cy", "poly_idx", "edges"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    found = rows.groupBy("cell").agg(F.sum(size.cast("bigint")).alias("bytes")).collect()
    sizes = tuple(sorted((r["cell"] for r in found), reverse=True))
    return replace(grid, index_bytes=sum(r["bytes"] for r in found), sizes=sizes or (grid.cell,))


def grid_rows(polygons: DataFrame, grid: Grid, attrs: Sequence[str]) -> DataFrame:
    """One row per polygon and cell it reaches into, over all tiers and levels."""
    edged = _with_edges(polygons).withColumn("cell", _cell_size(grid))
    kept = ["cell", "cx", "cy", "poly_idx", *[a for a in attrs if a != "poly_idx"], "edges"]
    c = F.col("cell")
    rows = edged.withColumn("cy", F.explode(_cells("y0", "y1", c))).withColumn(
        "edges", F.filter("edges", _in_row)
    )
    cells = rows.withColumn("cx", F.explode(_cells("x0", "x1", c))).withColumn(
        "edges", F.filter("edges", _not_left)
    )
    known = _known()
    cells = cells.withColumn("fresh", F.lit(True)).withColumn("edges", known).select(*kept)
    steps = [*_division(), ("edges", known)] if grid.levels else []
    for _ in range(grid.levels):
        for name, column in steps:
            cells = cells.withColumn(name, column)
        cells = cells.select(*kept)
    return cells


def _in_row(e: Column) -> Column:
    c, low = F.col("cell"), F.col("cy") * F.col("cell")
    return (e["y2"] >= low) & (e["y1"] <= low + c)


def _not_left(e: Column) -> Column:
    return F.greatest(e["x1"], e["x2"]) >= F.col("cx") * F.col("cell")


def _division() -> list[tuple[str, Column]]:
    """Steps that cut crowded cells into ``SPLIT`` by ``SPLIT`` smaller ones, marked ``fresh``.

    The other cells stay as they are.
    """
    crowded = F.coalesce(F.size("edges") > MOST_EDGES, F.lit(False))
    parts = F.when(F.col("fresh"), F.lit(SPLIT)).otherwise(F.lit(1))

    def within(at: str) -> Column:
        first = F.col(at) * parts
        return F.explode(F.sequence(first, first + parts - 1))

    def held(condition: Callable[[Column], Column]) -> Column:
        return F.when(F.col("fresh"), F.filter("edges", condition)).otherwise(F.col("edges"))

    return [
        ("fresh", crowded), ("cell", F.col("cell") / parts),
        ("cy", within("cy")), ("edges", held(_in_row)),
        ("cx", within("cx")), ("edges", held(_not_left)),
    ]


def _known() -> Column:
    """The edges that reach into a fresh cell; a cell no polygon covers gives no row.

    A ray from inside a cell meets what lies right of it by height alone, and rings are closed, so edges
    there that follow each other meet it like one. They become few upright edges, over the heights at
    which a ray meets an odd number of them. A cell that is covered as a whole keeps no edges.
    """
    fresh, c = F.col("fresh"), F.col("cell")
    left, right, low = F.col("cx") * c, (F.col("cx") + 1) * c, F.col("cy") * c

    def beyond(e: Column) -> Column:
        return F.least(e["x1"], e["x2"]) > right

    ends = F.flatten(F.transform(
        F.filter("edges", beyond),
        lambda e: F.array(F.greatest(e["y1"], low), F.least(e["y2"], low + c)),
    ))

    def drawn(s: Column) -> Column:
        x = right + c
        upright = F.transform(
            F.filter(s["turns"], lambda _, i: i % 2 == 0),
            lambda y, i: F.struct(
                x.alias("x1"), y.alias("y1"), x.alias("x2"),
                F.get(s["turns"], 2 * i + 1).alias("y2"),
            ),
        )
        return F.struct(
            (F.size(s["near"]) > 0).alias("cut"), F.concat(s["near"], upright).alias("edges")
        )

    def reached(s: Column) -> Column:
        inside = crossings(left + c / 2, low + c / 2, s["edges"])
        return s["cut"] | (F.pmod(inside, F.lit(2)) == 1)

    # Arrays of one element or none: each step is computed once, and the generator keeps the
    # optimizer from repeating it in a filter.
    near = F.filter("edges", lambda e: ~beyond(e))
    cell = F.array(F.struct(near.alias("near"), odd_times(ends).alias("turns")))
    cell = F.filter(F.transform(cell, drawn), reached)
    cell = F.transform(cell, lambda s: F.when(s["cut"], s["edges"]))
    same = F.array(F.col("edges"))
    return F.explode(F.when(fresh, cell).otherwise(same))


def odd_times(numbers: Column) -> Column:
    """The values an array holds an odd number of times, in order."""

    def step(found: Column, value: Column) -> Column:
        again = F.get(found, F.size(found) - 1) == value
        return F.when(again, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(
            F.concat(found, F.array(value))
        )

    return F.aggregate(F.sort_array(numbers), F.array().cast("array<double>"), step)


def _cells(low: str, high: str, c: Column) -> Column:
    return F.sequence(F.floor(F.col(low) / c), F.floor(F.col(high) / c))


def last_of_same_rings(polygons: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Of polygons with identical rings only the last can be a ``last`` match."""
    rest = [a for a in attrs if a != "poly_idx"]
    last = F.max(F.struct("poly_idx", *rest)).alias("last")
    return polygons.groupBy("rings").agg(last).select("rings", "last.*")


def attach_polygons(
    points: DataFrame,
    polygons: DataFrame | PolygonIndex,
    attrs: Sequence[str],
    match: str = "last",
    xy: tuple[str, str] = ("x", "y"),
    grid: Grid | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Left-join polygon attributes to points by containment, the boundary included.

    ``last`` keeps one row per point and takes the covering polygon with the largest
    ``poly_idx``; ``all`` gives one row per covering polygon. Points without coordinates or
    without a polygon stay, with NULL attributes.

    ``polygons`` is a layer or an index made before. The index is broadcast only when its bound
    fits; otherwise coordinates and index are shuffled by cell and a crowded cell is split by the
    adaptive skew join.
    """
    if match not in ("last", "all"):
        raise ValueError(f"unknown match {match!r}")
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    taken = {c.lower() for c in points.columns}
    clash = [a for a in (*attrs, *WORK_COLUMNS) if a.lower() in taken]
    if clash:
        raise ValueError(f"the points already have the columns {', '.join(clash)}")
    if isinstance(polygons, PolygonIndex):
        index = polygons
    else:
        layer = polygon_layer(polygons, attrs)
        grid = grid or plan_grid(layer)
        alone = match == "last" and (strategy == "shuffle" or not grid.fits_broadcast)
        index = index_polygons(polygons, attrs, grid, last_only=alone)
    if strategy == "broadcast" and not index.grid.fits_broadcast:
        raise ValueError(f"an index of up to {index.grid.index_bytes} bytes is not broadcast")
    broadcast = strategy != "shuffle" and index.grid.fits_broadcast

    kept = [F.col(f"`{c}`") for c in points.columns]
    x, y = (null_if_nan(F.col(c)) for c in xy)
    # Adding zero makes -0.0 a plain zero.
    placed = points.withColumns({"px": x + F.lit(0.0), "py": y + F.lit(0.0)})
    places = placed.where(F.col("px").isNotNull() & F.col("py").isNotNull()).select(
        "px", "py"
    ).distinct()
    found = covering(places, index, attrs, broadcast)
    if match == "last":
        found = found.groupBy("px", "py").agg(F.max("hit").alias("hit"))
    hits = found.select(
        F.col("px").alias("hit_x"), F.col("py").alias("hit_y"), F.lit(0).cast("bigint").alias(
            "hit_salt"), "hit",
    )
    # Points without coordinates match nothing; their salt spreads them over all tasks.
    plain = [
        f.name for f in points.schema.fields
        if f.dataType.typeName() not in ("array", "map", "struct", "variant")
    ]
    nowhere = F.col("px").isNull() | F.col("py").isNull()
    salted = placed.withColumn(
        "point_salt",
        F.when(nowhere, F.xxhash64(*[F.col(f"`{p}`") for p in plain])).otherwise(F.lit(0)),
    )
    same = (
        (F.col("px") == F.col("hit_x")) & (F.col("py") == F.col("hit_y"))
        & (F.col("point_salt") == F.col("hit_salt"))
    )
    return salted.join(hits, same, "left").select(
        *kept, *[F.col(f"hit.{a}").alias(a) for a in attrs]
    )


def covering(
    places: DataFrame, index: PolygonIndex, attrs: Sequence[str], broadcast: bool = False
) -> DataFrame:
    """``px, py, hit``: every polygon that covers a place, ``poly_idx`` first in ``hit``."""
    rest = [a for a in attrs if a != "poly_idx"]
    rows = index.rows.select(
        F.col("cell").alias("index_cell"), F.col("cx").alias("index_x"),
        F.col("cy").alias("index_y"), F.struct("poly_idx", *rest).alias("hit"), "edges",
    )
    sizes = [F.lit(size) for size in index.grid.cell_sizes]
    cells = places.withColumn("cell", F.explode(F.array(*sizes))).withColumns(
        {"cx": F.floor(F.col("px") / F.col("cell")), "cy": F.floor(F.col("py") / F.col("cell"))}
    )
    rows = F.broadcast(rows) if broadcast else rows.hint("merge")
    match = (
        (F.col("cx") == F.col("index_x")) & (F.col("cy") == F.col("index_y"))
        & (F.col("cell") == F.col("index_cell"))
    )
    inside = F.col("edges").isNull() | covers(F.col("px"), F.col("py"), F.col("edges"))
    return cells.join(rows, match).where(inside).select("px", "py", "hit")
