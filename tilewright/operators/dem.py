"""Elevation cells: listing, priority, cover, resampling, progress.

Samples are blocks, one for each cell; a cell's task makes its tiles from its own block and strips of its neighbours'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import addressing as A
from tilewright.functions.terrain import POLAR, dem_name
from tilewright.operators.blocks import BLOCKS, packed, table, terrarium, to_pixels
from tilewright.operators.pyramid import pyramid
from tilewright.sources import tile_table
from tilewright.sources.scratch import commit

# Latitude of the edge of the map, and the value of samples without data.
EDGE, NODATA = 85.0511, -32767.0


def cells(listing: DataFrame) -> DataFrame:
    """listing (name, resolution) as cells (lat, lon, resolution), blank lines left out."""
    lat, lon = dem_name(F.col("name"))
    return listing.where(F.trim("name") != "").select(lat.alias("lat"), lon.alias("lon"), "resolution").distinct()


def cell_filter(cells_: DataFrame, bbox: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Without the polar cells and, given a box (west, south, east, north), those that do not overlap it."""
    out = cells_.where((F.abs("lat") < POLAR) & (F.abs(F.col("lat") + 1) < POLAR))
    if bbox:
        w, s, e, n = bbox
        out = out.where((F.col("lon") < e) & (F.col("lon") + 1 > w) & (F.col("lat") < n) & (F.col("lat") + 1 > s))
    return out


def priority(cells_: DataFrame) -> DataFrame:
    """The 30 m cells, and 90 m cells where there is no 30 m one."""
    fine, coarse = cells_.where("resolution = 30"), cells_.where("resolution = 90")
    return fine.unionByName(coarse.join(fine.select("lat", "lon"), ["lat", "lon"], "left_anti"))


def cover(cells_: DataFrame, zoom: int) -> DataFrame:
    """(lat, lon, x, y): the tiles whose middle lies in the cell, each tile once.

    The tiles of a cell's own box, a ring wider, are listed and joined to the cell they belong to: the
    rule "middle in cell" becomes an equality.
    """
    n = float(2**zoom)
    z = F.lit(zoom)
    lat = lambda v: F.least(F.lit(EDGE), F.greatest(F.lit(-EDGE), v))
    x0, y0 = A.lonlat_to_tile(F.col("lon").cast("double"), lat(F.col("lat") + 1.0), z)
    x1, y1 = A.lonlat_to_tile(F.col("lon") + 1.0, lat(F.col("lat").cast("double")), z)
    clip = lambda v: F.least(F.lit(int(n) - 1).cast("long"), F.greatest(F.lit(0).cast("long"), v))
    out = cells_.select("lat", "lon").distinct().withColumn("x", F.explode(F.sequence(clip(x0 - 1), clip(x1 + 1)))).withColumn("y", F.explode(F.sequence(clip(y0 - 1), clip(y1 + 1))))
    own_lat, own_lon = A.tile_owner_cell(z, F.col("x"), F.col("y"))
    return out.where((own_lat == F.col("lat")) & (own_lon == F.col("lon"))).select("lat", "lon", "x", "y")


# A block of samples: of one cell (its south-west corner lat, lon) and one grid (step in degrees), row0 and col0 the
# place of its first sample in the grid of the whole earth, rows from the south, 32-bit metres, NODATA where there is none.
PARTS = "lat int, lon int, step double, row0 long, col0 long, rows int, cols int, block binary"
SAMPLE = np.dtype("<f4")
MARGIN = 2  # samples around a tile that it is given


def sample_blocks(samples: DataFrame) -> DataFrame:
    """Samples (lat, lon, step, metres) as blocks, a row for each cell and step; of samples at one place the highest counts."""

    def cell(t: pa.Table) -> pa.Table:
        step = t["step"][0].as_py()
        row, col = (np.rint(t[c].to_numpy() / step).astype(np.int64) for c in ("lat", "lon"))
        metres = t["metres"].to_numpy().astype(np.float64)
        grid = np.full((row.max() - row.min() + 1, col.max() - col.min() + 1), -np.inf)
        held = ~np.isnan(metres) & (metres != NODATA)
        np.maximum.at(grid, (row[held] - row.min(), col[held] - col.min()), metres[held])
        grid[np.isneginf(grid)] = NODATA
        at = [int(np.floor(t[c].to_numpy().min())) for c in ("lat", "lon")]
        return parts([(*at, step, int(row.min()), int(col.min()), grid)])

    return samples.groupBy(F.floor("lat"), F.floor("lon"), "step").applyInArrow(cell, PARTS)


def parts(rows: list[tuple]) -> pa.Table:
    lat, lon, step, row0, col0, grid = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
    return pa.table({
        "lat": pa.array(lat, pa.int32()), "lon": pa.array(lon, pa.int32()), "step": pa.array(step, pa.float64()), "row0": pa.array(row0, pa.int64()), "col0": pa.array(col0, pa.int64()),
        "rows": pa.array([g.shape[0] for g in grid], pa.int32()), "cols": pa.array([g.shape[1] for g in grid], pa.int32()), "block": pa.array([g.astype(SAMPLE).tobytes() for g in grid], pa.binary()),
    })


def middle_latitude(y: np.ndarray, n: float) -> np.ndarray:
    """Latitude of map row y (in tiles or pixels from the north) of n."""
    return np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / n))))


def tile_rows(lat: np.ndarray, n: float) -> np.ndarray:
    phi = np.radians(np.clip(lat, -EDGE, EDGE))
    return (1 - np.log(np.tan(phi) + 1 / np.cos(phi)) / np.pi) / 2 * n


def touched(at: np.ndarray, pad: float, zoom: int, upright: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last tile (column, or row if upright) that samples at these degrees touch, pad degrees around."""
    n = 2.0**zoom
    low, high = (tile_rows(at + pad, n), tile_rows(at - pad, n)) if upright else ((at - pad + 180.0) / 360.0 * n, (at + pad + 180.0) / 360.0 * n)
    clip = lambda v: np.clip(np.floor(v), 0, n - 1).astype(np.int64)
    return clip(low), clip(high)


def halo(blocks: DataFrame, zoom: int) -> DataFrame:
    """Blocks of samples, each cut to what the tiles of a cell (lat, lon) touch of it: the cell's own whole, of others the edges.

    A tile belongs to the cell that holds its middle, so it reaches half a tile beyond the cell, and MARGIN samples
    further. Only that strip goes from a cell to its neighbour.
    """

    def route(batches):
        n = 2.0**zoom
        for batch in batches:
            for p in batch.to_pylist():
                grid = np.frombuffer(p["block"], SAMPLE).reshape(p["rows"], p["cols"])
                step = p["step"]
                lat, lon = (p["row0"] + np.arange(p["rows"])) * step, (p["col0"] + np.arange(p["cols"])) * step
                (y0, y1), (x0, x1) = touched(lat, step * MARGIN, zoom, True), touched(lon, step * MARGIN, zoom, False)
                ys, xs = np.arange(y0.min(), y1.max() + 1), np.arange(x0.min(), x1.max() + 1)
                # the cells that own the tiles touched; which samples each of them needs
                own_y = np.floor((middle_latitude(ys, n) + middle_latitude(ys + 1, n)) / 2).astype(np.int64)
                own_x = np.floor((xs / n * 360.0 - 180.0 + (xs + 1) / n * 360.0 - 180.0) / 2).astype(np.int64)
                need_y = {int(c): np.flatnonzero((y0 <= ys[own_y == c].max()) & (y1 >= ys[own_y == c].min())) for c in np.unique(own_y)}
                need_x = {int(c): np.flatnonzero((x0 <= xs[own_x == c].max()) & (x1 >= xs[own_x == c].min())) for c in np.unique(own_x)}
                for cy, rows in need_y.items():
                    for cx, cols in need_x.items():
                        cut = grid[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
                        yield from parts([(cy, cx, step, p["row0"] + int(rows[0]), p["col0"] + int(cols[0]), cut)]).to_batches()

    return blocks.select("lat", "lon", "step", "row0", "col0", "rows", "cols", "block").mapInArrow(route, PARTS)


def mosaics(t: pa.Table) -> list[tuple[float, int, int, np.ndarray]]:
    """(step, row0, col0, grid) of the parts of a cell, finest first; NaN where there is no sample."""
    out = []
    rows = t.to_pylist()
    for step in sorted({p["step"] for p in rows}):
        mine = [p for p in rows if p["step"] == step]
        r0, c0 = min(p["row0"] for p in mine), min(p["col0"] for p in mine)
        grid = np.full((max(p["row0"] + p["rows"] for p in mine) - r0, max(p["col0"] + p["cols"] for p in mine) - c0), np.nan, SAMPLE)
        for p in mine:
            part = np.frombuffer(p["block"], SAMPLE).reshape(p["rows"], p["cols"])
            at = grid[p["row0"] - r0 : p["row0"] - r0 + p["rows"], p["col0"] - c0 : p["col0"] - c0 + p["cols"]]
            np.fmax(at, np.where(part == SAMPLE.type(NODATA), np.nan, part), out=at)
        out.append((step, r0, c0, grid))
    return out


def _cells_of(routed: DataFrame, zoom: int, cells_: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Routed parts and tiles (lat, lon, x, y), of the cells given or else of all that parts are routed to."""
    if cells_ is None:
        return routed, cover(routed.select("lat", "lon").distinct(), zoom)
    wanted = cells_.select(F.col("lat").cast("int").alias("lat"), F.col("lon").cast("int").alias("lon")).distinct()
    return routed.join(wanted, ["lat", "lon"], "left_semi"), cover(wanted, zoom)


def reach(blocks: DataFrame, zoom: int, cells_: DataFrame | None = None) -> DataFrame:
    """(x, y, samples): the number of samples with data that each tile is given, margin included; tiles without any are left out."""

    def count(parts_: pa.Table, tiles: pa.Table) -> pa.Table:
        found = []
        for step, r0, c0, grid in mosaics(parts_):
            lat, lon = (r0 + np.arange(grid.shape[0])) * step, (c0 + np.arange(grid.shape[1])) * step
            (y0, y1), (x0, x1) = touched(lat, step * MARGIN, zoom, True), touched(lon, step * MARGIN, zoom, False)
            held = ~np.isnan(grid)
            for x, y in zip(tiles["x"].to_pylist(), tiles["y"].to_pylist(), strict=True):
                n = int(held[np.ix_((y0 <= y) & (y <= y1), (x0 <= x) & (x <= x1))].sum())
                found += [(x, y, n)] if n else []
        x, y, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "samples": pa.array(n, pa.int64())})

    routed, tiles = _cells_of(halo(blocks, zoom), zoom, cells_)
    return routed.groupBy("lat", "lon").cogroup(tiles.groupBy("lat", "lon")).applyInArrow(count, "x long, y long, samples long").groupBy("x", "y").agg(F.sum("samples").alias("samples"))


def resample_blocks(blocks: DataFrame, zoom: int, size: int, cells_: DataFrame | None = None) -> DataFrame:
    """Blocks of the tiles of cells (lat, lon): bilinear between the samples of regular grids at pixel middles.

    Grids of unlike steps are resampled each for itself, and the finest one that reaches a pixel gives it. Missing samples
    are left out of the weights; a pixel without any is 0; a tile without a pixel above the sea has no row.
    """

    def bake_cell(parts_: pa.Table, tiles: pa.Table) -> pa.Table:
        grids, out, n = mosaics(parts_), [], 2.0**zoom * size
        for x, y in zip(tiles["x"].to_pylist(), tiles["y"].to_pylist(), strict=True):
            plon = (np.arange(x * size, (x + 1) * size) + 0.5) / n * 360 - 180
            plat = middle_latitude(np.arange(y * size, (y + 1) * size) + 0.5, n)
            pixels, have = np.zeros((size, size)), np.zeros((size, size), bool)
            for step, r0, c0, grid in grids:
                v, u = np.meshgrid(plat / step, plon / step, indexing="ij")
                i, j = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
                total, weight = np.zeros(v.shape), np.zeros(v.shape)
                for di in (0, 1):
                    for dj in (0, 1):
                        a, b = i + di, j + dj
                        ok = (a >= r0) & (b >= c0) & (a < r0 + grid.shape[0]) & (b < c0 + grid.shape[1])
                        g = np.where(ok, grid[np.clip(a - r0, 0, grid.shape[0] - 1), np.clip(b - c0, 0, grid.shape[1] - 1)], np.nan).astype(np.float64)
                        w = np.where(np.isnan(g), 0, (1 - np.abs(v - a)) * (1 - np.abs(u - b)))
                        total += w * np.nan_to_num(g)
                        weight += w
                new = (weight > 0) & ~have
                pixels[new] = total[new] / weight[new]
                have |= new
            if (pixels > 0.5).any():
                out.append((zoom, x, y, packed(pixels)))
        return table(out)

    routed, tiles = _cells_of(halo(blocks, zoom), zoom, cells_)
    return routed.groupBy("lat", "lon").cogroup(tiles.groupBy("lat", "lon")).applyInArrow(bake_cell, BLOCKS)


def resample(samples: DataFrame, zoom: int, size: int) -> DataFrame:
    """Pixels (z, gx, gy, metres) of all tiles that samples (lat, lon, step, metres) touch."""
    return to_pixels(resample_blocks(sample_blocks(samples), zoom, size), size)


def bake(cells_: DataFrame, blocks: DataFrame, staged: DataFrame, done: DataFrame, zoom: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(staged blocks, ledger) after baking the cells that the ledger (unit) lacks at this zoom, from blocks of samples.

    Units are named by zoom and cell. The tiles of pending cells alone are resampled; they replace staged tiles of
    the same place. Tiles are committed before the ledger, so a bake that is cut short is done again.
    """
    unit = F.concat(F.lit(f"z{zoom}:"), "lat", F.lit(","), "lon")
    todo = commit(pending(cells_.select("lat", "lon", unit.alias("unit")).distinct(), done), "todo")
    made = resample_blocks(blocks, zoom, size, todo)
    kept = staged.join(cover(todo, zoom).select(F.lit(zoom).alias("z"), "x", "y"), ["z", "x", "y"], "left_anti")
    return commit(kept.select("z", "x", "y", "block").unionByName(made), "staged"), commit(done.select("unit").unionByName(todo.select("unit")), "ledger")


def publish(staged: DataFrame, path: str, size: int, bounds: tuple[float, float, float, float] | None = None) -> None:
    """The pyramid over staged blocks as a table of colour tiles with zooms and bounds under `path`."""
    tile_table.write(terrarium(pyramid(staged, size)), path, bounds=bounds)


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    return units.join(done.select("unit").distinct(), "unit", "left_anti")


def progress(units: DataFrame, done: DataFrame) -> DataFrame:
    """Per level: done, total, seconds a unit over the ledger's span, and seconds left at that rate."""
    level = lambda df: df.select(F.split("unit", ":")[0].alias("level"), *df.columns)
    total = level(units).groupBy("level").agg(F.count("*").alias("total"))
    first = level(done).groupBy("level", "unit").agg(F.min("done_at").alias("at"))
    got = first.groupBy("level").agg(F.count("*").alias("done"), (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))).alias("_us"))
    out = total.join(got, "level", "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    rate = F.round(F.col("_us") / 1e6 / F.col("done"), 6)
    return out.select("level", "done", "total", rate.alias("seconds_each"), F.round((F.col("total") - F.col("done")) * (F.col("_us") / 1e6 / F.col("done")), 4).alias("seconds_left"))
