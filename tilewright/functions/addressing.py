"""Tile addressing as column expressions: coordinates, bounds, ancestors, anchors, Hilbert ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fine detail leaves only as descendants of a zoom-10 anchor, at zooms 11 to 14.
ANCHOR_ZOOM, MAX_ZOOM = 10, 14
EARTH_RADIUS = 6378137.0


def pow2(z: Column) -> Column:
    """2^z as BIGINT, for z of at most 31."""
    return F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), z).cast("long")


def lonlat_to_tile(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """(x, y) of the tile that holds a point. Not clamped: a longitude of 180 or a polar latitude falls outside."""
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(lat)
    x = ((lon + 180.0) / 360.0 * n).cast("long")
    y = ((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n).cast("long")
    return x, y


def tile_latitude(y: Column, z: Column) -> Column:
    """Latitude of the northern edge of tile row y."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / F.pow(F.lit(2.0), z)))))


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Bounds in degrees and in Web Mercator metres."""
    n = F.pow(F.lit(2.0), z)
    metres = 2 * math.pi * EARTH_RADIUS
    return {
        "west": x / n * 360.0 - 180.0, "south": tile_latitude(y + 1, z), "east": (x + 1) / n * 360.0 - 180.0, "north": tile_latitude(y, z),
        "left": (x / n - 0.5) * metres, "bottom": (0.5 - (y + 1) / n) * metres, "right": ((x + 1) / n - 0.5) * metres, "top": (0.5 - y / n) * metres,
    }


def tile_owner_cell(z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of the one-degree cell that holds the middle of the tile's bounds."""
    b = tile_bounds(z, x, y)
    return F.floor((b["south"] + b["north"]) / 2).cast("int"), F.floor((b["west"] + b["east"]) / 2).cast("int")


def ancestor(x: Column, levels: Column) -> Column:
    """Coordinate of the ancestor some levels up."""
    return F.floor(x / pow2(levels)).cast("long")


def world(x: Column, z: Column) -> Column:
    """The copy of the map that a column of tiles lies in: 0 for the map itself; past the date line its columns come again."""
    return ancestor(x, z)


def on_map(x: Column, z: Column) -> Column:
    """The column of the map itself that a column of any copy shows."""
    return F.pmod(x, pow2(z))


def off_map(x: Column, z: Column, world: Column) -> Column:
    """The column of a copy of the map: undoes on_map()."""
    return x + world * pow2(z)


def valid_xyz(z: Column, x: Column, y: Column) -> Column:
    n = pow2(z)
    return (x >= 0) & (y >= 0) & (x < n) & (y < n)


def anchor(z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(x10, y10): the zoom-10 ancestor of a tile at zoom 10 or deeper; null above it."""
    deep = z >= ANCHOR_ZOOM
    return F.when(deep, ancestor(x, z - ANCHOR_ZOOM)), F.when(deep, ancestor(y, z - ANCHOR_ZOOM))


def bundle_side(z: Column) -> Column:
    return pow2(z - ANCHOR_ZOOM)


def bundle_slot(z: Column, x: Column, y: Column) -> Column:
    """Row-major place of a tile among the descendants of its anchor: y outer, x inner."""
    side = bundle_side(z)
    return F.pmod(y, side) * side + F.pmod(x, side)


def level_base(z: Column) -> Column:
    """Number of tiles at all zooms above z: (4^z - 1) / 3, in integers."""
    return F.when(z <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), z), F.lit(0).cast("long"), lambda acc, _: acc * 4 + 1))


def _quadrants(levels: int) -> list[int]:
    """For each state and the next `levels` bits of x and y: four times the curve's digits, plus the state after them.

    A state says whether x and y are exchanged (1) and whether both run backwards (2).
    """
    out, n = [], 1 << levels
    for state in range(4):
        for x in range(n):
            for y in range(n):
                swap, back, digits = state & 1, state >> 1, 0
                for k in range(levels - 1, -1, -1):
                    bx, by = (x >> k) & 1, (y >> k) & 1
                    if swap:
                        bx, by = by, bx
                    rx, ry = bx ^ back, by ^ back
                    digits = digits * 4 + ((3 * rx) ^ ry)
                    if ry == 0:
                        back ^= rx
                        swap ^= 1
                out.append(digits * 4 + (swap | back << 1))
    return out


STEP = 4  # levels of the curve taken at once
_CURVE = _quadrants(STEP)


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Cumulative Hilbert id of a tile; null when z is not in 0..31 or the tile lies outside its zoom.

    32 levels are walked in eight steps of a table, as plain expressions. Levels above the zoom have no
    bits and only exchange the axes, so the walk starts exchanged where their number is odd.
    """
    table = F.array(*[F.lit(v) for v in _CURVE])
    x, y, z = x.cast("long"), y.cast("long"), z.cast("int")
    state, d = F.pmod(z, F.lit(2)), F.lit(0).cast("long")
    n = 1 << STEP
    for k in range(32 // STEP - 1, -1, -1):
        bits = lambda v: F.shiftright(v, STEP * k).bitwiseAND(F.lit(n - 1)).cast("int")  # noqa: B023, E731
        found = F.element_at(table, state * (n * n) + bits(x) * n + bits(y) + 1)
        d = d + F.shiftleft(F.shiftright(found, 2).cast("long"), 2 * STEP * k)
        state = found.bitwiseAND(F.lit(3))
    inside = (z >= 0) & (z <= 31) & valid_xyz(z, x, y)
    return F.when(inside, level_base(z) + d)


def hilbert_zoom(tile_id: Column) -> Column:
    """Zoom of a Hilbert id."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(31)), lambda k: level_base(k) <= tile_id))


def hilbert_tile(tile_id: Column, z: Column) -> Column:
    """struct(x, y) of a Hilbert id, given its zoom."""
    d = tile_id - level_base(z)
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), d.alias("t"))

    def step(acc, s):
        n = pow2(s)
        q = acc["t"] % 4
        rx = F.floor(q / 2)
        ry = F.when(rx == 1, F.when(q == 2, 1).otherwise(0)).otherwise(q)
        fx, fy = F.when(rx == 1, n - 1 - acc["x"]).otherwise(acc["x"]), F.when(rx == 1, n - 1 - acc["y"]).otherwise(acc["y"])
        tx, ty = F.when(ry == 0, fy).otherwise(acc["x"]), F.when(ry == 0, fx).otherwise(acc["y"])
        return F.struct((tx + n * rx).cast("long").alias("x"), (ty + n * ry).cast("long").alias("y"), F.shiftright(acc["t"], 2).alias("t"))

    walk = F.aggregate(F.sequence(F.lit(0), z - 1), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))
    return F.when(z > 0, walk).otherwise(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
