"""Elevation expressions: names of cells, Terrarium colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset of the colour code, and the latitude beyond which there are no map tiles.
OFFSET, POLAR = 32768, 86


def dem_name(name: Column) -> tuple[Column, Column]:
    """(lat, lon) of the south-west corner from a name like Copernicus_DSM_COG_10_N35_00_E135_00_DEM."""
    part = F.split(F.trim(name), "_")
    read = lambda k, minus: F.substring(part[k], 2, 10).cast("int") * F.when(part[k].startswith(minus), -1).otherwise(1)
    return read(4, "S"), read(6, "W")


def terrarium_encode(metres: Column) -> dict[str, Column]:
    """r and g of whole metres (b is 0): rounded half to even, clipped to 16 bits."""
    v = (F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.rint(metres))) + OFFSET).cast("int")
    return {"r": F.shiftright(v, 8), "g": v.bitwiseAND(255), "b": F.lit(0)}


def terrarium_decode(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - OFFSET
