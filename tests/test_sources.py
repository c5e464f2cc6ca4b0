"""Text lines, the request log, tile tables and reports of stages."""

from __future__ import annotations

import gzip
import struct
import zlib

from tilewright.operators import bundles as B
from tilewright.operators import reports as R
from tilewright.sources import lines, tile_table
from tilewright.sources.scratch import scratch_path


def test_names_of_a_listing(spark, tmp_path):
    (tmp_path / "list.txt").write_text("  a_name \n\n\t\nb\r\na_name")
    assert sorted(r["name"] for r in lines.names(spark, str(tmp_path)).collect()) == ["a_name", "a_name", "b"]


def test_request_log_whole_and_as_a_stream(spark):
    path = scratch_path(spark, "log")
    spark.createDataFrame([(1, 2, "10.0.0.1:80", "GET", "/planet/8/1/1", 0, "more")], lines.REQUESTS + ", other string").write.parquet(path)
    whole, stream = lines.request_log(spark, path), lines.request_log(spark, path, stream=True)
    assert stream.isStreaming and whole.schema == stream.schema and whole.count() == 1 and "other" not in whole.columns


def test_tile_table_keeps_zooms_and_bounds(spark):
    path, tiles = scratch_path(spark, "table"), spark.createDataFrame([(3, 1, 2, b"a"), (0, 0, 0, b"b")], "z int, x long, y long, payload binary")
    tile_table.write(tiles, path, bounds=(5.5, 45.0, 10.5, 47.5))
    table, about = tile_table.read(spark, path)
    assert {r["z"]: r["tile_id"] for r in table.collect()}[0] == 0 and table.count() == 2
    assert about == {
        "min_zoom": 0, "max_zoom": 3, "min_lon_e7": 55000000, "min_lat_e7": 450000000, "max_lon_e7": 105000000, "max_lat_e7": 475000000, "center_zoom": 0, "center_lon_e7": 80000000, "center_lat_e7": 462500000,
    }
    empty = scratch_path(spark, "table")
    tile_table.write(tiles.where("z = 9"), empty)
    assert spark.read.parquet(f"{empty}/metadata").first()["max_zoom"] == 0


def test_reports_give_wire_and_inflated_bytes(spark):
    tiles = [b"a" * 100, None, b"b" * 300, b"c" * 200]
    plain = b"SCB1" + bytes([1, 10, 11, 0]) + struct.pack(">III", 4, 5, 4) + b"".join(b"\xff" * 4 if t is None else struct.pack(">I", len(t)) + t for t in tiles)
    rows = spark.createDataFrame([(4, 5, 11, 0, 11, 0, plain)], "x10 long, y10 long, zoom int, stage_ord int, stage_zoom int, part int, body binary")
    stream = B.frame(rows, 2).first()["stream"]
    entries = B.explode_streams(spark.createDataFrame([(stream,)], "stream binary"))
    packed = len(gzip.compress(plain, mtime=0))
    got = R.stage_report(entries).first().asDict()
    assert got == {"stage_zoom": 11, "part": 0, "tiles": 4, "non_empty": 3, "wire_bytes": packed, "bytes": 600, "median": 200.0, "largest": 300, "p90": 300}
    got = R.compression_report(entries).first().asDict()
    assert got == {"stage_zoom": 11, "raw_bytes": 600, "deflate_bytes": sum(len(zlib.compress(t, 6)) for t in tiles if t), "wire_bytes": packed}
