"""Tile archives as a data source: runs, refusals, pruned leaves, and a file too large to hold."""

import gzip
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, Not

import __spark_entry__ as entry
from tilewright.functions import addressing
from tilewright.functions.inflate import inflate
from tilewright.plans.archives import directory, small_archive
from tilewright.sources import archive, archive_source


def test_runs_and_refusals(spark, tmp_path):
    body = small_archive([1, 2, 3], [b"abc", b"abc", b"defg"])
    (tmp_path / "a b.pmtiles").write_bytes(body)
    found = archive_source.scan(spark, str(tmp_path))
    assert {(r["tile_id"], r["bytes"], bytes(r["payload"])) for r in found.collect()} == {(1, 3, b"abc"), (2, 3, b"abc"), (3, 4, b"defg")}
    assert found.where("z >= 2").count() == 0 and archive_source.inventory(spark, str(tmp_path)).first()["has_vector_layers"]
    assert {(r["bytes"], r["payload"]) for r in archive_source.scan(spark, str(tmp_path), payload=False).collect()} == {(3, None), (4, None)}
    head = archive.parse_header(body, len(body))
    assert (head.kind, head.min_zoom, head.max_zoom) == ("mvt", 1, 1)
    for bad in (b"PMTiles\x02" + body[8:], body[:99] + b"\x07" + body[100:], body[:97] + b"\x03" + body[98:], body[:100] + b"\x05\x02" + body[102:], body[:-2]):
        with pytest.raises(ValueError):
            archive.parse_header(bad, len(bad))
    (tmp_path / "a b.pmtiles").write_bytes(body[:-1])
    with pytest.raises(Exception, match="bad sections"):
        archive_source.scan(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        archive_source.scan(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize(
    "raw",
    [b"", b"\x00", b"\x01\x05\x01\x00\x01", directory([(5, 1, 3, 0)]) + b"\x00", directory([(5, 2, 3, 0), (6, 1, 3, 3)]), directory([(5, 1, 0, 0)]), directory([(5, 1, 98, 3)]), directory([(5, 0, 40, 3)]), directory([(5, 1, 3, 0), (5, 1, 3, 3)]), b"\xff\xff\x7f" + b"\x01" * 40],
)
def test_directories_that_are_refused(raw):
    with pytest.raises(ValueError):
        archive.parse_directory(raw, 30, 100)


def test_inflating_is_bounded():
    assert inflate(gzip.compress(b"ab") + gzip.compress(b"c"), 3) == b"abc"
    bomb = gzip.compress(bytes(50 << 20))
    for bad in (bomb, gzip.compress(b"abcd"), gzip.compress(b"ab")[:-4], b"\x1f\x8bnot gzip at all"):
        with pytest.raises(ValueError):
            inflate(bad, 3)
    with pytest.raises(ValueError):
        archive.inflated(gzip.compress(bytes(archive.MOST_DIRECTORY + 1)), "gzip")
    with pytest.raises(ValueError):
        archive.inflated(b"", "none")


def test_filters_leave_leaves_unread(spark, tmp_path, monkeypatch):
    want = {i: bytes([i % 7]) * (1 + i * 37 % 5000) for i in range(21, 900) if i % 10}
    (tmp_path / "a.pmtiles").write_bytes(small_archive(list(want), list(want.values()), leaf=16))
    (tmp_path / "b.pmtiles").write_bytes(small_archive([5, 6], [b"x", b"x"]))
    got = archive_source.scan(spark, str(tmp_path)).where("z between 3 and 4 and bytes > 100")
    assert {r["tile_id"]: bytes(r["payload"]) for r in got.collect()} == {i: p for i, p in want.items() if i < archive.base(5) and len(p) > 100}
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "z#" not in above.split("Filter")[-1].split("\n")[0] and "bytes#" in above  # z was taken by the source, bytes was not

    class Counting(archive_source.TileArchiveReader):
        seen = 0

        def tile_entries(self, f, h, entries):
            Counting.seen += sum(1 for e in entries if not e[1])
            return super().tile_entries(f, h, entries)

    whole, some = Counting(str(tmp_path)), Counting(str(tmp_path))
    kept = list(some.pushFilters([GreaterThanOrEqual(("tile_id",), 100), LessThan(("tile_id",), 140), Not(EqualTo(("z",), 3)), EqualTo(("bytes",), 3)]))
    assert len(kept) == 2 and (some.low, some.high) == (100, 140)
    rows = [i for p in some.partitions() for b in some.read(p) for i in b.column("tile_id").to_pylist()]
    few, Counting.seen = Counting.seen, 0
    assert rows == [i for i in want if 100 <= i < 140] and few <= 4
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == len(want) + 2 and Counting.seen > 40
    assert list(whole.pushFilters([EqualTo(("z",), 40)])) == [] and whole.partitions() == []


def test_a_large_sparse_file_is_read_by_its_leaves(tmp_path):
    """Leaves of an archive of 20 GB, far apart: tasks by leaves, each reading its own tiles only."""
    n, far = 40, 500 << 20
    leaves, root = b"", []
    for k in range(n):
        leaf = directory([(100_000 + 10 * k, 3, 5, k * far), (100_000 + 10 * k + 5, 1, 7, k * far + 5)])
        root.append((100_000 + 10 * k, 0, len(leaf), len(leaves)))
        leaves += leaf
    at, sections = archive.HEADER, []
    for size in (len(directory(root)), 0, len(leaves), n * far):
        sections += [at, size]
        at += size
    path = tmp_path / "planet.pmtiles"
    with path.open("wb") as f:
        f.write((b"PMTiles\x03" + struct.pack("<11Q", *sections, 0, 0, 0) + bytes([1, 1, 1, 1, 8, 9])).ljust(archive.HEADER, b"\0") + directory(root) + leaves)
        for k in range(n):
            f.seek(sections[6] + k * far)
            f.write(b"%05d" % k + b"%07d" % k)
        f.truncate(at)
    reader = archive_source.TileArchiveReader(str(path))
    parts = reader.partitions()
    assert path.stat().st_size > 19 << 30 and len(parts) == n
    got = {i: bytes(p) for part in parts for b in reader.read(part) for i, p in zip(b.column("tile_id").to_pylist(), b.column("payload").to_pylist(), strict=True)}
    assert got == {100_000 + 10 * k + j: (b"%07d" if j == 5 else b"%05d") % k for k in range(n) for j in (0, 1, 2, 5)}
    list(reader.pushFilters([GreaterThanOrEqual(("tile_id",), 100_015), LessThan(("tile_id",), 100_030)]))
    assert [[e[0] for e in p.entries] for p in reader.partitions()] == [[100_010], [100_020]]


def test_coordinates_of_ids_equal_the_expressions(spark):
    r = random.Random(2)
    ids = [0, 1, 4, 5, *[r.randrange(archive.base(29)) for _ in range(300)], archive.base(31) - 1]
    z, x, y = archive_source.coordinates(np.array(ids, np.int64))
    table = spark.createDataFrame(list(zip(ids, z.tolist(), x.tolist(), y.tolist(), strict=True)), "i long, z int, x long, y long")
    assert table.where(addressing.hilbert_id(F.col("z"), F.col("x"), F.col("y")) != F.col("i")).count() == 0


def test_nothing_to_read_is_no_rows(spark, tmp_path):
    assert archive_source.scan(spark, str(tmp_path)).count() == 0 and archive_source.inventory(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.pmtiles").write_bytes(small_archive([1, 2, 3], [b"abc", b"abc", b"defg"]))
    assert archive_source.scan(spark, str(tmp_path)).where("z > 5 and z < 3").count() == 0


@pytest.mark.parametrize("name", ["content_type", "archive_inventory", "scan_tile_archive"])
def test_no_tile_with_bytes_is_no_archive(spark, tmp_path, name):
    rows = [(k, "" if k % 2 else None, "de", 0) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found.collect() == con.execute(entry.oracle_sql()[name]).fetchall() == []
