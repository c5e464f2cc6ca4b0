"""Anchors past the date line (over 292,400 documents): queries of tiles give the rows of their SQL there too."""

import duckdb
import pytest

import __spark_entry__ as entry

SHIFTS = (0, 340 * 1024, 340 * 1024 * 3 - 85)  # the first world, and two more with the same tiles or some of them
CASES = [
    "archive_inventory",
    "content_type",
    "scan_tile_archive",
    "hilbert_id_to_tile",
    "run_length_directory",
    "directory_lookup",
    "expand_runs",
    "tile_order",
    "write_tile_table",
    "stream_frame",
    "scan_bundle_streams",
    "stage_report",
    "compression_report",
    "explode_bundle_entries",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("worlds"))
    rows = [(k + shift, f"text {k % 7} " * (k % 5), "de" if k % 3 else "en", k % 1000) for shift in SHIFTS for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", CASES)
def test_rows_are_those_of_the_sql(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(f'{c}::VARCHAR' for c in found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = found.select(*[found[c].cast("string") for c in found.columns]).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got) and want
