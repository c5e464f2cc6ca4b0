"""Archive directories: runs of equal content, lookup by interval, audits, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.sources.scratch import commit

# Ids are cut into ranges of this many bits: windows stay inside a range, and a second pass joins the seams.
RANGE_BITS = 16


def run_length_directory(tiles: DataFrame, *keys: str) -> DataFrame:
    """(tile_id, run, length, digest): consecutive ids of equal content as one entry; with keys, a directory for each of their values.

    tiles has the keys, tile_id, digest and length. An entry is what has the same difference of id and rank among the ids of
    its content. Ranks are those inside a range of ids and the counts of the ranges before it, so no window spans the table.
    An id that comes more than once is as many ranks, and moves the entries after it: only ids that come once are sure to be
    those that expand_runs() gives back.
    """
    ids = tiles.groupBy(*keys, "digest", "tile_id", "length").agg(F.count("*").alias("_n")).withColumn("_r", F.shiftright("tile_id", RANGE_BITS))
    content = [*keys, "digest"]
    earlier = Window.partitionBy(*content).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = ids.groupBy(*content, "_r").agg(F.sum("_n").alias("_c")).select(*content, "_r", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy(*content, "_r").orderBy("tile_id", "length").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ids.withColumn("_upto", upto).join(before, [*content, "_r"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    rank = F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto")))
    runs = ranked.withColumn("_rank", rank).groupBy(*content, "length", (F.col("tile_id") - F.col("_rank")).alias("_i")).agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run"))
    return runs.select(*keys, "tile_id", "run", "length", "digest")


def pieces(directory: DataFrame, bits: int) -> DataFrame:
    """Each entry cut at the borders of ranges of 2^bits ids: _low and _high (both in it) of each piece, with the entry's columns.

    Long runs are cut first at the borders of ranges of 2^(bits + 16), so a row gives 65,536 pieces at most and a
    run of any length is dealt out in between.
    """
    cols = directory.columns
    out = directory.select(*cols, F.col("tile_id").alias("_low"), (F.col("tile_id") + F.col("run") - 1).alias("_high"))
    for width in (bits + 16, bits):
        piece = F.explode(F.sequence(F.shiftright("_low", width), F.shiftright("_high", width)))
        edge = F.shiftleft(F.col("_k"), width)
        out = out.withColumn("_k", piece).select(*cols, F.greatest("_low", edge).alias("_low"), F.least("_high", edge + (1 << width) - 1).alias("_high"))
        if width > bits:
            out = out.repartition(*cols, "_low")
    return out


def expand_runs(directory: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """A row for each id of each entry. Runs are cut at range borders and dealt out before they are expanded."""
    rest = [c for c in directory.columns if c != "tile_id"]
    cut = pieces(directory.where("run > 0"), bits)
    return cut.select(F.explode(F.sequence("_low", "_high")).alias("tile_id"), *rest).select(directory.columns)


def dyadic_cover(directory: DataFrame) -> DataFrame:
    """Each entry as dyadic intervals: _level and _node (the ids from _node * 2^_level on, 2^_level of them); at most two of a level.

    The interval is eaten up from both ends: an odd start, or an end that leaves the first half of its parent, is a node
    of its level; what is left goes on with the parents.
    """
    step = lambda acc, k: F.struct(
        F.shiftright(acc["lo"] + 1, 1).alias("lo"), F.shiftright(acc["hi"], 1).alias("hi"),
        F.concat(
            acc["out"],
            F.when((acc["lo"] < acc["hi"]) & (acc["lo"] % 2 == 1), F.array(F.struct(k.cast("int").alias("level"), acc["lo"].alias("node")))).otherwise(none),
            F.when((acc["lo"] + acc["lo"] % 2 < acc["hi"]) & (acc["hi"] % 2 == 1), F.array(F.struct(k.cast("int").alias("level"), (acc["hi"] - 1).alias("node")))).otherwise(none),
        ).alias("out"),
    )
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(F.col("tile_id").alias("lo"), (F.col("tile_id") + F.col("run")).alias("hi"), none.alias("out"))
    # no level above the length of the run has a node
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("run").cast("double"))).cast("int"))
    nodes = F.aggregate(levels, start, step, lambda acc: acc["out"])
    return directory.where("run > 0").withColumn("_n", F.explode(nodes)).select(*directory.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))


def lookup(ids: DataFrame, directory: DataFrame) -> DataFrame:
    """ids (tile_id) with the entry that holds them (null where none does).

    Entries are posted under the nodes of their dyadic cover, which grow as the logarithm of a run; an id asks for its
    ancestor at each level that some entry has. A join of equal keys: no id meets an entry that does not hold it.
    """
    entries = commit(dyadic_cover(directory.select(F.col("tile_id"), "run", "length", "digest")), "cover")
    levels = [r["_level"] for r in entries.select("_level").distinct().collect()]  # 63 rows at most
    rows = commit(ids.withColumn("_row", F.monotonically_increasing_id()), "asked")
    asked = rows.select("_row", "tile_id", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")).alias("_level"))
    asked = asked.select("_row", "_level", F.expr("shiftright(tile_id, _level)").alias("_node"))
    hit = asked.join(entries.select("_level", "_node", F.col("tile_id").alias("start"), "run", "length", "digest"), ["_level", "_node"]).drop("_level", "_node")
    return rows.join(hit, "_row", "left").drop("_row")


def audit(directory: DataFrame, section: int) -> DataFrame:
    """Flags of entries (archive, tile_id, run, length, offset; run 0 is a leaf, whose ids low to high are given, if known).

    increasing: the id is larger than that of the entry before, by offset; apart: the run ends before the
    next entry's id; filled; inside: of the section; bounded: a leaf's ids lie from its own to the next
    entry's. Entries are dealt out by ranges of (archive, offset), so an archive is many tasks; the first
    and last entry of a range meet those of the next ranges in a table of a row for each range and archive.
    """
    cols = ["archive", "tile_id", "run", "length", "offset"]
    leaf = [c for c in ("low", "high") if c in directory.columns]
    dealt = directory.select(*cols, *leaf).repartitionByRange("archive", "offset", "tile_id").withColumn("_part", F.spark_partition_id())
    dealt = commit(dealt, "audit")
    w = Window.partitionBy("archive", "_part").orderBy("offset", "tile_id")
    out = dealt.withColumn("_prev", F.lag("tile_id").over(w)).withColumn("_next", F.lead("tile_id").over(w))
    place = F.struct("offset", "tile_id")
    ends = dealt.groupBy("archive", "_part").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    seams = Window.partitionBy("archive").orderBy("_part")
    ends = ends.select("archive", "_part", F.lag("_hi.tile_id").over(seams).alias("_before"), F.lead("_lo.tile_id").over(seams).alias("_after"))
    out = out.join(ends, ["archive", "_part"])
    prev, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    bounded = F.lit(True)
    if leaf:
        bounded = F.when(F.col("run") == 0, F.coalesce((F.col("low") >= F.col("tile_id")) & F.coalesce(F.col("high") < after, F.lit(True)), F.lit(True))).otherwise(bounded)
    return out.select(
        "archive", "tile_id", F.coalesce(F.col("tile_id") > prev, F.lit(True)).alias("increasing"), F.coalesce(F.col("tile_id") + F.col("run") <= after, F.lit(True)).alias("apart"),
        (F.col("length") > 0).alias("filled"), (F.col("offset") + F.col("length") <= section).alias("inside"), bounded.alias("bounded"),
    )


def upsert(rows: DataFrame, key: str = "tile_id", seq: str = "seq") -> DataFrame:
    """The last written row of each key. An aggregate, so only one row a key and task is shuffled."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    out = rows.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("_l"))
    return out.select(key, f"_l.{seq}", *[f"_l.{c}" for c in rest])
