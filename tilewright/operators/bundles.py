"""Bundles: complete, ordered, size-bounded sets of an anchor's descendants, their framing and audits."""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import addressing as A
from tilewright.functions import vector_tile as V
from tilewright.functions.inflate import MAGIC, inflate

# Fixed values of the bundle format.
HEADER, MOST_BYTES, NONE = 20, 64 << 20, "FFFFFFFF"
FULL, STRUCTURE, LABELS = 0, 1, 2
GZIP_ENTRIES = 1
#: Tiles that are Python objects at once, of an Arrow batch of any size; those that hold features; and bytes of features that one drawn row is about.
TILES, CROWDED, DRAWN = 256, 8, 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TILES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def expand_descendants(requests: DataFrame) -> DataFrame:
    """requests (x10, y10, zoom) with a row for each descendant: slot, x, y; y outer, x inner."""
    side = F.pow(F.lit(2.0), F.col("zoom") - A.ANCHOR_ZOOM).cast("long")
    out = requests.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), side * side - 1)))
    return out.withColumn("x", F.col("x10") * side + F.col("slot") % side).withColumn("y", F.col("y10") * side + F.floor(F.col("slot") / side))


def complete(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """Descendants with their tile's payload; a missing tile or an empty one has a null payload."""
    t = tiles.select(F.col("z").alias("zoom"), "x", "y", F.when(F.octet_length("payload") > 0, F.col("payload")).alias("payload"), "gzipped")
    return expand_descendants(requests).join(t, ["zoom", "x", "y"], "left")


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def assemble(entries: DataFrame, flags: int = 0, keys: tuple[str, ...] = ("x10", "y10", "zoom")) -> DataFrame:
    """Bundle bodies from entries (keys, slot, payload): keys and body.

    Sizes are summed first and groups over the limit raise no body (null), so nothing larger is gathered
    in one row. The key includes the zoom and, if given, the part: the densest group is 64 MiB. Entries are
    joined as bytes, in the order of their slots.
    """
    sizes = entries.groupBy(*keys).agg((HEADER + F.sum(4 + F.coalesce(F.octet_length("payload"), F.lit(0)))).alias("_size"))
    fits = entries.join(sizes.where(F.col("_size") <= MOST_BYTES).select(*keys), list(keys), "left_semi")
    entry = F.when(F.col("payload").isNull(), F.unhex(F.lit(NONE))).otherwise(F.concat(be32(F.octet_length("payload")), F.col("payload")))
    done = fits.withColumn("_entry", entry).groupBy(*keys).agg(F.count("*").alias("_n"), F.expr("listagg(_entry) within group (order by slot)").alias("_body"))
    head = F.concat(F.unhex(F.lit("53434231010A")), byte(F.col("zoom")), byte(F.lit(flags)), be32(F.col("x10")), be32(F.col("y10")), be32(F.col("_n")))
    done = done.select(*keys, F.concat(head, F.col("_body")).alias("body"))
    return sizes.where(F.col("_size") > MOST_BYTES).select(*keys, F.lit(None).cast("binary").alias("body")).unionByName(done)


def bundle_size(entries: DataFrame) -> DataFrame:
    size = HEADER + F.sum(4 + F.coalesce(F.octet_length("payload"), F.lit(0)))
    return entries.groupBy("x10", "y10", "zoom").agg(size.cast("long").alias("bytes")).withColumn("over", F.col("bytes") > MOST_BYTES)


def completeness(entries: DataFrame) -> DataFrame:
    """Audit of stored entries: complete iff each slot of the anchor's side x side square comes once."""
    want = F.pow(F.lit(4.0), F.col("zoom") - A.ANCHOR_ZOOM).cast("long")
    out = entries.groupBy("x10", "y10", "zoom").agg(F.count("*").alias("entries"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    return out.withColumn("complete", (F.col("entries") == want) & (F.col("slots") == want) & (F.col("first") == 0) & (F.col("last") == want - 1))


def gzip_entries(tiles: DataFrame) -> DataFrame:
    """tiles with payload as one gzip member (no time, default level); stored gzip stays; nothing inside is null.

    Adds error: a stored payload that is no whole gzip member within a tile's bound is null, and says why.
    """
    whole = T.StructType([*tiles.schema.fields, T.StructField("error", T.StringType())])

    def member(p: bytes | None, stored: bool) -> bytes | None:
        if not p or not stored:
            return gzip.compress(p, mtime=0) if p else None
        if p[:2] != MAGIC or len(p) < 18:
            raise ValueError("stored payload is not gzip")
        # only a member that says it is empty has to be looked into
        return None if p[-4:] == b"\0\0\0\0" and not inflate(p, V.MOST_BYTES) else p

    def run(batches):
        for b in sliced(batches):
            out, errors = [], []
            for p, stored in zip(b.column("payload").to_pylist(), b.column("gzipped").to_pylist(), strict=True):
                packed, error = None, None
                try:
                    packed = member(p, stored)
                except ValueError as e:
                    error = str(e)
                out.append(packed)
                errors.append(error)
            b = b.set_column(b.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))
            b = b.set_column(b.schema.get_field_index("gzipped"), "gzipped", pa.array([True] * len(out), pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.string())], names=[*b.schema.names, "error"])

    return tiles.mapInArrow(run, whole)


def split_tiles(tiles: DataFrame) -> DataFrame:
    """Vector tiles by part: z, x, y, part (1 structure, 2 labels), payload, error.

    One pass gives both parts; a malformed tile gives one row with an error and no payload.
    """

    def run(batches):
        schema = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("part", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
        for b in sliced(batches):
            rows = []
            for z, x, y, p in zip(*[b.column(c).to_pylist() for c in ("z", "x", "y", "payload")], strict=True):
                try:
                    parts = (None, None) if p is None else V.split(V.plain(p))
                    rows += [(z, x, y, k, part, None) for k, part in zip((STRUCTURE, LABELS), parts, strict=True)]
                except (ValueError, OSError, EOFError) as e:
                    rows.append((z, x, y, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return tiles.select("z", "x", "y", "payload").mapInArrow(run, "z int, x long, y long, part int, payload binary, error string")


def stages_of(zoom: int, version: int) -> list[tuple[int, int]]:
    """(zoom, part) of the stages of a stream, in order."""
    if zoom != A.MAX_ZOOM:
        return [(zoom, FULL)]
    return [(13, FULL), (14, FULL)] if version == 2 else [(13, FULL), (14, STRUCTURE), (14, LABELS)]


def check_body(body: bytes, x10: int, y10: int, zoom: int, flags: int) -> list[bytes | None]:
    """Entries of the body of an anchor's bundle; ValueError unless it is exactly that bundle, complete and within bounds."""
    if not HEADER <= len(body) <= MOST_BYTES:
        raise ValueError("bad bundle size")
    if body[:HEADER] != b"SCB1" + bytes([1, A.ANCHOR_ZOOM, zoom, flags]) + struct.pack(">III", x10, y10, 4 ** (zoom - A.ANCHOR_ZOOM)):
        raise ValueError("bad bundle header")
    entries = parse_body(body)
    if flags & GZIP_ENTRIES and any(e is not None and (len(e) < 18 or e[:3] != b"\x1f\x8b\x08") for e in entries):
        raise ValueError("entry is not a gzip member")
    return entries


def whole_member(packed: bytes) -> bytes:
    """What the one gzip member inflates to; ValueError on anything after it, or on more than a bundle can hold."""
    engine = zlib.decompressobj(31)
    try:
        raw = engine.decompress(packed, MOST_BYTES + 1)
    except zlib.error as e:
        raise ValueError(f"bad gzip: {e}") from e
    if len(raw) > MOST_BYTES or not engine.eof or engine.unused_data:
        raise ValueError("bad gzip member")
    return raw


def with_types(table: DataFrame, columns: tuple[str, ...]) -> str:
    """The start of a schema: columns of a table, each with a comma after it."""
    return "".join(f"{c} {table.schema[c].dataType.simpleString()}, " for c in columns)


def frame(stages: DataFrame, version: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """Streams from stage bodies (x10, y10, zoom, stage_ord, stage_zoom, part, body): x10, y10, zoom, stream, error; more are further keys of a stream.

    Version 3 takes bodies of gzip members as they are; version 2 takes plain bodies and packs each as one
    gzip member. A stage that is not the bundle that its stream asks for gives no stream but an error, and so
    do missing stages.
    """

    def run(batches):
        schema = pa.schema([("x10", pa.int64()), ("y10", pa.int64()), ("zoom", pa.int32()), ("stage_ord", pa.int32()), ("frame", pa.binary()), ("error", pa.string())])
        for b in batches:
            rows = []
            for x, y, zoom, k, at, part, body in zip(*[b.column(c).to_pylist() for c in ("x10", "y10", "zoom", "stage_ord", "stage_zoom", "part", "body")], strict=True):
                framed, error = None, None
                try:
                    if body is None or (at, part) not in stages_of(zoom, version):
                        raise ValueError("no such stage")
                    check_body(body, x, y, at, 0 if version == 2 else GZIP_ENTRIES)
                    packed = gzip.compress(body, mtime=0) if version == 2 else body
                    framed = struct.pack(">I", len(packed)) + (struct.pack(">I", len(body)) if version == 2 else bytes([at, part, 0, 0])) + hashlib.sha256(body).digest() + packed
                except ValueError as e:
                    error = str(e)
                rows.append((x, y, zoom, k, framed, error))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in more], *[pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)]], names=[*more, *schema.names])

    cols = [F.col(c).cast(t).alias(c) for c, t in (("x10", "long"), ("y10", "long"), ("zoom", "int"), ("stage_ord", "int"), ("stage_zoom", "int"), ("part", "int"), ("body", "binary"))]
    framed = stages.select(*more, *cols).mapInArrow(run, with_types(stages, more) + "x10 long, y10 long, zoom int, stage_ord int, frame binary, error string")
    out = framed.groupBy(*more, "x10", "y10", "zoom").agg(F.count("*").alias("_n"), F.max("error").alias("error"), F.expr("listagg(frame) within group (order by stage_ord)").alias("_f"))
    n = F.when(F.col("zoom") == A.MAX_ZOOM, F.lit(version)).otherwise(F.lit(1))
    head = F.concat(F.lit(f"SCB{version}").cast("binary"), byte(F.lit(version)), byte(F.lit(A.ANCHOR_ZOOM)), byte(F.col("zoom")), byte(F.lit(0)), be32(F.col("x10")), be32(F.col("y10")), be32(n))
    error = F.coalesce("error", F.when(F.col("_n") != n, F.lit("missing stage")))
    return out.select(*more, "x10", "y10", "zoom", F.when(error.isNull(), F.concat(head, F.col("_f"))).alias("stream"), error.alias("error"))


def parse_body(body: bytes) -> list[bytes | None]:
    """Entries of a bundle body; ValueError on a wrong magic, a bad length or trailing bytes."""
    if body[:4] != b"SCB1" or len(body) < HEADER:
        raise ValueError("not a bundle")
    (count,) = struct.unpack(">I", body[16:20])
    out, at = [], HEADER
    for _ in range(count):
        if at + 4 > len(body):
            raise ValueError("truncated bundle")
        (n,) = struct.unpack_from(">I", body, at)
        at += 4
        if n == 0xFFFFFFFF:
            out.append(None)
            continue
        if at + n > len(body):
            raise ValueError("bad entry length")
        out.append(body[at : at + n])
        at += n
    if at != len(body):
        raise ValueError("trailing bytes")
    return out


def parse_stream(stream: bytes) -> list[tuple[int, int, bytes]]:
    """(stage zoom, part, body) of each stage of a version-2 or version-3 stream; ValueError unless all of it is as it has to be."""
    if len(stream) < HEADER or stream[:4] not in (b"SCB2", b"SCB3"):
        raise ValueError("unknown magic")
    version, zoom = stream[3] - 48, stream[6]
    x10, y10, count = struct.unpack(">III", stream[8:20])
    if stream[4] != version or stream[5] != A.ANCHOR_ZOOM or not A.ANCHOR_ZOOM < zoom <= A.MAX_ZOOM or stream[7] or max(x10, y10) >= 1 << A.ANCHOR_ZOOM:
        raise ValueError("bad stream header")
    wanted = stages_of(zoom, version)
    if count != len(wanted):
        raise ValueError("bad stage count")
    out, at = [], HEADER
    for stage, part in wanted:
        head = stream[at : at + 40]
        if len(head) < 40:
            raise ValueError("truncated frame")
        n, second = struct.unpack(">II", head[:8])
        body = stream[at + 40 : at + 40 + n]
        if len(body) < n:
            raise ValueError("bad frame length")
        if version == 2:
            body = whole_member(body)
            if len(body) != second:
                raise ValueError("bad inflated length")
        elif head[4:8] != bytes([stage, part, 0, 0]):
            raise ValueError("bad stage")
        if hashlib.sha256(body).digest() != head[8:40]:
            raise ValueError("bad digest")
        check_body(body, x10, y10, stage, 0 if version == 2 else GZIP_ENTRIES)
        out.append((stage, part, body))
        at += 40 + n
    if at != len(stream):
        raise ValueError("trailing bytes")
    return out


STAGE_ENTRIES = "x10 long, y10 long, stage_zoom int, part int, slot long, payload binary, stored long, wire long, error string"


def explode_streams(streams: DataFrame, column: str = "stream", more: tuple[str, ...] = ()) -> DataFrame:
    """Entries of streams, e.g. of files read as binaryFile: x10, y10, stage_zoom, part, slot, payload (inflated), stored (bytes), wire, error.

    wire is the framed length of the stage, at its first entry; columns named in more come first, as the stream has them. A stream that is damaged anywhere gives one
    row with an error, and none of its entries.
    """

    def run(batches):
        schema = pa.schema([("x10", pa.int64()), ("y10", pa.int64()), ("stage_zoom", pa.int32()), ("part", pa.int32()), ("slot", pa.int64()), ("payload", pa.binary()), ("stored", pa.int64()), ("wire", pa.int64()), ("error", pa.string())])
        for b in batches:
            for i, s in enumerate(b.column(len(more))):
                rows = []
                try:
                    stream = s.as_py() or b""
                    stages, at = parse_stream(stream), HEADER
                    for zoom, part, body in stages:
                        (wire,) = struct.unpack_from(">I", stream, at)
                        at += 40 + wire
                        x, y = struct.unpack(">II", body[8:16])
                        packed = body[7] & GZIP_ENTRIES
                        rows += [(x, y, zoom, part, k, whole_member(e) if packed and e else e, len(e or b""), None if k else wire, None) for k, e in enumerate(parse_body(body))]
                except ValueError as e:
                    rows = [(None,) * 8 + (str(e),)]
                beside = [pa.repeat(b.column(k)[i], len(rows)) for k in range(len(more))]
                yield pa.RecordBatch.from_arrays([*beside, *[pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]], names=[*more, *schema.names])

    return streams.select(*more, column).mapInArrow(run, with_types(streams, more) + STAGE_ENTRIES)


def explode_bodies(bodies: DataFrame) -> DataFrame:
    """Entries of bundle bodies (x10, y10, zoom, body): x10, y10, zoom, slot, payload (gzip members inflated), error.

    A body that is not the anchor's bundle gives one row with an error, and none of its entries.
    """

    def run(batches):
        schema = pa.schema([("x10", pa.int64()), ("y10", pa.int64()), ("zoom", pa.int32()), ("slot", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        for b in batches:
            for x, y, zoom, body in zip(*[b.column(c) for c in ("x10", "y10", "zoom", "body")], strict=True):
                body, slots, error = body.as_py() or b"", [None], None
                try:
                    flags = body[7] if len(body) > 7 else 0
                    rows = [whole_member(e) if flags & GZIP_ENTRIES and e else e for e in check_body(body, x.as_py(), y.as_py(), zoom.as_py(), flags)]
                    slots = list(range(len(rows)))
                except ValueError as e:
                    rows, error = [None], str(e)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * n, pa.int64()), pa.array([y.as_py()] * n, pa.int64()), pa.array([zoom.as_py()] * n, pa.int32()), pa.array(slots, pa.int64()), pa.array(rows, pa.binary()), pa.array([error] * n, pa.string())], schema=schema)

    return bodies.select("x10", "y10", F.col("zoom").cast("int").alias("zoom"), "body").mapInArrow(run, "x10 long, y10 long, zoom int, slot long, payload binary, error string")


def explode_layers(tiles: DataFrame) -> DataFrame:
    """Layers of vector tiles: z, x, y, ord, layer, raw, bytes (payload without the tag), error."""

    def run(batches):
        for b in sliced(batches):
            rows = []
            for z, x, y, p in zip(*[b.column(c).to_pylist() for c in ("z", "x", "y", "payload")], strict=True):
                if not p:
                    continue
                try:
                    found = V.layers(V.plain(p))
                    rows += [{"z": z, "x": x, "y": y, "ord": k, "layer": n, "raw": raw, "bytes": len(v), "error": None} for k, (n, v, raw) in enumerate(found) if n is not None]
                except (ValueError, OSError, EOFError) as e:
                    rows.append({"z": z, "x": x, "y": y, "ord": None, "layer": None, "raw": None, "bytes": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("ord", pa.int32()), ("layer", pa.string()), ("raw", pa.binary()), ("bytes", pa.int64()), ("error", pa.string())]))

    return tiles.select("z", "x", "y", "payload").mapInArrow(run, "z int, x long, y long, ord int, layer string, raw binary, bytes long, error string")


def explode_features(tiles: DataFrame, layer: str) -> DataFrame:
    """Features of one layer: z, x, y, ord, attributes, points, pixels (square root of the area), error.

    A tile that is malformed anywhere, also in another layer, gives one row with an error and none of its features.
    """

    def run(batches):
        kinds = [("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("ord", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("points", pa.int64()), ("pixels", pa.float64()), ("error", pa.string())]
        for b in sliced(batches, CROWDED):
            rows = []
            for z, x, y, p in zip(*[b.column(c).to_pylist() for c in ("z", "x", "y", "payload")], strict=True):
                at = {"z": z, "x": x, "y": y}
                try:
                    found = [f for n, v, _ in (V.layers(V.plain(p)) if p else []) if n == layer for f in V.features(v)]
                    rows += [{**at, "ord": k, "attributes": list(f.items()), "points": points, "pixels": pixels} for k, (f, _, points, pixels) in enumerate(found)]
                except ValueError as e:
                    rows.append({**at, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return tiles.select("z", "x", "y", "payload").mapInArrow(run, "z int, x long, y long, ord int, attributes map<string,string>, points long, pixels double, error string")


def encode_tiles(rows: DataFrame) -> DataFrame:
    """Vector tiles from (z, x, y, layer, class, bytes) rows: a layer for each name, features of its classes."""
    tiles = rows.groupBy("z", "x", "y").agg(F.collect_list(F.struct("layer", "class", "bytes")).alias("parts"))

    def build(batches):
        for b in sliced(batches):
            out = []
            for parts in b.column("parts").to_pylist():
                by: dict = {}
                for p in parts:
                    feats, filler = by.setdefault(p["layer"], ([], [0]))
                    feats.append({"class": p["class"]} if p["class"] is not None else {})
                    filler[0] += p["bytes"] or 0
                out.append(b"".join(V.encode_layer(n, sorted(f, key=str), s[0]) for n, (f, s) in sorted(by.items())))
            yield pa.RecordBatch.from_arrays([b.column("z").cast(pa.int32()), b.column("x"), b.column("y"), pa.array(out, pa.binary()), pa.array([False] * len(out))], ["z", "x", "y", "payload", "gzipped"])

    return tiles.mapInArrow(build, "z int, x long, y long, payload binary, gzipped boolean")


def draw_tiles(features: DataFrame, layer: str) -> DataFrame:
    """Vector tiles of one layer from (z, x, y, attributes, points, pixels): each feature a square of so many pixels and points.

    A tile whose features are over DRAWN bytes comes as several rows of about so much, as a tile has a bound; features
    are dealt out to them by their place in the table, which is to be one that reads alike each time.
    """
    keys, size = ["z", "x", "y"], F.sum(64 + 4 * F.coalesce("points", F.lit(0)))
    large = features.groupBy(*keys).agg(F.ceil(size / DRAWN).alias("_rows")).where(F.col("_rows") > 1)
    row = F.when(F.col("_rows").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_rows")))
    dealt = features.join(F.broadcast(large), keys, "left").withColumn("_row", row)
    tiles = dealt.groupBy(*keys, "_row").agg(F.collect_list(F.struct(F.map_filter("attributes", lambda _, v: v.isNotNull()).alias("attributes"), "points", "pixels")).alias("parts"))

    def build(batches):
        for b in sliced(batches, CROWDED):
            out = [V.encode_layer(layer, [dict(p["attributes"]) for p in parts], geometries=[V.square(16 * p["pixels"], p["points"]) for p in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("z").cast(pa.int32()), b.column("x"), b.column("y"), pa.array(out, pa.binary()), pa.array([False] * len(out))], ["z", "x", "y", "payload", "gzipped"])

    return tiles.mapInArrow(build, "z int, x long, y long, payload binary, gzipped boolean")
