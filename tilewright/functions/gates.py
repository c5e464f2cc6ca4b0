"""Request rules as column expressions: ordered gates, cost, keys. Gates decide before x and y are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.addressing import ANCHOR_ZOOM, MAX_ZOOM, valid_xyz

# Fixed value: the deepest zoom that terrain bundles have.
TERRAIN_ZOOM = 12
PASS = "pass"


def integer(text: Column) -> Column:
    """A decimal integer with an optional sign, else null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def gate_coarse(z: Column, x: Column, y: Column, max_zoom: Column | None = None) -> Column:
    """Outcome of a raw tile request: bad_zoom, blocked, bad_tile, range, and with max_zoom (null: no archive) absent or deep, or pass."""
    zi, xi, yi = integer(z), integer(x), integer(y)
    out = F.when(zi.isNull(), "bad_zoom").when((zi < 0) | (zi > ANCHOR_ZOOM), "blocked").when(xi.isNull() | yi.isNull(), "bad_tile").when(~valid_xyz(zi, xi, yi), "range")
    if max_zoom is not None:
        out = out.when(max_zoom.isNull(), "absent").when(zi > max_zoom, "deep")
    return out.otherwise(PASS)


def gate_bundle(z: Column, x: Column, y: Column, extra: Column) -> Column:
    """Outcome of a vector bundle request: extra (it has a query or a body), bad_path, invalid or pass."""
    zi, xi, yi = integer(z), integer(x), integer(y)
    n = 1 << ANCHOR_ZOOM
    inside = (zi > ANCHOR_ZOOM) & (zi <= MAX_ZOOM) & xi.between(0, n - 1) & yi.between(0, n - 1)
    return F.when(extra, "extra").when(zi.isNull() | xi.isNull() | yi.isNull(), "bad_path").when(~inside, "invalid").otherwise(PASS)


def gate_terrain_bundle(z: Column, x: Column, y: Column, max_zoom: Column) -> Column:
    """Outcome of a terrain bundle request: bad_path, range, absent (max_zoom is null: no archive), deep or pass; query strings are no error here."""
    zi, xi, yi = integer(z), integer(x), integer(y)
    n = 1 << ANCHOR_ZOOM
    inside = (zi > ANCHOR_ZOOM) & (zi <= TERRAIN_ZOOM) & xi.between(0, n - 1) & yi.between(0, n - 1)
    return F.when(zi.isNull() | xi.isNull() | yi.isNull(), "bad_path").when(~inside, "range").when(max_zoom.isNull(), "absent").when(zi > max_zoom, "deep").otherwise(PASS)


def status(outcome: Column) -> Column:
    """HTTP status of a gate outcome; null for pass."""
    return (
        F.when(outcome.isin("blocked", "range", "deep", "absent", "unrouted"), 404).when(outcome == PASS, None).when(outcome == "bad_method", 405)
        .when(outcome == "preflight", 204).when(outcome == "service", 200).otherwise(400)
    )


# The routes. Bundles stand at /planet/bundle/v1..v3 and /terrain/bundle/v1 as x/y/zoom, raw tiles at /planet and
# /terrain as zoom/x/y; all answer GET and HEAD, bundles of the second and third version OPTIONS as well.
SERVICES = ("/livez", "/readyz", "/metrics")
STEMS = {"/planet/bundle/v1": "bundle1", "/planet/bundle/v2": "bundle2", "/planet/bundle/v3": "bundle3", "/terrain/bundle/v1": "terrain_bundle", "/terrain": "terrain", "/planet": "coarse"}
PREFLIGHT = ("bundle2", "bundle3")


def kind_of(path: Column, parts: Column) -> Column:
    """The kind of the route that a path takes, given its parts between slashes; null if there is none."""
    stem = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    whole = F.forall(F.slice(parts, 2, 9), lambda x: x != "")
    kinds = F.create_map(*[F.lit(v) for pair in STEMS.items() for v in pair])
    return F.when(path.isin(*SERVICES), "service").when(whole, F.try_element_at(kinds, stem))


def refusal(method: Column, kind: Column) -> Column:
    """Why no handler takes a request of the kind: unrouted, bad_method, preflight or service; null if one does."""
    plain = method.isin("GET", "HEAD")
    return F.when(kind.isNull(), "unrouted").when((method == "OPTIONS") & kind.isin(*PREFLIGHT), "preflight").when(~plain, "bad_method").when(kind == "service", "service")


def path_value(part: Column) -> Column:
    """A part of a path with its percent-encoding undone; a plus sign stays."""
    return F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def client_of(peer: Column) -> Column:
    """The host of a socket address: without its port and the brackets around it; an address without a port is itself."""
    return F.when(peer.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$"), F.regexp_extract(peer, r"^\[(.*)\]:", 1)).when(peer.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), F.substring_index(peer, ":", 1)).otherwise(peer)


def request_cost(kind: Column, z: Column) -> Column:
    """Tokens: 1 for a raw tile, 2^(zoom - 10) for a bundle."""
    return F.when(kind.startswith("bundle") | (kind == "terrain_bundle"), F.pow(F.lit(2.0), z - ANCHOR_ZOOM).cast("long")).otherwise(F.lit(1).cast("long"))


def path_escape(text: Column) -> Column:
    """Percent-encoding of a path segment: URL-encoding, but a space is %20, * is %2A and ~ $ & + : = @ stay."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in "~$&+:=@":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def representation_key(codec: str, version: Column, digest: Column, x10: Column, y10: Column, z: Column, *more: Column) -> Column:
    return F.concat_ws(":", F.lit(codec), path_escape(version), digest, F.lit(str(ANCHOR_ZOOM)), *[c.cast("string") for c in (x10, y10, z)], *more)


def etag(version: Column, x: Column, y: Column, z: Column, prefix: str = "") -> Column:
    body = F.concat_ws(":", version, F.lit(str(ANCHOR_ZOOM)), *[c.cast("string") for c in (x, y, z)])
    return F.concat(F.lit(f'"{prefix}'), body, F.lit('"'))


def safe_version(version: Column) -> Column:
    return F.regexp_replace(version, "[^A-Za-z0-9._-]", "-")
