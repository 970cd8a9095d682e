"""Points near other points, and the regions that contain them; planar, in degrees.

Points at one place count as one place. Latitude is cut into rows at least a radius high, and rows
into strips of about equal load, by a histogram of the rows. A row that holds more than a strip's load
together with the row above it is a strip of its own and is cut along longitude too, by counts of
cells; cells that hold much are counted again in finer cells, down to the radius.

Near points: each tile gets its own places and those of the row above and within a radius to its
sides. It sorts them by row and longitude and sweeps: while it goes through a row, the places of this
and the next row whose longitude is within the radius are the active set. The tile that owns the
lower place of a pair emits it, so a pair comes out once.

Regions: a place is inside if a ray to the east meets an odd number of edges, so of a region only the
edges matter that cross the place's latitude. Edges, not regions, go to the tiles: those whose strip
an edge crosses and whose longitudes are among the region's. A tile holds its places sorted by
longitude and sweeps over the regions' edges as they come, region by region: the places within the
region's longitudes are the active set.

What the driver holds is bounded: 65,537 rows of the histogram, and 1,024 counts for each cell that
is counted again, of which there are a few for each tile. A tile is a task's work and holds about
``most_in_tile`` places; only where more lie within a radius of each other is it more.

Defined results
    unusable points   null, not a number, outside latitude 90 or longitude 180, or exactly 0/0:
                      in no pair and no region
    repeated ids      one point; where deliveries differ, the least location
    same place        near each other, at distance 0, and so are longitudes 180 and -180 of one latitude
    ties              a distance equal to the radius is near
    borders           a point on a border is inside at most one of two regions that share it
    unusable regions  null or no shape: contain nothing
    repeated regions  count once; a region of several shapes contains what one of them does
    empty tables      empty results
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geoloom.kernel.normal import normalize
from geoloom.kernel.shapes import MULTI_POLYGON, POLYGON, ShapeError, parse
from geoloom.operators.balance import join_balanced, tasks_for
from geoloom.plans.lineage import cut
from geoloom.sources.tables import first_delivery

MOST_ROWS = 1 << 16
#: Longitude is counted in 2**10 cells, and a full one in 2**10 finer ones, down to 2**30 of the globe.
CELL_BITS, FINEST_BITS = 10, 30
BLOCK = 1 << 21  # candidate pairs verified at a time
LEAST_IN_TILE = 20_000  # unless there are fewer tiles than cores
#: Places of several points up to this many are sent to every task.
MOST_BROADCAST = 100_000


def usable_points(df: DataFrame, id_column: str, lat: Column, lon: Column) -> DataFrame:
    """(id, lat, lon), one row for each id with a usable location."""
    points = df.select(F.col(id_column).alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    usable = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return first_delivery(points.where(usable), "id", "lat", "lon")


_APART, _SHIFT, _SLACK = 1000.0, 300.0, 1e-6


@dataclass(frozen=True)
class Tiles:
    """``strip_of[row]``; ``cuts``: where strips are cut along longitude, all strips on one axis.

    ``used[strip]``: whether the strip has places of its own.

    A longitude x of strip s lies at s * _APART + x + _SHIFT on the axis. What rounding may do there
    is covered by _SLACK, by which a tile's margins are wider than the radius.
    """

    radius: float
    height: float
    strip_of: np.ndarray
    cuts: np.ndarray
    used: np.ndarray

    def crossed(self, low: np.ndarray, high: np.ndarray, west: np.ndarray, east: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of boxes, and the tiles with places that they meet."""
        rows = len(self.strip_of) - 1
        first = self.strip_of[np.clip(self.row(low), 0, rows)]
        copies = self.strip_of[np.clip(self.row(high), 0, rows)] - first + 1
        n = np.repeat(np.arange(len(low)), copies)
        strip = np.repeat(first - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        n, strip = n[self.used[strip]], strip[self.used[strip]]
        first = self._tile(strip, np.clip(west[n], -180.0, 180.0) - _SLACK)
        copies = self._tile(strip, np.clip(east[n], -180.0, 180.0) + _SLACK) - first + 1
        return np.repeat(n, copies), np.repeat(first - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())

    @property
    def count(self) -> int:
        return int(self.strip_of[-1]) + 1 + len(self.cuts)

    def row(self, lat: np.ndarray) -> np.ndarray:
        return np.floor((lat + 90.0) / self.height).astype(np.int64)

    def _tile(self, strip: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, strip * _APART + (x + _SHIFT), "right") + strip

    def own(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The tile that owns each place."""
        return self._tile(self.strip_of[self.row(lat)], lon)

    def place(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tile, point number, longitude in the tile, and whether the tile owns the point."""
        east, west = np.flatnonzero(lon > 180.0 - self.radius), np.flatnonzero(lon < self.radius - 180.0)
        n = np.concatenate([np.arange(len(lat)), east, west])
        x = np.concatenate([lon, lon[east] - 360.0, lon[west] + 360.0])
        real = np.arange(len(n)) < len(lat)
        row = self.row(lat)[n]
        strip, below = self.strip_of[row], self.strip_of[np.maximum(row - 1, 0)]
        other = np.flatnonzero((below != strip) & self.used[below])
        n, x = np.append(n, n[other]), np.append(x, x[other])
        real = np.append(real, np.zeros(len(other), bool))
        strip = np.append(strip, below[other])
        margin = self.radius + _SLACK
        low, high = self._tile(strip, x - margin), self._tile(strip, x + margin)
        copies = high - low + 1
        tile = np.repeat(low - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        own = np.repeat(real, copies) & (tile == np.repeat(self._tile(strip, x), copies))
        return tile, np.repeat(n, copies), np.repeat(x, copies), own


def _cut_cells(at: np.ndarray, counts: np.ndarray, load: float, apart: int) -> list[int]:
    """Cells, in order of ``at``, at which a new tile begins, at least ``apart`` from each other."""
    upto, out, n, last = np.cumsum(counts), [], 0, -apart
    while n < len(at):
        full = (upto[n - 1] if n else 0) + load
        n = max(n + 1, int(np.searchsorted(upto, full, "right")))
        n = max(n, int(np.searchsorted(at, last + apart, "left")))
        if n < len(at):
            out.append(last := int(at[n]))
    return out


def plan_tiles(places: DataFrame, radius: float, most_in_tile: int) -> Tiles:
    """Tiles of about equal load for (lat, lon) rows, about ``most_in_tile`` of them in each."""
    height = max(radius, 180.0 / MOST_ROWS)
    row = F.floor((F.col("lat") + 90.0) / height)
    n_rows = int(180.0 / height) + 2
    counts = np.zeros(n_rows + 1, np.int64)
    for r, n in places.groupBy(row.alias("row")).count().collect():  # at most MOST_ROWS + 1 rows
        counts[r] = n
    total = int(counts.sum())
    tasks = tasks_for(places.sparkSession, total, LEAST_IN_TILE)
    load = max(1, min(most_in_tile, -(-total // tasks)))
    strip_of, used = np.zeros(n_rows, np.int64), [False]
    strip = held = 0
    full: dict[int, int] = {}  # strip of each full row
    counts = counts.tolist()
    for r in range(n_rows):
        alone = counts[r] > 0 and counts[r] + counts[r + 1] > load
        # a strip also gets the row above it
        if r and (alone or r - 1 in full or held + counts[r] + counts[r + 1] > load):
            strip, held = strip + 1, 0
            used.append(False)
        strip_of[r] = strip
        held += counts[r]
        used[strip] |= bool(counts[r])
        if alone:
            full[r] = strip
    cuts = _cut_full(places, row, full, radius, load) if full else np.empty(0)
    return Tiles(radius, height, strip_of, cuts, np.array(used))


def _cut_full(places: DataFrame, row: Column, full: dict[int, int], radius: float, load: int) -> np.ndarray:
    """Where the strips of full rows are cut."""
    spark = places.sparkSession
    cell = F.floor((F.col("lon") + 180.0) * (2.0**FINEST_BITS / 360.0)).cast("long")
    # a row counts for its own strip and for the strip below
    near = F.filter(F.array(row.cast("int"), (row - 1).cast("int")), lambda r: r.isin(list(full)))
    cells = places.select(F.explode(near).alias("row"), cell.alias("cell"))
    width = 360.0 / 2.0**FINEST_BITS
    counted: dict[int, list[tuple[int, int]]] = {r: [] for r in full}  # (first finest cell, rows) of each row
    bits, open_cells = CELL_BITS, cells
    while True:
        shift = FINEST_BITS - bits
        fine = open_cells.groupBy("row", F.shiftright("cell", shift).alias("at")).count().collect()
        last = shift == 0 or width * (1 << shift) <= radius
        heavy = [(r, at) for r, at, n in fine if n * 4 > load and not last]  # a few for each tile
        again = set(heavy)
        for r, at, n in fine:
            if (r, at) not in again:
                counted[r].append((at << shift, n))
        if not heavy:
            break
        chosen = F.broadcast(spark.createDataFrame(heavy, "row int, at long"))
        open_cells = cells.withColumn("at", F.shiftright("cell", shift)).join(chosen, ["row", "at"]).drop("at")
        bits += CELL_BITS
    cuts = []
    for r, strip in sorted(full.items()):
        at, n = np.array(sorted(counted[r]), np.int64).reshape(-1, 2).T
        edges = np.array(_cut_cells(at, n, load, int(4 * radius / width) + 1), float) * width - 180.0
        cuts.append(strip * _APART + (edges + _SHIFT))
    return np.concatenate(cuts)


def _placed(batches: Iterator[pa.RecordBatch], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    """Places in all tiles that need them; ``flags``: 1 where the tile owns it, 2 where several points share it, and
    4 times by how many turns of the globe it is moved, plus one."""
    names = ["tile", "place", "lat", "lon", "flags"]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, lat, lon, shared = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        tile, n, x, own = tiles.place(lat, lon)
        turns = np.rint((x - lon[n]) / 360.0).astype(np.int32)
        flags = own + 2 * shared[n].astype(np.int32) + 4 * (turns + 1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tile.astype(np.int32), ids[n], lat[n], lon[n], flags.astype(np.int32))], names)


def _sweep(batches: Iterator[pa.RecordBatch], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    """Pairs of one partition; where it holds several tiles, tile by tile."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    flags = columns.pop("flags")
    columns |= {"own": flags & 1 > 0, "shared": flags & 2 > 0, "x": columns["lon"] + 360.0 * ((flags >> 2) - 1)}
    for tile in np.unique(columns["tile"]):
        at = np.flatnonzero(columns["tile"] == tile)
        row = tiles.row(columns["lat"][at])
        order = np.lexsort((columns["x"][at], row))
        at, row = at[order], row[order]
        place, lat, lon, x, own, shared = (columns[c][at] for c in ("place", "lat", "lon", "x", "own", "shared"))
        # rows end to end on one axis; the slack covers its rounding, pairs are verified exactly
        axis = row * _APART + (x + _SHIFT)
        reach = tiles.radius + _SLACK
        n = len(at)
        begin = np.concatenate([np.arange(n) + 1, np.searchsorted(axis, axis + _APART - reach, "left")])
        end = np.concatenate([np.searchsorted(axis, axis + reach, "right"), np.searchsorted(axis, axis + _APART + reach, "right")])
        source = np.concatenate([np.arange(n), np.arange(n)])
        size = np.maximum(end - begin, 0)
        busy = np.flatnonzero(size)
        begin, size, source = begin[busy], size[busy], source[busy]
        upto = np.cumsum(size)
        done = 0
        while done < len(size):
            base = upto[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
            part = size[done:to]
            i = np.repeat(source[done:to], part)
            j = np.repeat(begin[done:to] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            done = to
            dlon = np.abs(lon[i] - lon[j])
            dlon = np.minimum(dlon, 360.0 - dlon)
            near = np.sqrt((lat[i] - lat[j]) ** 2 + dlon**2) <= tiles.radius
            i, j = i[near], j[near]
            # the lower point comes first; of equal latitudes the one to the west, then by number
            swap = (lat[j] < lat[i]) | ((lat[j] == lat[i]) & ((lon[j] < lon[i]) | ((lon[j] == lon[i]) & (place[j] < place[i]))))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            keep = own[i] & (place[i] != place[j])
            i, j = i[keep], j[keep]
            made = [pa.array(v) for v in (place[i], place[j], shared[i], shared[j])]
            yield pa.RecordBatch.from_arrays(made, ["a", "b", "a_shared", "b_shared"])


@dataclass
class Places:
    """``points``: id, lat, lon. ``places``: place (the least id of a location), lat, lon, shared (by several points)."""

    points: DataFrame
    places: DataFrame

    def members(self) -> DataFrame:
        """(id, place, shared), a row for each point."""
        at = self.places.where("shared").select(F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"), "place")
        if at.count() <= MOST_BROADCAST:
            found = self.points.join(F.broadcast(at), (F.col("lat") == F.col("at_lat")) & (F.col("lon") == F.col("at_lon")), "left")
        else:
            # one place may hold a third of all points
            name = lambda lat, lon: F.concat_ws(" ", F.col(lat) + 0.0, F.col(lon) + 0.0).alias("key")
            keyed, at = self.points.select("id", name("lat", "lon")), at.select(name("at_lat", "at_lon"), "place")
            found = join_balanced(keyed, at, "key", ["id"], how="left")
        return found.select("id", F.coalesce("place", "id").alias("place"), F.col("place").isNotNull().alias("shared"))


@dataclass
class NearPoints:
    """``members``: id, place, shared. ``links``: a, b, a_shared, b_shared: places near each other, once, and
    whether several points share them."""

    members: DataFrame
    links: DataFrame


def places_of(points: DataFrame) -> Places:
    """The places of (id, lat, lon) rows as of ``usable_points``."""
    points = cut(points.select("id", "lat", "lon"))
    places = points.groupBy("lat", "lon").agg(F.min("id").alias("place"), (F.count(F.lit(1)) > 1).alias("shared"))
    return Places(points, cut(places.select("place", "lat", "lon", "shared")))


def near_points(points: DataFrame | Places, radius: float, most_in_tile: int = 1 << 20) -> NearPoints:
    """Places within ``radius`` degrees of each other, of (id, lat, lon) rows as of ``usable_points``."""
    if not 0 < radius < 90:
        raise ValueError("radius must be over 0 and under 90 degrees")
    at = points if isinstance(points, Places) else places_of(points)
    tiles = plan_tiles(at.places, radius, most_in_tile)
    kind = dict(at.places.dtypes)["place"]
    placed = at.places.mapInArrow(
        lambda it: _placed(it, tiles), f"tile int, place {kind}, lat double, lon double, flags int"
    )
    made = f"a {kind}, b {kind}, a_shared boolean, b_shared boolean"
    links = placed.repartitionById(tiles.count, "tile").mapInArrow(lambda it: _sweep(it, tiles), made)
    return NearPoints(at.members(), links)


def point_pairs(near: NearPoints) -> DataFrame:
    """Pairs (a_id, b_id) of different points, smaller first, within the radius.

    A link between places of one point each is a pair as it is. Places with many points are split
    over tasks.
    """
    links = cut(near.links)
    single = links.where("NOT a_shared AND NOT b_shared").select(F.col("a").alias("l"), F.col("b").alias("r"))
    members = cut(near.members.where("shared").select("id", "place"))
    # a shared place is linked to itself
    own = members.where("id = place").select(F.col("place").alias("a"), F.col("place").alias("b"), F.lit(True).alias("a_shared"), F.lit(True).alias("b_shared"))
    several = links.where("a_shared OR b_shared").union(own)
    from_shared = join_balanced(members.select(F.col("id").alias("l"), F.col("place").alias("a")), several.where("a_shared"), "a", ["l"], most_sent=MOST_BROADCAST)
    linked = cut(from_shared.union(several.where("NOT a_shared").select(F.col("a").alias("l"), "a", "b", "a_shared", "b_shared")))
    right = members.select(F.col("id").alias("r"), F.col("place").alias("b"))
    across = join_balanced(linked.where("b_shared").select("l", "a", "b"), right, "b", ["l"], most_sent=MOST_BROADCAST)
    across = across.where("a <> b OR l < r").select("l", "r")
    across = across.union(linked.where("NOT b_shared").select("l", F.col("b").alias("r")))
    return single.union(across).select(F.least("l", "r").alias("a_id"), F.greatest("l", "r").alias("b_id"))


# --- regions -----------------------------------------------------------------------------------


def region_rings(text: str | None) -> list[list[np.ndarray]]:
    """The polygons of a shape, each a list of rings; nothing of other shapes and of bad texts."""
    try:
        shape = parse(text) if text is not None else None
        if shape is None or shape[0] not in (POLYGON, MULTI_POLYGON):
            return []
        polygons = [shape[1]] if shape[0] == POLYGON else shape[1]
        if any(abs(x) > 180.0 for p in polygons for r in p for x, _ in r):
            kind, data = normalize(shape)
            polygons = [data] if kind == POLYGON else data
    except (ShapeError, RecursionError):
        return []
    return [[np.array(r) for r in p if r] for p in polygons if p and p[0]]


def contains(polygon: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a ray to the east meets the rings an odd number of times."""
    odd = np.zeros(len(x), bool)
    for ring in polygon:
        for (xa, ya), (xb, yb) in zip(ring[:-1], ring[1:]):
            if ya != yb:
                cross = (ya > y) != (yb > y)
                cross[cross] = x[cross] < xa + (y[cross] - ya) * ((xb - xa) / (yb - ya))
                odd ^= cross
    return odd


_COLUMNS = ["tile", "kind", "place", "region", "member", "xa", "ya", "xb", "yb"]
_ROW = "tile int, kind int, place {kind}, region long, member long, xa double, ya double, xb double, yb double"
PLACE, EDGE = 0, 1


def _edges(batches: Iterator[pa.RecordBatch], tiles: Tiles, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The edges of (id, shape, number) rows for each tile whose places they may part; lower ends come first."""
    for batch in batches:
        made = []
        for region, text, number in zip(*(c.to_pylist() for c in batch.columns)):
            for member, polygon in enumerate(region_rings(text), number):
                ends = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in polygon])
                ends = ends[ends[:, 1] != ends[:, 3]]
                down = ends[:, 1] > ends[:, 3]
                ends[down] = ends[down][:, [2, 3, 0, 1]]
                west, east = polygon[0][:, 0].min(), polygon[0][:, 0].max()
                n, tile = tiles.crossed(ends[:, 1], ends[:, 3], np.full(len(ends), west), np.full(len(ends), east))
                made.append((tile, np.full(len(n), region), np.full(len(n), member), ends[n]))
        if made:
            tile, region, member, ends = (np.concatenate(c) for c in zip(*made))
            rows = [tile.astype(np.int32), np.full(len(tile), EDGE, np.int32), pa.nulls(len(tile), kind), region, member, *ends.T]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in rows], _COLUMNS)


def _owned(batches: Iterator[pa.RecordBatch], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    """Places in the tiles that own them; ``member`` is 1 where several points share one."""
    for batch in batches:
        lat, lon, shared = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        n = len(lat)
        tile, ends = pa.array(tiles.own(lat, lon).astype(np.int32)), (pa.array(lon), pa.array(lat))
        rows = [tile, pa.array(np.full(n, PLACE, np.int32)), batch.column(0), pa.nulls(n, pa.int64()), pa.array(shared.astype(np.int64)), *ends, *ends]
        yield pa.RecordBatch.from_arrays(rows, _COLUMNS)


#: Edges of whole regions that a tile works on at once; a region of more is worked on alone.
EDGES = 1 << 16


class _TilePlaces:
    """The places of a tile, in the order of longitude, and which of them regions contain."""

    def __init__(self, rows: list[pa.RecordBatch]):
        named = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows])
        place, shared, lon, lat = map(named, ("place", "member", "xa", "ya"))
        order = np.argsort(lon, kind="stable")
        self.place, self.shared, self.lon, self.lat = place[order], shared[order] > 0, lon[order], lat[order]

    def within(self, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> np.ndarray:
        """Numbers of the places at which a ray to the east meets the edges an odd number of times."""
        start = np.searchsorted(self.lon, min(xa.min(), xb.min()), "left")
        end = np.searchsorted(self.lon, max(xa.max(), xb.max()), "right")
        if start == end:
            return np.empty(0, np.int64)
        order = start + np.argsort(self.lat[start:end], kind="stable")
        lat, lon, odd = self.lat[order], self.lon[order], np.zeros(end - start, bool)
        first, last = np.searchsorted(lat, ya, "left"), np.searchsorted(lat, yb, "left")
        size = last - first
        upto, done = np.cumsum(size), 0
        while done < len(size):
            base = upto[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
            part = size[done:to]
            e = np.repeat(np.arange(done, to), part)
            at = np.repeat(first[done:to] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            done = to
            east = lon[at] < xa[e] + (lat[at] - ya[e]) * ((xb[e] - xa[e]) / (yb[e] - ya[e]))
            odd ^= np.bincount(at[east], minlength=len(odd)) % 2 == 1
        return order[odd]


def _sweep_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, shared, region) of a tile's rows: its places first, then edges in order of region and member."""
    rows, places, held, size = [], None, [], 0

    def contained(edges: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        region, member = edges.column("region").to_numpy(), edges.column("member").to_numpy()
        starts = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(region) else np.empty(0, np.int64)
        upto = len(region) if last or not len(starts) else int(starts[-1])
        ends = [edges.column(c).to_numpy() for c in ("xa", "ya", "xb", "yb")]
        hit, of = [np.empty(0, np.int64)], [region[:0]]
        for at, to in zip(starts, np.append(starts[1:], len(region))):
            if at >= upto:
                break
            parts = np.append(at + np.flatnonzero(np.append(True, member[at + 1 : to] != member[at : to - 1])), to)
            found = [places.within(*(c[i:j] for c in ends)) for i, j in zip(parts, parts[1:])]
            one = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            hit.append(one)
            of.append(np.full(len(one), region[at]))
        n, of = np.concatenate(hit), np.concatenate(of)
        made = [pa.array(places.place[n]), pa.array(places.shared[n]), pa.array(of, pa.int64())]
        return pa.RecordBatch.from_arrays(made, ["place", "shared", "region"]), edges.slice(upto)

    for batch in batches:
        edge = batch.column("kind").to_numpy() == EDGE
        n = int(np.argmax(edge)) if edge.any() else batch.num_rows
        if n:
            rows.append(batch.slice(0, n))
        if n == batch.num_rows or not rows:
            continue
        if places is None:
            places = _TilePlaces(rows)
        held.append(batch.slice(n))
        size += batch.num_rows - n
        if size >= EDGES:
            out, rest = contained(pa.Table.from_batches(held), False)
            yield out
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield contained(pa.Table.from_batches(held), True)[0]


def points_inside(
    points: DataFrame | Places, regions: DataFrame, region_id: str, shape: str, most_in_tile: int = 1 << 20, height: float = 0.01
) -> DataFrame:
    """(a_id, b_id): points, as of ``usable_points``, and the regions that contain them.

    ``height`` is the least height of a strip, in degrees.
    """
    at = points if isinstance(points, Places) else places_of(points)
    kind, arrow = dict(at.places.dtypes)["place"], to_arrow_type(at.places.schema["place"].dataType)
    rows = regions.select(F.col(region_id).cast("long").alias("id"), F.col(shape).cast("string").alias("shape"))
    # the shapes of one region are told apart by their numbers
    rows = rows.where("id IS NOT NULL AND shape IS NOT NULL").distinct().withColumn("number", F.shiftright(F.xxhash64("shape"), 1))
    tiles = plan_tiles(at.places, height, most_in_tile)
    held = at.places.mapInArrow(lambda it: _owned(it, tiles), _ROW.format(kind=kind))
    edges = rows.mapInArrow(lambda it: _edges(it, tiles, arrow), _ROW.format(kind=kind))
    together = held.union(edges).repartitionById(tiles.count, "tile").sortWithinPartitions("kind", "region", "member")
    found = together.mapInArrow(_sweep_regions, f"place {kind}, shared boolean, region long")
    members = at.members().where("shared").select("id", "place")
    found = cut(found)
    single = found.where("NOT shared").select(F.col("place").alias("a_id"), F.col("region").alias("b_id"))
    several = join_balanced(members, found.where("shared").select("place", "region"), "place", ["id"], most_sent=MOST_BROADCAST)
    return single.union(several.select(F.col("id").alias("a_id"), F.col("region").alias("b_id")))
