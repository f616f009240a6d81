"""Points near other points or inside regions: Voronoi cells around pivots, vantage-point trees inside.

Pivots are a bounded sample of the places, so cells follow the density of the data. A point lives in
the cell of its nearest pivot; it is copied to another cell only where the triangle inequality
allows a partner within the radius there, and only to cells of lower number, so every pair is met
exactly once. Inside a cell a vantage-point tree on the great-circle distance finds the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.runtime import cut, skew_join

EARTH_M = 6_371_008.8
#: Places aimed at per cell; the number of pivots follows from it.
CELL_PLACES = 1_500
#: Pivots at most: 3 doubles each, so what goes to the workers stays under 7 MB. Beyond 393 million spots cells grow, and
#: results stay the same.
MAX_PIVOTS = 262_144
#: Corners of all regions together that go to the workers at once (16 MB).
MAX_CORNERS = 1_000_000
#: Metres added to the triangle-inequality bounds for rounding; results are judged by the exact distance.
SLACK_M = 1.0
LEAF = 24


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def great_circle_m(lat1, lon1, lat2, lon2):
    """Haversine distance in metres on the sphere of radius EARTH_M."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def arc_m(dots: np.ndarray) -> np.ndarray:
    """Arc length from dot products of unit vectors; good to well under SLACK_M."""
    return EARTH_M * np.arccos(np.clip(dots, -1.0, 1.0))


class VantageTree:
    """A vantage-point tree over places, queried for many centres at once."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.lat, self.lon = lat, lon
        self.root = self._grow(np.arange(len(lat)))

    def _grow(self, idx: np.ndarray):
        if len(idx) <= LEAF:
            return idx
        vp = idx[0]
        rest = idx[1:]
        d = great_circle_m(self.lat[vp], self.lon[vp], self.lat[rest], self.lon[rest])
        mid = float(np.median(d))
        near = d <= mid
        if near.all():  # many equal distances: no split helps
            return idx
        return vp, mid, self._grow(rest[near]), self._grow(rest[~near])

    def within(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, place) at most `radius[query]` metres apart."""
        qs, ps = [], []
        todo = [(self.root, np.arange(len(lat)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, tuple):
                vp, mid, inner, outer = node
                d = great_circle_m(lat[q], lon[q], self.lat[vp], self.lon[vp])
                hit = q[d <= radius[q]]
                qs.append(hit)
                ps.append(np.full(len(hit), vp))
                todo.append((inner, q[d - radius[q] <= mid + 1e-3]))
                todo.append((outer, q[d + radius[q] >= mid - 1e-3]))
            elif len(node):
                step = max(1, 2_000_000 // len(node))
                for s in range(0, len(q), step):
                    part = q[s : s + step]
                    d = great_circle_m(lat[part][:, None], lon[part][:, None], self.lat[node][None, :], self.lon[node][None, :])
                    a, b = np.nonzero(d <= radius[part][:, None])
                    qs.append(part[a])
                    ps.append(node[b])
        none = np.empty(0, np.intp)
        return (np.concatenate(qs), np.concatenate(ps)) if qs else (none, none)


def ring_contains(ring_lat: np.ndarray, ring_lon: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Even-odd test along each point's meridian; a side whose longitudes differ by over 180 takes the short way.

    Needs no unwrapping, so rings across the date line are nothing special. A corner counts with the
    side that begins there, so a meridian through a corner is not counted twice.
    """
    inside = np.zeros(len(lat), bool)
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    span = wrap(np.roll(ring_lon, -1) - ring_lon)
    side = np.nonzero(span != 0)[0]
    lat0, lon0, rise, span = ring_lat[side], ring_lon[side], (np.roll(ring_lat, -1) - ring_lat)[side], span[side]
    step = max(1, 1_000_000 // max(1, len(side)))  # points against all sides at once, in blocks
    for s in range(0, len(lat), step):
        t = wrap(lon[s : s + step, None] - lon0[None])
        over = np.where(span > 0, (t >= 0) & (t < span), (t < 0) & (t >= span))
        above = lat0 + rise * (t / span) > lat[s : s + step, None]
        inside[s : s + step] = (over & above).sum(axis=1) % 2 == 1
    return inside


def places(rows: DataFrame, id_col: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct (id, lat, lon) that are places: both set, in range, not both zero."""
    p = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return p.where("id is not null and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)").distinct()


def regions_with_circle(regions: DataFrame) -> DataFrame:
    """Regions with a bounding circle (centre and radius); rings under three corners or with nulls contain nothing and are left out."""
    ok = "size(ring_lat) >= 3 and size(ring_lat) = size(ring_lon) and not exists(ring_lat, x -> x is null or isnan(x)) and not exists(ring_lon, x -> x is null or isnan(x))"

    def circle(batches):
        for pdf in batches:
            lat0, lon0, rad = [], [], []
            for la, lo in zip(pdf.ring_lat, pdf.ring_lon):
                la, lo = np.asarray(la, float), np.asarray(lo, float)
                # along a side straight in degrees latitudes lie between those of its ends: points every quarter degree, and what can lie between them
                k = np.maximum(2, np.ceil(4 * np.maximum(abs(np.roll(la, -1) - la), abs((np.roll(lo, -1) - lo + 180) % 360 - 180))).astype(int) + 1)
                sa = np.concatenate([np.linspace(a, b, n) for a, b, n in zip(la, np.roll(la, -1), k)])
                so = np.concatenate([np.linspace(a, a + ((b - a + 180) % 360 - 180), n) for a, b, n in zip(lo, np.roll(lo, -1), k)])
                c = unit(sa, so).mean(axis=0)
                size = np.linalg.norm(c)
                c = c / size if size > 1e-9 else np.array([0.0, 0.0, 1.0])
                ca, co = np.degrees(np.arcsin(c[2])), np.degrees(np.arctan2(c[1], c[0]))
                r = great_circle_m(ca, co, sa, so).max() + 30_000
                # beyond a quarter of the globe the inside may hold more than the circle: take the whole sphere
                lat0.append(ca), lon0.append(co), rad.append(float(r) if r < EARTH_M * np.pi / 2 else EARTH_M * 4.0)
            yield pdf.assign(lat=lat0, lon=lon0, reach=rad)

    r = regions.where(ok).select(F.col("region_id").cast("long").alias("id"), "ring_lat", "ring_lon").distinct()
    return r.mapInPandas(circle, "id long, ring_lat array<double>, ring_lon array<double>, lat double, lon double, reach double")


def _pivots(spots: DataFrame, n: int) -> np.ndarray:
    """A bounded sample of the spots: those with the smallest hashes. Only the sample comes to the driver."""
    k = int(min(MAX_PIVOTS, max(1, -(-n // CELL_PLACES))))
    # hashes are even, so about twice the sample lies below this bound; only those are sorted
    bound = min(2 * k + 1_000, n) / n
    h = F.xxhash64("lat", "lon")
    low = spots.select("lat", "lon", h.alias("h")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + bound * (1 << 64)))))
    got = low.orderBy("h", "lat", "lon").limit(k).select("lat", "lon").toArrow()
    if not got.num_rows:  # a few spots, all of high hashes
        got = spots.select("lat", "lon").orderBy(h, "lat", "lon").limit(k).toArrow()
    return unit(got["lat"].to_numpy(), got["lon"].to_numpy())


class Cells:
    """The cells of places around pivots, through a tree of two levels: pivots around some of them.

    A pivot group is looked into only where the triangle inequality allows a pivot nearer than the
    best known, so a place costs about as many distances as the square root of the pivots, not all.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        tops = np.arange(0, len(pivots), max(1, int(len(pivots) ** 0.5)))
        self.tops = pivots[tops]
        group = np.concatenate([arc_m(pivots[s : s + 4_096] @ self.tops.T).argmin(axis=1) for s in range(0, len(pivots), 4_096)])
        self.members = [np.nonzero(group == g)[0] for g in range(len(tops))]
        self.reach = np.array([arc_m(pivots[m] @ self.tops[g]).max() if len(m) else -np.inf for g, m in enumerate(self.members)])

    def near(self, xyz: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, home of the row) of all pivots a place may have to visit: at most 2 x reach beyond its nearest, the home."""
        top = arc_m(xyz @ self.tops.T)
        most = top.min(axis=1) + 2 * (reach + SLACK_M)
        rows, cells, arcs = [], [], []
        for g, m in enumerate(self.members):
            r = np.nonzero(top[:, g] - self.reach[g] - SLACK_M <= most)[0] if len(m) else np.empty(0, np.intp)
            if len(r):
                d = arc_m(xyz[r] @ self.pivots[m].T)
                i, j = np.nonzero(d <= most[r, None])
                rows.append(r[i]), cells.append(m[j]), arcs.append(d[i, j])
        row, cell, arc = np.concatenate(rows), np.concatenate(cells), np.concatenate(arcs)
        by = np.lexsort((cell, arc, row))
        row, cell, arc = row[by], cell[by], arc[by]
        first = np.concatenate(([True], row[1:] != row[:-1]))  # every place has a home: that of its nearest top at least
        nearest = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
        keep = arc <= arc[nearest] + 2 * (reach[row] + SLACK_M)
        return row[keep], cell[keep], cell[nearest][keep]


def _assign(pivots: np.ndarray):
    """Batches of (lat, lon, reach, ...) to the same rows with their home cell and every cell they must visit."""

    def run(batches):
        cells = Cells(pivots)
        step = max(1, 2_000_000 // max(1, len(cells.tops)))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s : s + step]
                row, cell, home = cells.near(unit(part.lat.to_numpy(), part.lon.to_numpy()), part.reach.to_numpy())
                # pairs of spots are met in the lower of their two cells; a region goes to every cell it may touch
                keep = part.everywhere.to_numpy()[row] | (cell <= home)
                row, cell, home = row[keep], cell[keep], home[keep]
                yield part.iloc[row].assign(cell=cell.astype(np.int64), native=cell == home)

    return run


def _search(radius_m: float, rings: dict[int, tuple] | None):
    """One cell: pairs of spots within the radius, and the regions around the native spots. `rings` holds the rings that do not travel with their rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spot = pdf[~pdf.everywhere]
        own = spot[spot.native]
        parts = []
        if len(own):
            lat, lon, ids = own.lat.to_numpy(), own.lon.to_numpy(), own.id.to_numpy()
            tree = VantageTree(lat, lon)
            q, p = tree.within(spot.lat.to_numpy(), spot.lon.to_numpy(), np.full(len(spot), float(radius_m)))
            a, b, nat = spot.id.to_numpy()[q], ids[p], spot.native.to_numpy()[q]
            keep = ~nat | (a < b)
            parts.append(pd.DataFrame({"relation": "near", "spot_a": a[keep], "spot_b": b[keep]}))
            for r in pdf[pdf.everywhere].itertuples():
                _, p = tree.within(np.array([r.lat]), np.array([r.lon]), np.array([r.reach]))
                ring = (np.asarray(r.ring_lat, float), np.asarray(r.ring_lon, float)) if rings is None else rings[r.ring]
                p = p[ring_contains(*ring, lat[p], lon[p])]
                parts.append(pd.DataFrame({"relation": "inside", "spot_a": ids[p], "spot_b": r.id}))
        return pd.concat(parts) if parts else pd.DataFrame({"relation": [], "spot_a": [], "spot_b": []})

    return run


def spot_relations(spots: DataFrame, regions: DataFrame | None, radius_m: float) -> DataFrame:
    """Relations of distinct spots (id, lat, lon): relation, spot_a, spot_b."""
    spark = spots.sparkSession
    schema = "relation string, spot_a long, spot_b long"
    n = spots.count()
    if not n:
        return spark.createDataFrame([], schema)
    pivots = _pivots(spots, n)
    kept = "id long, lat double, lon double, reach double, ring long, ring_lat array<double>, ring_lon array<double>, everywhere boolean"
    none = F.lit(None).cast("array<double>")
    rows = spots.select("id", "lat", "lon", F.lit(float(radius_m)).alias("reach"), F.lit(None).cast("long").alias("ring"), none.alias("ring_lat"), none.alias("ring_lon"), F.lit(False).alias("everywhere"))
    rings = None
    if regions is not None:
        # a region goes to many cells: up to a bounded number of corners its ring goes to the workers once, beyond it with each row
        r = cut(regions_with_circle(regions).withColumn("ring", F.monotonically_increasing_id()))
        if (r.agg(F.sum(F.size("ring_lat"))).first()[0] or 0) <= MAX_CORNERS:
            rings = {x.ring: (np.asarray(x.ring_lat, float), np.asarray(x.ring_lon, float)) for x in r.select("ring", "ring_lat", "ring_lon").collect()}
            r = r.withColumn("ring_lat", none).withColumn("ring_lon", none)
        rows = rows.unionByName(r.withColumn("everywhere", F.lit(True)))
    cells = rows.mapInPandas(_assign(pivots), kept + ", cell long, native boolean")
    return cells.groupBy("cell").applyInPandas(_search(radius_m, rings), schema)


def near_and_inside(rows: DataFrame, regions: DataFrame | None = None, *, radius_m: float = 50.0, expand: bool = True) -> DataFrame:
    """`near` pairs of rows within `radius_m` (smaller id first) and `inside` pairs of row and region: relation, id_a, id_b.

    Rows without a place (see `places`) don't count; repeated rows count once; an id given with two
    places is near whatever either place is near. Rows at the very same coordinates form one spot,
    named by its smallest id, so a crowded spot is searched once. With `expand` all pairs of rows are
    returned; without it `near` holds pairs of spots and `same` each row with its spot. Empty tables
    give no rows; extra columns are ignored.
    """
    pts = cut(places(rows))
    spots = pts.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    spots = cut(spots.withColumn("spot", F.monotonically_increasing_id()))  # numbered once: written and read again
    rel = cut(spot_relations(spots.select(F.col("spot").alias("id"), "lat", "lon"), regions, radius_m))
    at = F.struct("lat", "lon").alias("_at")
    member = cut(skew_join(pts.select("id", at), spots.select(at, "spot"), "_at").select("id", "spot"))
    if not expand:
        name = spots.select("spot", "id")
        near = rel.where("relation = 'near'").join(name.withColumnsRenamed({"spot": "spot_a", "id": "a"}), "spot_a").join(name.withColumnsRenamed({"spot": "spot_b", "id": "b"}), "spot_b")
        ins = rel.where("relation = 'inside'").join(name.withColumnsRenamed({"spot": "spot_a", "id": "a"}), "spot_a").select("relation", F.col("a").alias("id_a"), F.col("spot_b").alias("id_b"))
        same = member.join(name.withColumnRenamed("id", "name"), "spot").where("id <> name").select(F.lit("same").alias("relation"), F.col("name").alias("id_a"), F.col("id").alias("id_b"))
        return near.select("relation", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).unionByName(ins).unionByName(same)
    # the members of a spot on either side: for one row of a spot, one row per partner, which is the result's own size
    self_pairs = spots.where("n > 1").select(F.lit("near").alias("relation"), F.col("spot").alias("spot_a"), F.col("spot").alias("spot_b"))
    links = rel.where("relation = 'near'").unionByName(self_pairs)
    a = member.withColumnsRenamed({"id": "a", "spot": "spot_a"})
    b = member.withColumnsRenamed({"id": "b", "spot": "spot_b"})
    near = links.join(a, "spot_a").join(b, "spot_b").where("a <> b and (spot_a <> spot_b or a < b)")
    near = near.select("relation", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    ids_twice = pts.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    inside = rel.where("relation = 'inside'").join(a, "spot_a").select("relation", F.col("a").alias("id_a"), F.col("spot_b").alias("id_b"))
    out = near.unionByName(inside)
    return out.distinct() if ids_twice else out
