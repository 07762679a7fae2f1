"""Signals and distinct users of each site's catchment without a row for each pair in any shuffle.

Sites fall into tiles of several radii; a trace goes to the tiles that it can
reach, so all its pairs with a tile's sites are met there. A tile with many
traces is dealt to parts by user, one with many sites to slices of sites: a
part holds all traces of its users near the tile, so the distinct users of a
site's parts add up. Within a part traces lie in bands, sorted along each; a
site takes its stretch of every band, tests the true distance and marks the
users it meets. Shuffled are the traces (once a tile they reach), the sites
(once a part) and a row for each site and part, whatever the number of pairs.
By periods, a row for each site, part and period holds the distinct users.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from ..session import checkpoint

TILE = 8  # side of a tile in radii
PART = 50_000  # traces of a part, about
SLICE = 10_000  # sites of a slice, about
PERIOD_SLICE = 2_000  # the same by periods, where a part gives its users by site
PAIRS = 1 << 20  # pairs that a task tests at a time, about
MARKS = 1 << 24  # marks of users by site that a task holds at a time, about
BANDS = 8  # bands in a radius


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for every value, and the values by number; that of null is one more than the last."""
    codes = column.combine_chunks().dictionary_encode()
    return codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False), codes.dictionary


def _near(sites: pa.Table, traces: pa.Table, r: float, planar: float, most: int, *columns: np.ndarray) -> Iterator[tuple]:
    """The pairs within ``r``, at most ``most`` sites at a time: (first site, end, the pairs' sites from the first, the pairs' values of ``columns`` of the traces).

    No pair within ``r`` is farther apart than ``planar`` in the plane.
    """
    number = lambda t, c: t.column(c).to_numpy().astype(float)
    sx, sy, tx, ty = number(sites, "__sx"), number(sites, "__sy"), number(traces, "x"), number(traces, "y")
    width, side = planar * (1 + 1e-9) + 1e-6, planar / BANDS
    x0, y0, x1 = min(sx.min(), tx.min()) - 2 * width, min(sy.min(), ty.min()) - 2 * width, max(sx.max(), tx.max()) + 2 * width
    long = x1 - x0
    band = np.floor((ty - y0) / side)
    order = np.argsort(band * long + (tx - x0), kind="stable")
    place = (band * long + (tx - x0))[order]
    columns = tuple(c[order] for c in columns)
    lng, lat = number(traces, "lng")[order], number(traces, "lat")[order]
    phi = np.radians(lat)
    cos_phi = np.cos(phi)
    slng, sphi = number(sites, "__slng"), np.radians(number(sites, "__slat"))
    cos_sphi = np.cos(sphi)
    # the stretch of each band that a site's circle crosses
    bands = np.floor((sy - y0) / side)[:, None] + np.arange(-BANDS - 1, BANDS + 2)
    low = y0 + bands * side
    gap = np.maximum(np.maximum(low - sy[:, None], sy[:, None] - (low + side)), 0.0)
    half = np.sqrt(np.maximum(width**2 - gap**2, 0.0)) + 1e-3
    at = bands * long + (sx - x0)[:, None]
    begin = np.searchsorted(place, at - half, "left")
    held = np.where(gap <= width, np.searchsorted(place, at + half, "right") - begin, 0)
    total = np.concatenate([[0], np.cumsum(held.sum(1))])
    start = 0
    while start < len(sx):
        stop = min(max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1), start + most, len(sx))
        n = held[start:stop].ravel()
        t = np.repeat(begin[start:stop].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s = np.repeat(np.arange(start, stop), held[start:stop].sum(1))
        h = np.sin((sphi[s] - phi[t]) / 2) ** 2 + cos_phi[t] * cos_sphi[s] * np.sin(np.radians(slng[s] - lng[t]) / 2) ** 2
        near = 2.0 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= r
        t = t[near]
        yield start, stop, s[near] - start, *(c[t] for c in columns)
        start = stop


def _part_visits(sites: pa.Table, traces: pa.Table, r: float, planar: float) -> pa.Table:
    """(id, signals, users) of the sites that have traces within ``r``; signals count once for each of a site's rows."""
    user, values = _codes(traces.column("__user"))
    names = len(values)
    signals, users = np.zeros(sites.num_rows, np.int64), np.zeros(sites.num_rows, np.int64)
    for start, stop, s, u in _near(sites, traces, r, planar, max(1, MARKS // (names + 1)), user):
        signals[start:stop] = np.bincount(s, minlength=stop - start)
        met = np.zeros((stop - start, names + 1), bool)
        met[s, u] = True
        users[start:stop] = np.count_nonzero(met[:, :names], axis=1)
    some = np.flatnonzero(signals)
    return pa.table({"id": sites.column("__id").combine_chunks().take(pa.array(some)), "signals": (signals * sites.column("__rows").to_numpy())[some], "users": users[some]})


def _part_periods(sites: pa.Table, traces: pa.Table, r: float, planar: float) -> pa.Table:
    """(id, period, signals, users) of the sites and periods that have traces within ``r``; users are listed once each, null among them."""
    (user, values), (period, periods) = _codes(traces.column("__user")), _codes(traces.column("__period"))
    names, ids, many, found = len(values) + 1, sites.column("__id").combine_chunks(), sites.column("__rows").to_numpy(), []
    for start, _, s, u, p in _near(sites, traces, r, planar, PERIOD_SLICE, user, period):
        code, times = np.unique((s * len(periods) + p) * names + u, return_counts=True)
        if not len(code):
            continue
        group = code // names
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        listed = values.take(pa.array(code % names, mask=code % names == names - 1))
        users = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), listed)
        group = group[first]
        found.append(pa.table({"id": ids.take(pa.array(start + group // len(periods))), "period": periods.take(pa.array(group % len(periods))),
                               "signals": np.add.reduceat(times, first) * many[start + group // len(periods)], "users": users}))
    return pa.concat_tables(found) if found else None


def site_visits(sites: DataFrame, traces: DataFrame, r: float, planar: float, site_id: str, user: str) -> DataFrame:
    """(site_id, signals, users): traces within geodesic distance ``r`` and their distinct users.

    ``sites`` have ids that are not null, once each, ``__sx, __sy, __slng, __slat`` and ``__rows``, how often their signals count;
    ``traces`` ``x, y, lng, lat`` and the user. ``planar`` bounds the planar distance of a pair within ``r``.
    """
    met = _in_tiles(sites, traces.withColumn("__user", F.col(user)), planar, site_id, [], SLICE, lambda s, t: _part_visits(s, t, float(r), planar), "signals long, users long")
    return met.groupBy(F.col("id").alias(site_id)).agg(F.sum("signals").alias("signals"), F.sum("users").alias("users"))


def period_visits(sites: DataFrame, traces: DataFrame, r: float, planar: float, site_id: str, user: str, period: Column) -> DataFrame:
    """(site_id, period, signals, user): as ``site_visits``, with a row for each period (a time that isn't null) and each of its distinct users.

    A user's rows of a site and period come from one task; the signals stand in one row of them, the others have 0.
    """
    t = traces.withColumns({"__user": F.col(user), "__period": F.unix_micros(period)})
    kind = t.schema["__user"].dataType.simpleString()
    met = _in_tiles(sites, t, planar, site_id, ["__period"], PERIOD_SLICE, lambda s, t: _part_periods(s, t, float(r), planar), f"period long, signals long, users array<{kind}>")
    one = met.select("id", "period", "signals", F.posexplode("users").alias("__at", "user"))
    return one.select(F.col("id").alias(site_id), F.timestamp_micros("period").alias("period"), F.when(F.col("__at") == 0, F.col("signals")).otherwise(0).alias("signals"), "user")


def _in_tiles(sites: DataFrame, traces: DataFrame, planar: float, site_id: str, carry: list[str], per_slice: int,
              visits: Callable[[pa.Table, pa.Table], pa.Table | None], columns: str) -> DataFrame:
    """(id, ``columns``): what ``visits`` finds for the sites and traces of every part and slice of a tile; ``carry`` are more columns of the traces."""
    side = F.lit(TILE * planar)
    inf = F.lit(float("inf"))
    finite = lambda *c: [F.abs(F.col(v)) < inf for v in c]
    s, t = sites, traces.select("x", "y", "lng", "lat", "__user", *carry)
    for c in finite("__sx", "__sy", "__slng", "__slat"):
        s = s.where(c)
    for c in finite("x", "y", "lng", "lat"):
        t = t.where(c)
    s = s.select(F.col(site_id).alias("__id"), "__sx", "__sy", "__slng", "__slat", "__rows", F.floor(F.col("__sx") / side).alias("__i"), F.floor(F.col("__sy") / side).alias("__j"))
    reach = F.lit(planar * (1 + 1e-9) + 1e-6)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    t = t.select("*", tiles("x").alias("__i")).select("*", tiles("y").alias("__j"))
    deal = s.groupBy("__i", "__j").agg(F.ceil(F.count("*") / per_slice).alias("__slices")).join(
        t.groupBy("__i", "__j").agg(F.ceil(F.count("*") / PART).alias("__parts")), ["__i", "__j"])
    deal, _ = checkpoint(deal)
    key = ["__i", "__j", "__part", "__slice"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    t = t.join(deal, ["__i", "__j"]).withColumn("__part", F.pmod(F.xxhash64("__user"), F.col("__parts"))).withColumn("__slice", each("__slices"))
    s = s.join(deal, ["__i", "__j"]).withColumn("__slice", F.pmod(F.xxhash64("__id"), F.col("__slices"))).withColumn("__part", each("__parts"))
    t = t.select(*key, "x", "y", "lng", "lat", "__user", *carry)
    s = s.select(*key, "__id", "__sx", "__sy", "__slng", "__slat", "__rows")
    schema = f"id {s.schema['__id'].dataType.simpleString()}, {columns}"
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def run(_, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = visits(ours, theirs) if ours.num_rows and theirs.num_rows else None
        return empty.empty_table() if found is None else found

    return s.groupBy(*key).cogroup(t.groupBy(*key)).applyInArrow(run, schema)
