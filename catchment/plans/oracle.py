"""DuckDB oracle SQL, one statement per registered query.

The oracle sees only the driver's tables, so it derives the same layers with
the same integer arithmetic (CTEs below), projects with the same series in
plain SQL, ray-casts by unnesting WKT vertices and counting crossings, and
brute-forces every spatial join as a cross product (no grid), which makes it
an independent check of the grid rewrites.
"""

from __future__ import annotations

from ..sources import fixtures as fx

class _g:
    """Fixed values of the projection (transverse Mercator on GRS80, EPSG:2180), as literals of the oracle's own."""

    _E = 0.08181919104281579
    _ALPHA = (0.0008377318247344344, 7.608527788826164e-07, 1.1976380191731537e-09, 2.443376242510368e-12)
    _BETA = (0.000837732168164144, 5.905869626082731e-08, 1.6734889049883464e-10, 2.1677378055967573e-13)
    _DELTA = (0.0033565514855966932, 6.571873148458866e-06, 1.7646564264542834e-08, 5.400482187759887e-11)
    _KA = 6362991.9313690085
    CS92_LON0_DEG = 19.0
    CS92_FALSE_EASTING = 500000.0
    CS92_FALSE_NORTHING = -5300000.0
    EARTH_RADIUS_M = 6371008.8


R = 1500.0
SUB = {"lng_min": 19.0, "lat_min": 50.0, "lng_max": 19.6, "lat_max": 50.3}


def _coords(key: str, salt: int) -> tuple[str, str]:
    z = f"(CAST({key} AS BIGINT) + {salt})"
    lat = f"(CAST(49.96 AS DOUBLE) + CAST(({z}*{z}*31 + {z}*7919 + 101) % 5200 AS DOUBLE) / 10000.0)"
    lng = f"(CAST(18.54 AS DOUBLE) + CAST(({z}*{z}*17 + {z}*104729 + 37) % 15800 AS DOUBLE) / 10000.0)"
    return lat, lng


def _units(key: str, salt: int) -> tuple[str, str]:
    z = f"(CAST({key} AS BIGINT) + {salt})"
    return (f"(499600 + ({z}*{z}*31 + {z}*7919 + 101) % 5200)", f"(185400 + ({z}*{z}*17 + {z}*104729 + 37) % 15800)")


def _text(u: str, d: int) -> str:
    s = 10**d
    return f"(CAST(({u}) // {s} AS VARCHAR) || '.' || lpad(CAST(({u}) % {s} AS VARCHAR), {d}, '0'))"


def _xy(lng: str, lat: str) -> tuple[str, str]:
    e = repr(_g._E)
    phi = f"radians({lat})"
    lam = f"radians({lng} - {_g.CS92_LON0_DEG!r})"
    t = f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi})))"
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1.0 + ({t}) * ({t})))"
    sx, sy = xi, eta
    for j, a in enumerate(_g._ALPHA, start=1):
        sx = f"({sx} + {a!r} * sin({2.0 * j!r} * {xi}) * cosh({2.0 * j!r} * {eta}))"
        sy = f"({sy} + {a!r} * cos({2.0 * j!r} * {xi}) * sinh({2.0 * j!r} * {eta}))"
    x = f"({_g.CS92_FALSE_EASTING!r} + {_g._KA!r} * {sy})"
    y = f"({_g.CS92_FALSE_NORTHING!r} + {_g._KA!r} * {sx})"
    return x, y


def with_xy(src: str) -> str:
    x, y = _xy("lng", "lat")
    return f"SELECT *, {x} AS x, {y} AS y FROM ({src}) WHERE lng IS NOT NULL AND lat IS NOT NULL"


_slat, _slng = _coords("s_suppkey", fx.STORE_SALT)
_plat, _plng = _coords("p_partkey", fx.POI_SALT)
_alat, _alng = _coords("c_custkey", fx.ADDRESS_SALT)
_tlat_u, _tlng_u = _units("event_id", fx.TRACE_SALT)
_blat_u, _blng_u = _units("o_orderkey", fx.BUILDING_SALT)

_cats = ", ".join(f"'{c}'" for c in fx.BUILDING_CATEGORIES)
_res = ", ".join(f"'{c}'" for c in fx.RESIDENTIAL_CATEGORIES)


def _bvert(dx: int, dy: int) -> str:
    return (_text(f"{_blng_u} * 1000 + ({dx}) * h7", 7) + " || ' ' || " + _text(f"{_blat_u} * 1000 + ({dy}) * h7", 7))


def _dvert(dx: int, dy: int) -> str:
    clng = "(185400 + (2 * (n_nationkey % 5) + 1) * 1580)"
    clat = "(499600 + (2 * (n_nationkey // 5) + 1) * 520)"
    return _text(f"{clng} + ({dx})", 4) + " || ' ' || " + _text(f"{clat} + ({dy})", 4)


FIXTURES = {
    "stores": f"SELECT s_suppkey AS location_id, {_slat} AS lat, {_slng} AS lng, "
              f"CAST(100000.0 AS DOUBLE) + CAST(30.0 AS DOUBLE) * s_acctbal AS monthly_revenue FROM supplier",
    "poi": f"SELECT p_partkey AS poi_id, lower(p_type) AS category, p_name AS name, {_plat} AS lat, {_plng} AS lng FROM part",
    "competitors": f"SELECT p_partkey AS comp_id, p_brand AS brand, {_plat} AS lat, {_plng} AS lng FROM part WHERE p_size % 5 = 0",
    "addresses": (
        "SELECT c_custkey AS id, c_mktsegment AS city, "
        "CASE WHEN c_custkey % 11 != 0 THEN 'St ' || CAST(c_custkey % 97 AS VARCHAR) END AS street, "
        "CAST(c_custkey % 200 + 1 AS VARCHAR) AS house_number, "
        "CAST(1 + c_custkey % 7 AS INTEGER) AS households, "
        "round_even(CAST(1 + c_custkey % 40 AS DOUBLE) / CAST(1 + c_custkey % 7 AS DOUBLE), 1) AS household_size, "
        "CAST(1 + c_custkey % 40 AS INTEGER) AS total, "
        "CAST((1 + c_custkey % 40) // 2 AS INTEGER) AS male, "
        "CAST((1 + c_custkey % 40) - (1 + c_custkey % 40) // 2 AS INTEGER) AS female, "
        f"{_alat} AS lat, {_alng} AS lng FROM customer"
    ),
    "traces": (
        "SELECT event_id AS trace_id, "
        f"CASE WHEN event_id % 997 = 0 THEN 'bad' ELSE {_text(_tlat_u, 4)} END AS latitude, "
        f"CASE WHEN event_id % 997 = 0 THEN 'bad' ELSE {_text(_tlng_u, 4)} END AS longitude, "
        "CASE WHEN event_id % 997 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS occured_at, "
        "user_id AS proxi_user_id, event_type AS app_id, CAST(NULL AS VARCHAR) AS geohash, "
        "CAST(NULL AS VARCHAR) AS pairing_id, CAST(NULL AS VARCHAR) AS mac_address, "
        "CASE WHEN event_id % 3 = 0 THEN CAST(-(40 + event_id % 60) AS INTEGER) END AS rssi FROM events"
    ),
    "buildings": (
        f"SELECT o_orderkey AS lokalnyid, list_extract([{_cats}], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS funogolnabudynku_desc, "
        "CAST(4.0 * (5 + o_orderkey % 20) * (5 + o_orderkey % 20) AS DOUBLE) AS area, "
        "'POLYGON ((' || " + " || ', ' || ".join(_bvert(a, b) for a, b in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)])
        + " || '))' AS geometry "
        "FROM (SELECT o_orderkey, CAST(floor(CAST((5 + o_orderkey % 20) * 10000000 AS DOUBLE) / 111320) AS BIGINT) AS h7 FROM orders)"
    ),
    "districts": (
        "SELECT n_nationkey AS district_id, n_name AS name, 'POLYGON ((' || "
        + " || ', ' || ".join(_dvert(a, b) for a, b in fx.DISTRICT_OFFSETS + fx.DISTRICT_OFFSETS[:1])
        + " || '))' AS geometry FROM nation"
    ),
    "area": f"SELECT 'Analysis area' AS area_name, '{fx.AREA_WKT}' AS geometry",
}
FIXTURES["stores_xy"] = with_xy("SELECT * FROM stores")
FIXTURES["poi_xy"] = with_xy("SELECT * FROM poi")
FIXTURES["comp_xy"] = with_xy("SELECT * FROM competitors")
FIXTURES["addr_xy"] = with_xy("SELECT * FROM addresses")


def _verts(src: str, id_col: str) -> str:
    return (
        f"SELECT id, idx, CAST(split_part(v, ' ', 1) AS DOUBLE) AS lng, CAST(split_part(v, ' ', 2) AS DOUBLE) AS lat "
        f"FROM (SELECT id, unnest(generate_series(1, len(parts))) AS idx, unnest(parts) AS v FROM "
        f"(SELECT {id_col} AS id, string_split(regexp_extract(geometry, '\\(\\((.*)\\)\\)', 1), ', ') AS parts FROM {src}))"
    )


def _edges(verts: str) -> str:
    return (f"SELECT a.id, a.idx, a.lng AS ax, a.lat AS ay, b.lng AS bx, b.lat AS by_ FROM {verts} a "
            f"JOIN {verts} b ON a.id = b.id AND b.idx = a.idx + 1")


FIXTURES["dverts"] = _verts("districts", "district_id")
FIXTURES["dedges"] = _edges("dverts")
FIXTURES["averts"] = _verts("area", "0")
FIXTURES["aedges"] = _edges("averts")
FIXTURES["bverts"] = _verts("buildings", "lokalnyid")
_bx, _by = _xy("lng", "lat")
FIXTURES["bverts_xy"] = f"SELECT id, idx, {_bx} AS x, {_by} AS y FROM bverts"
_dx, _dy = _xy("lng", "lat")
FIXTURES["dverts_xy"] = f"SELECT id, idx, {_dx} AS x, {_dy} AS y FROM dverts"
FIXTURES["averts_xy"] = f"SELECT id, idx, {_dx} AS x, {_dy} AS y FROM averts"
FIXTURES["bedges_xy"] = ("SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM bverts_xy a "
                         "JOIN bverts_xy b ON a.id = b.id AND b.idx = a.idx + 1")
FIXTURES["dedges_xy"] = ("SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM dverts_xy a "
                         "JOIN dverts_xy b ON a.id = b.id AND b.idx = a.idx + 1")
FIXTURES["aedges_xy"] = ("SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM averts_xy a "
                         "JOIN averts_xy b ON a.id = b.id AND b.idx = a.idx + 1")

_ORDER = ["stores", "poi", "competitors", "addresses", "traces", "buildings", "districts", "area",
          "stores_xy", "poi_xy", "comp_xy", "addr_xy", "dverts", "dedges", "averts", "aedges", "bverts",
          "bverts_xy", "dverts_xy", "averts_xy", "bedges_xy", "dedges_xy", "aedges_xy"]
_DEPS = {
    "stores_xy": ["stores"], "poi_xy": ["poi"], "comp_xy": ["competitors"], "addr_xy": ["addresses"],
    "dverts": ["districts"], "dedges": ["dverts"], "averts": ["area"], "aedges": ["averts"],
    "bverts": ["buildings"], "bverts_xy": ["bverts"], "dverts_xy": ["dverts"], "averts_xy": ["averts"],
    "bedges_xy": ["bverts_xy"], "dedges_xy": ["dverts_xy"], "aedges_xy": ["averts_xy"],
}


def sql(body: str, *names: str) -> str:
    """Prefix ``body`` with the fixture CTEs it names (and their dependencies)."""
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        need.add(n)
        for d in _DEPS.get(n, []):
            add(d)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in _ORDER if n in need]
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _pip(points: str, pid: str, edges: str) -> str:
    """(pid, polygon id) pairs with the point strictly inside (even-odd)."""
    return (
        f"SELECT p.{pid} AS pid, e.id AS poly FROM {points} p, {edges} e "
        f"GROUP BY p.{pid}, e.id HAVING sum(CASE WHEN (e.ay > p.lat) != (e.by_ > p.lat) AND "
        f"p.lng < (e.bx - e.ax) * (p.lat - e.ay) / (e.by_ - e.ay) + e.ax THEN 1 ELSE 0 END) % 2 = 1"
    )


BASE = ("TRY_CAST(latitude AS DOUBLE) BETWEEN 49.96 AND 50.48 AND TRY_CAST(longitude AS DOUBLE) BETWEEN 18.54 AND 20.12 "
        "AND try_strptime(occured_at, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '2024-01-01 00:00:00' "
        "AND try_strptime(occured_at, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '2024-02-01 00:00:00'")
BBOXT = "TRY_CAST(latitude AS DOUBLE) BETWEEN 49.96 AND 50.48 AND TRY_CAST(longitude AS DOUBLE) BETWEEN 18.54 AND 20.12"
TS = "try_strptime(occured_at, '%Y-%m-%d %H:%M:%S')"
D2 = "((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))"


def _hav(lng1, lat1, lng2, lat2):
    p1, p2 = f"radians({lat1})", f"radians({lat2})"
    dphi = f"({p2} - {p1})"
    dlam = f"radians({lng2} - {lng1})"
    h = f"(pow(sin({dphi} / 2), 2) + cos({p1}) * cos({p2}) * pow(sin({dlam} / 2), 2))"
    return f"({2.0 * _g.EARTH_RADIUS_M!r} * asin(sqrt(least({h}, 1.0))))"


def _count_in(layer: str, name: str, val: str = "count(*)", sites: str = "stores_xy", sid: str = "location_id") -> str:
    return (f"SELECT s.{sid}, CAST(coalesce(c.v, 0) AS BIGINT) AS {name} FROM {sites} s LEFT JOIN "
            f"(SELECT s.{sid}, {val} AS v FROM {sites} s, {layer} p WHERE {D2} < {R * R!r} "
            f"GROUP BY s.{sid}) c ON s.{sid} = c.{sid}")


def _nearest(sites: str, sid: str, layer: str, lid: str, extra_part: str = "") -> str:
    return (f"SELECT {sid}, {lid}, d FROM (SELECT s.{sid}, p.{lid}, sqrt({D2}) AS d, row_number() OVER "
            f"(PARTITION BY s.{sid}{extra_part} ORDER BY sqrt({D2}), p.{lid}) AS rn FROM {sites} s, {layer} p) WHERE rn = 1")


O: dict[str, str] = {}

# ------------------------------------------------------------------ A
O["scan_points"] = sql("SELECT * FROM poi", "poi")
O["scan_polygons"] = sql(
    "SELECT d.district_id, d.name, CAST(v.idx - 1 AS INTEGER) AS pos, round(v.lng, 6) AS lng, round(v.lat, 6) AS lat "
    "FROM districts d JOIN dverts v ON v.id = d.district_id", "districts", "dverts")
O["trace_layout"] = sql(
    f"SELECT year({TS}) * 100 + month({TS}) AS month, count(*) AS n, count(DISTINCT proxi_user_id) AS users FROM traces WHERE {BBOXT.replace('49.96', '50.0').replace('50.48', '50.3').replace('18.54', '19.0').replace('20.12', '19.6')} "
    f"AND {TS} IS NOT NULL GROUP BY 1", "traces")
O["scan_csv_gz"] = sql("SELECT id, city, street, total FROM addresses", "addresses")
O["scan_warehouse"] = "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type"
O["scan_parquet"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
O["roundtrip_parquet"] = sql("SELECT location_id, lat, lng, monthly_revenue FROM stores WHERE location_id % 5 = 2", "stores")
O["roundtrip_csv"] = sql("SELECT * FROM competitors", "competitors")
O["bbox_json"] = sql("SELECT min(lng) AS lng_min, min(lat) AS lat_min, max(lng) AS lng_max, max(lat) AS lat_max FROM stores", "stores")
O["materialize"] = sql(
    f"SELECT c.location_id, c.competitor_count_1500m, round(n.d, 3) AS nearest_competitor_m FROM ({_count_in('comp_xy', 'competitor_count_1500m')}) c "
    f"LEFT JOIN ({_nearest('stores_xy', 'location_id', 'comp_xy', 'comp_id')}) n ON c.location_id = n.location_id",
    "stores", "stores_xy", "comp_xy")
O["preview"] = sql("SELECT trace_id, latitude, longitude, occured_at FROM traces ORDER BY trace_id LIMIT 5", "traces")

# ------------------------------------------------------------------ B
O["project_xy"] = sql("SELECT location_id, round(lng, 6) AS lng, round(lat, 6) AS lat, round(x, 3) AS x, round(y, 3) AS y FROM stores_xy", "stores_xy")
O["wkt_vertices"] = sql("SELECT id AS district_id, CAST(idx - 1 AS INTEGER) AS pos, round(lng, 6) AS lng, round(lat, 6) AS lat FROM dverts", "dverts")
O["layer_bounds"] = sql(
    "SELECT id AS district_id, round(min(lng), 6) AS min_lng, round(min(lat), 6) AS min_lat, round(max(lng), 6) AS max_lng, "
    "round(max(lat), 6) AS max_lat FROM dverts GROUP BY id", "dverts")
_cross = "(e.ax * e.by_ - e.bx * e.ay)"
O["polygon_centroid"] = sql(
    f"SELECT id AS district_id, round(sum((e.ax + e.bx) * {_cross}) / (sum({_cross}) / 2 * 6), 6) AS c_lng, "
    f"round(sum((e.ay + e.by_) * {_cross}) / (sum({_cross}) / 2 * 6), 6) AS c_lat FROM dedges e GROUP BY id", "dedges")
O["polygon_area"] = sql(
    f"SELECT a.id AS district_id, round(a.v, 9) AS area_deg2, round(m.v, 1) AS area_m2 FROM "
    f"(SELECT id, abs(sum({_cross}) / 2) AS v FROM dedges e GROUP BY id) a JOIN "
    f"(SELECT id, abs(sum({_cross}) / 2) AS v FROM dedges_xy e GROUP BY id) m ON a.id = m.id", "dedges", "dedges_xy")
_inb = f"(lat BETWEEN {SUB['lat_min']} AND {SUB['lat_max']} AND lng BETWEEN {SUB['lng_min']} AND {SUB['lng_max']})"
O["bbox_slice"] = sql(f"SELECT count(*) FILTER (WHERE {_inb}) AS inside, count(*) FILTER (WHERE NOT {_inb}) AS outside FROM addresses", "addresses")
O["bbox_text_filter"] = sql(
    f"SELECT count(*) AS n FROM traces WHERE TRY_CAST(latitude AS DOUBLE) BETWEEN {SUB['lat_min']} AND {SUB['lat_max']} "
    f"AND TRY_CAST(longitude AS DOUBLE) BETWEEN {SUB['lng_min']} AND {SUB['lng_max']}", "traces")
O["month_filter"] = sql(f"SELECT count(*) AS n FROM traces WHERE {TS} >= TIMESTAMP '2024-01-01' AND {TS} < TIMESTAMP '2024-02-01'", "traces")
O["base_filter"] = sql(f"SELECT count(*) AS n FROM traces WHERE {BASE}", "traces")
O["residential_flag"] = sql(
    f"SELECT CAST(CASE WHEN funogolnabudynku_desc IN ({_res}) THEN 1 ELSE 0 END AS INTEGER) AS is_residential, count(*) AS n "
    "FROM buildings GROUP BY 1", "buildings")
O["iqr_outliers"] = (
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events) "
    "SELECT event_id, round(value, 6) AS value, round(round_even((value - q2) / (q3 - q1), 2), 6) AS deviation "
    "FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")


def _building_feats(r: float, sites: str = "stores_xy", sid: str = "location_id") -> str:
    inside = (f"SELECT s.{sid}, v.id FROM {sites} s, bverts_xy v GROUP BY s.{sid}, v.id "
              f"HAVING bool_and((v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y) < {r * r!r})")
    return (
        f"SELECT s.{sid}, CAST(coalesce(c.n, 0) AS BIGINT) AS building_count_{int(r)}m, "
        f"round(coalesce(CAST(c.nres AS DOUBLE) / nullif(c.n, 0), 0.0), 6) AS residential_ratio_{int(r)}m FROM {sites} s LEFT JOIN "
        f"(SELECT i.{sid}, count(*) AS n, count(*) FILTER (WHERE b.funogolnabudynku_desc IN ({_res})) AS nres "
        f"FROM ({inside}) i JOIN buildings b ON b.lokalnyid = i.id GROUP BY i.{sid}) c ON s.{sid} = c.{sid}"
    )


O["residential_ratio"] = sql(_building_feats(R), "stores", "stores_xy", "bverts_xy", "buildings")
O["building_features"] = sql(_building_feats(3000.0), "stores", "stores_xy", "bverts_xy", "buildings")
O["signals_per_user"] = sql(
    f"SELECT app_id, count(*) AS signals, count(DISTINCT proxi_user_id) AS users, "
    f"round(CAST(count(*) AS DOUBLE) / count(DISTINCT proxi_user_id), 6) AS signals_per_user FROM traces WHERE {BASE} GROUP BY app_id", "traces")
_close = "(abs(household_size - CAST(total AS DOUBLE) / households) <= 0.01 + 1e-5 * abs(CAST(total AS DOUBLE) / households))"
O["isclose_audit"] = sql(
    f"SELECT count(*) FILTER (WHERE {_close}) AS matches, count(*) FILTER (WHERE NOT {_close}) AS mismatches, count(*) AS total, "
    f"round_even(count(*) FILTER (WHERE {_close}) * 100.0 / count(*), 1) AS match_pct FROM addresses", "addresses")
O["identity_audit"] = sql("SELECT count(*) FILTER (WHERE total != male + female) AS violations FROM addresses", "addresses")
O["log_target"] = sql("SELECT location_id, round(ln(monthly_revenue), 9) AS log_revenue FROM stores", "stores")
O["select_features"] = sql("SELECT location_id, round(monthly_revenue, 6) AS revenue FROM stores", "stores")
O["round_floor_abs"] = sql(
    "SELECT id, round(round_even(CAST(total AS DOUBLE) / households, 1), 6) AS size_1dp, "
    "CAST(floor(CAST(total AS DOUBLE) / households) AS BIGINT) AS size_floor, "
    "round(abs(household_size - CAST(total AS DOUBLE) / households), 6) AS discrepancy, printf('%d/%d', total, households) AS label "
    "FROM addresses", "addresses")
O["date_parts"] = sql(
    f"SELECT year({TS}) AS year, month({TS}) AS month, hour({TS}) AS hour, dayofweek({TS}) AS day_num, "
    f"left(dayname({TS}), 3) AS day_of_week, count(*) AS n FROM traces WHERE {TS} IS NOT NULL GROUP BY ALL", "traces")
O["missing_by_group"] = sql("SELECT city, count(*) AS missing_street FROM addresses WHERE street IS NULL GROUP BY city", "addresses")

# ------------------------------------------------------------------ C
O["radius_join"] = sql(f"SELECT s.location_id, p.poi_id, round(sqrt({D2}), 3) AS d FROM stores_xy s, poi_xy p WHERE {D2} < {R * R!r}",
                       "stores_xy", "poi_xy")
O["radius_join_polygons"] = sql(
    f"SELECT s.location_id, v.id AS lokalnyid FROM stores_xy s, bverts_xy v GROUP BY s.location_id, v.id "
    f"HAVING bool_and((v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y) < {R * R!r})", "stores_xy", "bverts_xy")
O["nearest_join"] = sql(f"SELECT location_id, round(d, 3) AS d, poi_id FROM ({_nearest('stores_xy', 'location_id', 'poi_xy', 'poi_id')})",
                        "stores_xy", "poi_xy")
O["pip_join"] = sql(f"SELECT p.poi_id, CAST(m.poly AS INTEGER) AS district_id FROM poi p LEFT JOIN ({_pip('poi', 'poi_id', 'dedges')}) m ON m.pid = p.poi_id",
                    "poi", "dedges")
O["inside_area"] = sql(f"SELECT pid AS location_id FROM ({_pip('stores', 'location_id', 'aedges')})", "stores", "aedges")
O["outside_area"] = sql(f"SELECT poi_id FROM poi WHERE poi_id NOT IN (SELECT pid FROM ({_pip('poi', 'poi_id', 'aedges')}))", "poi", "aedges")
O["unassigned"] = sql(f"SELECT location_id FROM stores WHERE location_id NOT IN (SELECT pid FROM ({_pip('stores', 'location_id', 'dedges')}))",
                      "stores", "dedges")
_tr = f"(SELECT trace_id, proxi_user_id, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lng FROM traces WHERE {BASE})"
O["dwithin_join"] = sql(f"SELECT s.location_id, t.trace_id FROM stores s, {_tr} t WHERE {_hav('t.lng', 't.lat', 's.lng', 's.lat')} <= {R!r}",
                        "stores", "traces")
def _poly_dist(sites: str, sid: str, edges: str) -> str:
    """Per (site, polygon): 0 when inside (even-odd in metres), else min distance to a boundary segment."""
    t = ("least(greatest(coalesce(((s.x - e.ax) * (e.bx - e.ax) + (s.y - e.ay) * (e.by_ - e.ay)) / "
         "nullif((e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay), 0), 0.0), 0.0), 1.0)")
    seg = (f"sqrt(pow(s.x - (e.ax + {t} * (e.bx - e.ax)), 2) + pow(s.y - (e.ay + {t} * (e.by_ - e.ay)), 2))")
    cross = ("CASE WHEN (e.ay > s.y) != (e.by_ > s.y) AND s.x < (e.bx - e.ax) * (s.y - e.ay) / (e.by_ - e.ay) + e.ax "
             "THEN 1 ELSE 0 END")
    return (f"SELECT s.{sid}, e.id, CASE WHEN sum({cross}) % 2 = 1 THEN 0.0 ELSE min({seg}) END AS d "
            f"FROM {sites} s, {edges} e GROUP BY s.{sid}, e.id")


O["containing_or_nearest"] = sql(
    f"SELECT location_id, lokalnyid, round(d, 3) AS d, round(area, 3) AS store_building_area FROM ("
    f"SELECT pd.location_id, pd.id AS lokalnyid, pd.d, b.area, row_number() OVER (PARTITION BY pd.location_id ORDER BY pd.d, pd.id) AS rn "
    f"FROM ({_poly_dist('stores_xy', 'location_id', 'bedges_xy')}) pd JOIN buildings b ON b.lokalnyid = pd.id) WHERE rn = 1",
    "stores_xy", "bedges_xy", "buildings")
O["semi_keys"] = sql(f"SELECT location_id, monthly_revenue FROM stores WHERE location_id IN (SELECT s.location_id FROM stores_xy s, comp_xy p WHERE {D2} < {R * R!r})",
                     "stores", "stores_xy", "comp_xy")
_seg_only = ("sqrt(pow(s.x - (e.ax + least(greatest(coalesce(((s.x - e.ax) * (e.bx - e.ax) + (s.y - e.ay) * (e.by_ - e.ay)) / "
             "nullif((e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay), 0), 0.0), 0.0), 1.0) * (e.bx - e.ax)), 2) + "
             "pow(s.y - (e.ay + least(greatest(coalesce(((s.x - e.ax) * (e.bx - e.ax) + (s.y - e.ay) * (e.by_ - e.ay)) / "
             "nullif((e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay), 0), 0.0), 0.0), 1.0) * (e.by_ - e.ay)), 2))")
O["boundary_distance"] = sql(
    f"SELECT s.location_id, round(min({_seg_only}), 3) AS boundary_m FROM stores_xy s, aedges_xy e "
    f"WHERE s.location_id NOT IN (SELECT pid FROM ({_pip('stores', 'location_id', 'aedges')})) GROUP BY s.location_id",
    "stores", "stores_xy", "aedges", "aedges_xy")
O["nearest_polygon"] = sql(
    f"SELECT location_id, CAST(id AS INTEGER) AS district_id, round(d, 3) AS d FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY d, id) AS rn FROM ({_poly_dist('stores_xy', 'location_id', 'dedges_xy')})) WHERE rn = 1",
    "stores_xy", "dedges_xy")

# ------------------------------------------------------------------ D
O["catchment_count"] = sql(_count_in("comp_xy", "competitor_count_1500m"), "stores", "stores_xy", "comp_xy")
O["catchment_sum"] = sql(_count_in("addr_xy", "population_1500m", "sum(p.total)"), "stores", "stores_xy", "addr_xy")
def _footfall(sites: str = "stores_xy", sid: str = "location_id") -> str:
    return (f"SELECT s.{sid}, CAST(coalesce(c.sig, 0) AS BIGINT) AS signals_1500m, CAST(coalesce(c.u, 0) AS BIGINT) AS unique_users_1500m "
            f"FROM {sites} s LEFT JOIN (SELECT s.{sid}, count(*) AS sig, count(DISTINCT t.proxi_user_id) AS u FROM {sites} s, {_tr} t "
            f"WHERE {_hav('t.lng', 't.lat', 's.lng', 's.lat')} <= {R!r} GROUP BY s.{sid}) c ON c.{sid} = s.{sid}")


O["footfall"] = sql(_footfall(), "stores_xy", "traces")
O["footfall_rollup"] = sql(
    f"SELECT s.location_id, CAST(coalesce(c.sig, 0) AS BIGINT) AS signals_1500m, CAST(coalesce(c.u, 0) AS BIGINT) AS users_estimate_1500m, "
    f"CAST(coalesce(c.u, 0) AS BIGINT) AS unique_users_1500m FROM stores_xy s LEFT JOIN (SELECT s.location_id, count(*) AS sig, count(DISTINCT t.proxi_user_id) AS u "
    f"FROM stores_xy s, {_tr[:-1]} AND {TS} >= TIMESTAMP '2024-01-05' AND {TS} < TIMESTAMP '2024-01-15') t "
    f"WHERE {_hav('t.lng', 't.lat', 's.lng', 's.lat')} <= {R!r} GROUP BY s.location_id) c USING (location_id)", "stores_xy", "traces")
# The categories in the driver's part table.
_CATS = ["economy", "large", "medium", "promo", "small", "standard"]


def _poi_features(sites: str = "stores_xy", sid: str = "location_id") -> str:
    cnt = ", ".join(f"CAST(count(*) FILTER (WHERE p.category = '{c}') AS BIGINT) AS c_{c}" for c in _CATS)
    pairs = f"SELECT s.{sid}, {cnt}, count(*) AS n FROM {sites} s, poi_xy p WHERE {D2} < {R * R!r} GROUP BY s.{sid}"
    near_cat = ", ".join(f"min(sqrt({D2})) FILTER (WHERE p.category = '{c}') AS n_{c}" for c in _CATS)
    near = f"SELECT s.{sid}, min(sqrt({D2})) AS nall, {near_cat} FROM {sites} s, poi_xy p GROUP BY s.{sid}"
    cols = ["CAST(coalesce(c.n, 0) AS BIGINT) AS poi_count_1500m", "round(m.nall, 3) AS nearest_poi_m"]
    for c in _CATS:
        cols += [f"coalesce(c.c_{c}, 0) AS poi_{c}_count_1500m", f"round(m.n_{c}, 3) AS nearest_poi_{c}_m"]
    return (f"SELECT s.{sid}, {', '.join(cols)} FROM {sites} s LEFT JOIN ({pairs}) c ON c.{sid} = s.{sid} "
            f"LEFT JOIN ({near}) m ON m.{sid} = s.{sid}")


def _matrix(sites: str, sid: str) -> str:
    """All five feature families of a site set, one CTE each, in ``{sites}_f``."""
    return (
        f"{sites}_c AS ({_count_in('comp_xy', 'competitor_count_1500m', sites=sites, sid=sid)}), "
        f"{sites}_n AS (SELECT s.{sid}, round(min(sqrt({D2})), 3) AS nearest_competitor_m FROM {sites} s, comp_xy p GROUP BY s.{sid}), "
        f"{sites}_p AS ({_poi_features(sites, sid)}), {sites}_b AS ({_building_feats(R, sites, sid)}), "
        f"{sites}_a AS ({_count_in('addr_xy', 'population_1500m', 'sum(p.total)', sites, sid)}), {sites}_t AS ({_footfall(sites, sid)}), "
        f"{sites}_f AS (SELECT * FROM {sites}_c LEFT JOIN {sites}_n USING ({sid}) JOIN {sites}_p USING ({sid}) JOIN {sites}_b USING ({sid}) "
        f"JOIN {sites}_a USING ({sid}) JOIN {sites}_t USING ({sid}))"
    )


_MDEPS = ("stores_xy", "comp_xy", "poi_xy", "addr_xy", "bverts_xy", "buildings", "traces")
O["assemble"] = sql("WITH " + _matrix("stores_xy", "location_id") + " SELECT round(s.monthly_revenue, 3) AS monthly_revenue, f.* "
                    "FROM stores_xy s JOIN stores_xy_f f ON f.location_id = s.location_id", *_MDEPS)
O["poi_features"] = sql(_poi_features(), "stores_xy", "poi_xy")
O["row_count"] = sql(f"SELECT count(*) AS n_all, count(*) FILTER (WHERE {BASE}) AS n_base FROM traces", "traces")
O["distinct_count"] = sql(f"SELECT count(DISTINCT proxi_user_id) AS distinct_proxi_user_id, count(DISTINCT app_id) AS distinct_app_id FROM traces WHERE {BASE}", "traces")
O["avg_signals_per_user"] = sql(
    f"SELECT count(*) AS signals, count(DISTINCT proxi_user_id) AS users, round(CAST(count(*) AS DOUBLE) / count(DISTINCT proxi_user_id), 6) AS avg_signals_per_user "
    f"FROM traces WHERE {BASE}", "traces")
O["time_extent"] = sql(f"SELECT CAST(min({TS}) AS VARCHAR) AS earliest, CAST(max({TS}) AS VARCHAR) AS latest FROM traces WHERE {BBOXT}", "traces")
O["monthly_counts"] = sql(f"SELECT year({TS}) AS year, month({TS}) AS month, count(*) AS signals FROM traces WHERE {BBOXT} AND {TS} IS NOT NULL GROUP BY 1, 2", "traces")
O["hourly_counts"] = sql(f"SELECT hour({TS}) AS hour, count(*) AS signals FROM traces WHERE {BASE} GROUP BY 1", "traces")
O["weekday_counts"] = sql(f"SELECT dayofweek({TS}) AS day_num, left(dayname({TS}), 3) AS day_of_week, count(*) AS signals FROM traces WHERE {BASE} GROUP BY 1, 2", "traces")
O["source_counts"] = sql(f"SELECT app_id, count(*) AS signals FROM traces WHERE {BASE} GROUP BY app_id", "traces")
O["top_share"] = sql(f"SELECT round(CAST(max(c) AS DOUBLE) / sum(c), 6) AS top_share, count(*) AS sources FROM (SELECT app_id, count(*) AS c FROM traces WHERE {BASE} GROUP BY app_id)", "traces")
_tcols = ["trace_id", "latitude", "longitude", "occured_at", "proxi_user_id", "app_id", "geohash", "pairing_id", "mac_address", "rssi"]
O["null_counts"] = sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM traces" for c in _tcols), "traces")
O["value_counts"] = sql(
    "SELECT brand, count(*) AS count, round(round_even(count(*) * 100.0 / (SELECT count(DISTINCT comp_id) FROM competitors), 1), 1) AS percentage "
    "FROM competitors GROUP BY brand", "competitors")
O["repeated_values"] = sql(
    "SELECT name, count(*) AS count, round(round_even(count(*) * 100.0 / (SELECT count(DISTINCT name) FROM poi), 1), 1) AS percentage "
    "FROM poi GROUP BY name HAVING count(*) > 1", "poi")
O["describe"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, "
    f"round(max({c}), 6) AS max FROM stores" for c in ["monthly_revenue", "lat", "lng"]), "stores")
_atypes = [("id", "bigint"), ("city", "string"), ("street", "string"), ("house_number", "string"), ("households", "int"),
           ("household_size", "double"), ("total", "int"), ("male", "int"), ("female", "int"), ("lat", "double"), ("lng", "double")]
O["schema_profile"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM addresses" for c, t in _atypes), "addresses")
O["domain_checks"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(sum(CAST({c} AS DOUBLE)), 6) AS sum, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round(max(CAST({c} AS DOUBLE)), 6) AS max, count(*) FILTER (WHERE {c} < 0) AS negatives, "
    f"count(*) FILTER (WHERE CAST({c} AS DOUBLE) - floor(CAST({c} AS DOUBLE)) != 0) AS non_integers FROM addresses"
    for c in ["households", "household_size", "total", "male", "female"]), "addresses")
O["skew_kurt"] = sql(
    "SELECT 'o_totalprice' AS \"column\", round(skewness(o_totalprice), 6) AS skewness, round(kurtosis(o_totalprice), 6) AS kurtosis FROM orders "
    "UNION ALL SELECT 'monthly_revenue', round(skewness(monthly_revenue), 6), round(kurtosis(monthly_revenue), 6) FROM stores", "stores")
O["histogram"] = sql(
    "WITH st AS (SELECT min(monthly_revenue) AS lo, max(monthly_revenue) AS hi FROM stores), "
    "b AS (SELECT CAST(least(floor((monthly_revenue - lo) * 10.0 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS c FROM stores, st GROUP BY 1) "
    "SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * (hi - lo) / 10.0, 3) AS lower, round(lo + (g.i + 1) * (hi - lo) / 10.0, 3) AS upper, "
    "CAST(coalesce(b.c, 0) AS BIGINT) AS count FROM range(10) g(i) CROSS JOIN st LEFT JOIN b ON b.bin = g.i", "stores")
O["dense_histogram"] = sql(
    "SELECT g.v AS value, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM range(0, 11) g(v) LEFT JOIN "
    "(SELECT CAST(floor(households) AS BIGINT) AS v, count(*) AS n FROM addresses GROUP BY 1) c ON c.v = g.v", "addresses")


def _tail_sql() -> str:
    edges = [15, 20, 30, 50, 100, 200, 500, 1000]
    lowers = [10] + edges
    uppers = edges + [None]
    rows = ", ".join(f"(CAST({lo} AS DOUBLE), CAST({('NULL' if up is None else up)} AS DOUBLE))" for lo, up in zip(lowers, uppers))
    return (
        "WITH t AS (SELECT CAST(total AS DOUBLE) AS v FROM addresses WHERE total > 10), mx AS (SELECT CAST(floor(max(v)) AS BIGINT) + 1 AS m FROM t), "
        f"g AS (SELECT lo, CASE WHEN up IS NULL OR up >= m THEN CAST(m AS DOUBLE) ELSE up END AS up FROM (VALUES {rows}) e(lo, up), mx WHERE lo < m) "
        "SELECT printf('[%d, %d]', CAST(g.lo AS BIGINT), CAST(g.up - 1 AS BIGINT)) AS bin, round(g.lo, 3) AS lower, round(g.up, 3) AS upper, "
        "CAST((SELECT count(*) FROM t WHERE t.v >= g.lo AND t.v < g.up) AS BIGINT) AS count FROM g"
    )


O["tail_bins"] = sql(_tail_sql(), "addresses")

_SF = (f"SELECT s.location_id, s.monthly_revenue, c.competitor_count_1500m, n.d AS nearest_competitor_m, pp.population_1500m, pc.poi_count_1500m "
       f"FROM stores s JOIN ({_count_in('comp_xy', 'competitor_count_1500m')}) c ON c.location_id = s.location_id "
       f"LEFT JOIN ({_nearest('stores_xy', 'location_id', 'comp_xy', 'comp_id')}) n ON n.location_id = s.location_id "
       f"JOIN ({_count_in('addr_xy', 'population_1500m', 'sum(p.total)')}) pp ON pp.location_id = s.location_id "
       f"JOIN ({_count_in('poi_xy', 'poi_count_1500m')}) pc ON pc.location_id = s.location_id")
_FEATS = ["competitor_count_1500m", "nearest_competitor_m", "population_1500m", "poi_count_1500m"]
O["corr_with_target"] = sql(
    "WITH f AS (" + _SF + ") " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), monthly_revenue), 6) AS r FROM f" for c in _FEATS),
    "stores", "stores_xy", "comp_xy", "addr_xy", "poi_xy")
_cm = _FEATS + ["monthly_revenue"]
O["corr_matrix"] = sql(
    "WITH f AS (" + _SF + ") " + " UNION ALL ".join(
        f"SELECT '{a}' AS \"row\", '{b}' AS col, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM f"
        for i, a in enumerate(_cm) for b in _cm[: i + 1]),
    "stores", "stores_xy", "comp_xy", "addr_xy", "poi_xy")
O["district_summary"] = sql(
    f"SELECT d.district_id, d.name, CAST(coalesce(a.n, 0) AS BIGINT) AS stores, CAST(coalesce(b.n, 0) AS BIGINT) AS competitors, "
    f"CAST(coalesce(c.n, 0) AS BIGINT) AS poi FROM districts d "
    f"LEFT JOIN (SELECT poly, count(*) AS n FROM ({_pip('stores', 'location_id', 'dedges')}) GROUP BY poly) a ON a.poly = d.district_id "
    f"LEFT JOIN (SELECT poly, count(*) AS n FROM ({_pip('competitors', 'comp_id', 'dedges')}) GROUP BY poly) b ON b.poly = d.district_id "
    f"LEFT JOIN (SELECT poly, count(*) AS n FROM ({_pip('poi', 'poi_id', 'dedges')}) GROUP BY poly) c ON c.poly = d.district_id "
    f"UNION ALL SELECT NULL, 'None', "
    f"(SELECT count(*) FROM stores WHERE location_id NOT IN (SELECT pid FROM ({_pip('stores', 'location_id', 'dedges')}))), "
    f"(SELECT count(*) FROM competitors WHERE comp_id NOT IN (SELECT pid FROM ({_pip('competitors', 'comp_id', 'dedges')}))), "
    f"(SELECT count(*) FROM poi WHERE poi_id NOT IN (SELECT pid FROM ({_pip('poi', 'poi_id', 'dedges')})))",
    "districts", "stores", "competitors", "poi", "dedges")
# Strips between all ends and crossings of edges; from bottom to top every second edge of a polygon closes it.
O["coverage"] = sql(
    "WITH r AS (SELECT 0 AS layer, id, ax, ay, bx, by_ FROM dedges UNION ALL SELECT 1, id, ax, ay, bx, by_ FROM aedges), "
    "e AS MATERIALIZED (SELECT row_number() OVER () AS n, layer, id, least(ax, bx) AS x1, CASE WHEN ax < bx THEN ay ELSE by_ END AS y1, greatest(ax, bx) AS x2, "
    "CASE WHEN ax < bx THEN by_ ELSE ay END AS y2, (by_ - ay) / (bx - ax) AS m FROM r WHERE ax <> bx), "
    "cr AS (SELECT ((f.y1 - f.m * f.x1) - (g.y1 - g.m * g.x1)) / (g.m - f.m) AS x, greatest(f.x1, g.x1) AS lo, least(f.x2, g.x2) AS hi FROM e f JOIN e g ON f.n < g.n AND f.m <> g.m "
    "AND f.x1 < g.x2 AND g.x1 < f.x2), "
    "xs AS (SELECT x1 AS x FROM e UNION SELECT x2 FROM e UNION SELECT x FROM cr WHERE x > lo AND x < hi), "
    "st AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS b FROM xs), "
    "se AS (SELECT a, b, layer, id, y1 + ((a + b) / 2 - x1) * m AS y FROM st JOIN e ON x1 <= a AND x2 >= b WHERE b > a), "
    "t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY a, layer, id ORDER BY y) % 2 = 1 THEN 1 ELSE -1 END AS turn FROM se), "
    "d AS (SELECT b - a AS w, lead(y) OVER o - y AS gap, sum(CASE WHEN layer = 0 THEN turn ELSE 0 END) OVER (PARTITION BY a ORDER BY y, layer, id ROWS UNBOUNDED PRECEDING) AS d0, "
    "sum(CASE WHEN layer = 1 THEN turn ELSE 0 END) OVER (PARTITION BY a ORDER BY y, layer, id ROWS UNBOUNDED PRECEDING) AS d1 FROM t WINDOW o AS (PARTITION BY a ORDER BY y, layer, id)), "
    "s AS (SELECT coalesce(sum(w * gap) FILTER (WHERE d0 > 0), 0) AS u, coalesce(sum(w * gap) FILTER (WHERE d0 > 0 AND d1 <= 0), 0) AS o FROM d) "
    "SELECT round(u, 9) AS union_area, round(o, 9) AS outside_area, round(o / u, 9) AS outside_share FROM s", "dedges", "aedges")
O["compare_groups"] = sql(
    "WITH f AS (" + _SF + "), t AS (SELECT * FROM f ORDER BY monthly_revenue DESC, location_id LIMIT 3), "
    "o AS (SELECT * FROM f WHERE location_id NOT IN (SELECT location_id FROM t)) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round((SELECT avg({c}) FROM t), 3) AS top3, round((SELECT avg({c}) FROM o), 3) AS others" for c in _FEATS),
    "stores", "stores_xy", "comp_xy", "addr_xy", "poi_xy")
O["top_k"] = sql("SELECT location_id, round(monthly_revenue, 6) AS monthly_revenue FROM stores ORDER BY monthly_revenue DESC, location_id LIMIT 10", "stores")
O["top_bottom"] = sql(
    "(SELECT location_id, round(monthly_revenue, 6) AS monthly_revenue, 'top' AS \"end\" FROM stores ORDER BY monthly_revenue DESC, location_id LIMIT 5) "
    "UNION ALL (SELECT location_id, round(monthly_revenue, 6), 'bottom' FROM stores ORDER BY monthly_revenue ASC, location_id LIMIT 5)", "stores")
O["union_all"] = sql("SELECT location_id AS id, 'store' AS kind FROM stores UNION ALL SELECT comp_id, 'competitor' FROM competitors",
                     "stores", "competitors")
O["baseline"] = sql("SELECT CAST(0.0 AS DOUBLE) AS r2, round(stddev_pop(monthly_revenue), 3) AS rmse, round(avg(monthly_revenue), 3) AS mean FROM stores", "stores")
O["regression_metrics"] = sql(
    "WITH s AS (SELECT st.*, su.s_nationkey FROM stores st JOIN supplier su ON su.s_suppkey = st.location_id), "
    "m AS (SELECT s_nationkey, avg(monthly_revenue) AS p FROM s GROUP BY 1), j AS (SELECT s.monthly_revenue AS y, m.p FROM s JOIN m USING (s_nationkey)) "
    "SELECT round(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse, count(*) AS n FROM j",
    "stores")


# ------------------------------------------------------------------ G: hex grid and whitespot


def _inverse(x: str, y: str) -> tuple[str, str]:
    xi = f"(({y}) - ({_g.CS92_FALSE_NORTHING!r})) / {_g._KA!r}"
    eta = f"(({x}) - {_g.CS92_FALSE_EASTING!r}) / {_g._KA!r}"
    xp, ep = f"({xi})", f"({eta})"
    for j, b in enumerate(_g._BETA, start=1):
        xp = f"({xp} - {b!r} * sin({2.0 * j!r} * {xi}) * cosh({2.0 * j!r} * {eta}))"
        ep = f"({ep} - {b!r} * cos({2.0 * j!r} * {xi}) * sinh({2.0 * j!r} * {eta}))"
    return xp, ep


def _hex_cells(w: float = 5000.0) -> str:
    import math
    h = w * math.sqrt(3.0) / 2.0
    xp, ep = _inverse("x", "y")
    chi = "asin(sin(xp) / cosh(ep))"
    phi = chi
    for j, d in enumerate(_g._DELTA, start=1):
        phi = f"({phi} + {d!r} * sin({2.0 * j!r} * {chi}))"
    return (
        f"WITH bnd AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM dverts_xy GROUP BY id), "
        f"rr AS (SELECT id, x0, x1, unnest(generate_series(CAST(floor(y0 / {h!r}) AS BIGINT), CAST(ceil(y1 / {h!r}) AS BIGINT))) AS r FROM bnd), "
        f"qq AS (SELECT id, r, unnest(generate_series(CAST(floor(x0 / {w!r} - r / 2.0) AS BIGINT), CAST(ceil(x1 / {w!r} - r / 2.0) AS BIGINT))) AS q FROM rr), "
        f"c0 AS (SELECT id, q, r, (q + r / 2.0) * {w!r} AS x, r * {h!r} AS y FROM qq), "
        f"c1 AS (SELECT id, q, r, {xp} AS xp, {ep} AS ep FROM c0), "
        f"c2 AS (SELECT id, q, r, {_g.CS92_LON0_DEG!r} + degrees(atan2(sinh(ep), cos(xp))) AS lng, degrees({phi}) AS lat FROM c1), "
        f"cin AS (SELECT c.q, c.r, any_value(c.lng) AS lng, any_value(c.lat) AS lat FROM c2 c JOIN dedges e ON e.id = c.id "
        f"GROUP BY c.id, c.q, c.r HAVING sum(CASE WHEN (e.ay > c.lat) != (e.by_ > c.lat) AND c.lng < (e.bx - e.ax) * (c.lat - e.ay) / (e.by_ - e.ay) + e.ax "
        f"THEN 1 ELSE 0 END) % 2 = 1) "
        f"SELECT DISTINCT CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell_id, q, r, lng, lat FROM cin"
    )


O["hex_grid"] = sql(f"SELECT cell_id, q, r, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({_hex_cells()})", "dverts_xy", "dedges")
_cx, _cy = _xy("lng", "lat")
_CELLS = f"SELECT cell_id, lng, lat, {_cx} AS x, {_cy} AS y FROM ({_hex_cells()})"
_G = (
    f"WITH cells AS ({_CELLS}), " + _matrix("cells", "cell_id") + ", "
    f"sn AS (SELECT s.cell_id, round(min(sqrt({D2})), 3) AS nearest_store_m FROM cells s, stores_xy p GROUP BY s.cell_id), "
    "fl AS (SELECT cells_f.*, nearest_store_m, coalesce(nearest_store_m >= 3000.0, true) AS far_from_own, "
    "coalesce(nearest_store_m >= 3000.0, true) AND competitor_count_1500m <= 0 AS whitespot FROM cells_f LEFT JOIN sn USING (cell_id)) "
)
# Ridge on all features: the normal equations in scaled features, solved by Gauss-Jordan elimination, one CTE a column.
_FEATURES = [
    "competitor_count_1500m", "nearest_competitor_m", "poi_count_1500m", "nearest_poi_m",
    *[c for k in _CATS for c in (f"poi_{k}_count_1500m", f"nearest_poi_{k}_m")],
    "building_count_1500m", "residential_ratio_1500m", "population_1500m", "signals_1500m", "unique_users_1500m"]


def _ridge(alpha: float = 10.0) -> str:
    """CTEs up to ``coef`` (j, mean, sd, w) and ``my`` from the store matrix; features without spread get no weight."""
    def unpivot(table: str, key: str) -> str:
        return " UNION ALL ".join(f"SELECT {key}, {j} AS j, CAST({c} AS DOUBLE) AS x FROM {table}" for j, c in enumerate(_FEATURES))

    k = len(_FEATURES)
    out = [
        _matrix("stores_xy", "location_id"),
        f"sl AS MATERIALIZED ({unpivot('stores_xy_f', 'location_id')})",
        "fs AS MATERIALIZED (SELECT j, avg(x) AS mean, stddev_pop(x) AS sd FROM sl GROUP BY j)",
        "sz AS MATERIALIZED (SELECT location_id, j, coalesce((x - mean) / nullif(sd0, 0), 0) AS z FROM sl JOIN "
        "(SELECT j, mean, (SELECT stddev_pop(coalesce(x, fs.mean)) FROM sl WHERE sl.j = fs.j) AS sd0 FROM fs) USING (j))",
        "ys AS (SELECT location_id, monthly_revenue AS y, avg(monthly_revenue) OVER () AS my FROM stores)",
        f"e0 AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.z * b.z) + CASE WHEN a.j = b.j THEN {alpha} ELSE 0 END AS v FROM sz a JOIN sz b USING (location_id) GROUP BY 1, 2 "
        f"UNION ALL SELECT sz.j, {k}, sum(z * (y - my)) FROM sz JOIN ys USING (location_id) GROUP BY 1)",
    ]
    for s in range(k):
        out.append(
            f"e{s + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = {s} THEN m.v / p.v ELSE m.v - l.v * r.v / p.v END AS v FROM e{s} m "
            f"CROSS JOIN (SELECT v FROM e{s} WHERE i = {s} AND j = {s}) p JOIN (SELECT i, v FROM e{s} WHERE j = {s}) l ON l.i = m.i "
            f"JOIN (SELECT j, v FROM e{s} WHERE i = {s}) r ON r.j = m.j)")
    out.append(
        f"coef AS (SELECT e.i AS j, fs.mean, (SELECT stddev_pop(coalesce(x, fs.mean)) FROM sl WHERE sl.j = fs.j) AS sd, e.v AS w FROM e{k} e JOIN fs ON fs.j = e.i WHERE e.j = {k})")
    out.append(f"cl AS (SELECT cell_id, j, x FROM ({unpivot('fl', 'cell_id')}))")
    out.append("cp AS (SELECT cell_id, (SELECT any_value(my) FROM ys) + sum(coalesce((x - mean) / nullif(sd, 0), 0) * w) AS prediction FROM cl JOIN coef USING (j) GROUP BY cell_id)")
    return ", ".join(out)


_S = (
    _G + ", " + _ridge() + ", "
    "sc0 AS (SELECT fl.*, prediction FROM fl JOIN cp USING (cell_id) WHERE whitespot), "
    "mm AS (SELECT min(prediction) AS lo, max(prediction) AS hi FROM sc0), "
    "sc AS (SELECT sc0.* EXCLUDE (far_from_own, whitespot, prediction), round(prediction, 1) AS prediction, "
    "round_even((prediction - lo) * 100.0 / nullif(hi - lo, 0), 1) AS score FROM sc0, mm) "
)
_GDEPS = ("dverts_xy", "dedges", *_MDEPS)
O["site_features"] = sql(_G + "SELECT * FROM cells_f", *_GDEPS)
O["whitespot_filter"] = sql(_G + "SELECT count(*) AS cells, count(*) FILTER (WHERE far_from_own) AS after_own_filter, "
                            "count(*) FILTER (WHERE whitespot) AS after_both FROM fl", *_GDEPS)
O["score"] = sql(_S + "SELECT cell_id, prediction, score FROM sc", *_GDEPS)
O["rank_candidates"] = sql(_S + "SELECT * FROM sc ORDER BY score DESC, cell_id LIMIT 10", *_GDEPS)

# ------------------------------------------------------------------ further pieces of D, B and C
O["histogram_edges"] = sql(
    "WITH e AS (SELECT * FROM (VALUES (0, 1.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 20.0), (3, 20.0, 40.0)) t(b, lo, hi)) "
    "SELECT CAST(b AS INTEGER) AS bin, CAST(lo AS DOUBLE) AS lower, CAST(hi AS DOUBLE) AS upper, "
    "(SELECT count(*) FROM addresses WHERE total >= lo AND (total < hi OR (b = 3 AND total = hi))) AS count FROM e", "addresses")
O["corr_strong"] = (
    "WITH r AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, corr(CAST({c} AS DOUBLE), CAST(l_extendedprice AS DOUBLE) * (1 - l_discount)) AS r FROM lineitem"
        for n, c in (("l_extendedprice", "l_extendedprice"), ("rebate", "l_extendedprice * l_discount"), ("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax")))
    + ") SELECT feature, round(r, 6) AS r FROM r WHERE abs(r) > 0.3")
O["wkt_multiring"] = sql(
    "SELECT district_id, CAST(3 AS INTEGER) AS rings, CAST(97.0 AS DOUBLE) AS area, CAST(district_id * 100 AS DOUBLE) AS min_lng, CAST(0 AS DOUBLE) AS min_lat, "
    "CAST(district_id * 100 + 32 AS DOUBLE) AS max_lng, CAST(21 AS DOUBLE) AS max_lat, true AS in_outer, false AS in_hole, true AS in_second, false AS between FROM districts", "districts")
O["polygon_slice"] = sql(
    f"SELECT id AS lokalnyid FROM bverts GROUP BY id HAVING min(lng) <= {SUB['lng_max']} AND max(lng) >= {SUB['lng_min']} "
    f"AND min(lat) <= {SUB['lat_max']} AND max(lat) >= {SUB['lat_min']}", "bverts")
O["store_building"] = sql(
    f"SELECT location_id, round(area, 3) AS store_building_area, CAST(kind = '{fx.RETAIL_CATEGORY}' AS INTEGER) AS is_retail_building FROM ("
    f"SELECT pd.location_id, b.area, b.funogolnabudynku_desc AS kind, row_number() OVER (PARTITION BY pd.location_id ORDER BY pd.d, pd.id) AS rn "
    f"FROM ({_poly_dist('stores_xy', 'location_id', 'bedges_xy')}) pd JOIN buildings b ON b.lokalnyid = pd.id) WHERE rn = 1",
    "stores_xy", "bedges_xy", "buildings")
# Inside the 64-gon: the offset's projection on the nearest edge normal is below the apothem.
_ANG = "atan2(p.y - s.y, p.x - s.x)"
_STEP = "(2 * pi() / 64)"
O["radius_join_polygon64"] = sql(
    f"SELECT s.location_id, p.poi_id FROM stores_xy s, poi_xy p WHERE {D2} < {R * R!r} AND "
    f"sqrt({D2}) * cos({_ANG} - {_STEP} * floor({_ANG} / {_STEP}) - {_STEP} / 2) < {R!r} * cos({_STEP} / 2)", "stores_xy", "poi_xy")

# ------------------------------------------------------------------ H: what must hold of the models
_NF = 2 + 2 + 2 * len(_CATS) + 2 + 1 + 2
O["list_objects"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", true AS has_bytes" for t in (*fx.TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))
O["repeated_kfold"] = sql("SELECT CAST(i AS INTEGER) AS repeat, count(*) AS rows, count(DISTINCT location_id) AS ids, CAST(5 AS BIGINT) AS folds, true AS equal FROM stores, range(10) r(i) GROUP BY i", "stores")
O["ridge_fit"] = "SELECT CAST(a AS DOUBLE) AS alpha, true AS closed_form FROM (VALUES (0.01), (0.1), (1.0), (10.0), (100.0)) t(a)"
O["lasso_fit"] = "SELECT CAST(a AS DOUBLE) AS alpha, true AS optimal FROM (VALUES (0.001), (0.01), (0.1), (1.0), (10.0)) t(a)"
O["feature_importance"] = f"SELECT CAST({_NF} AS BIGINT) AS features, CAST(1.0 AS DOUBLE) AS total, true AS not_negative"
O["predict"] = sql("SELECT count(*) AS rows, count(DISTINCT location_id) AS ids, CAST(0 AS BIGINT) AS missing, true AS no_worse_than_mean FROM stores", "stores")
O["model_roundtrip"] = sql("SELECT count(*) AS rows, CAST(0.0 AS DOUBLE) AS max_difference FROM stores", "stores")
O["attributions"] = sql(f"SELECT location_id, CAST({_NF} AS BIGINT) AS features, true AS adds_up, true AS sorted FROM stores", "stores")
O["gbt_cv"] = sql("SELECT CAST(i AS INTEGER) AS repeat, CAST(5 AS BIGINT) AS fits, count(*) AS rows, CAST(5 AS BIGINT) AS scored, true AS in_band FROM stores, range(10) r(i) GROUP BY i", "stores")
O["gbt_grid"] = "SELECT CAST(648 AS BIGINT) AS settings, CAST(32400 AS BIGINT) AS fits, CAST(0 AS BIGINT) AS unscored, CAST(648 AS BIGINT) AS distinct_settings, true AS in_band"


def _boosted_sql(features, label, table, trees, depth, rate, alpha, lam, held=None):
    """Boosted trees by aggregates over distinct values: each level joins its best cuts back to the rows.

    Gives the splits and leaves, or with ``held`` (a condition) the mean
    predictions of those rows by the first feature, the others being trained on.
    """
    def soft(g):
        return f"sign({g}) * greatest(abs({g}) - {alpha}, 0)"

    def score(g, h):
        return f"pow(greatest(abs({g}) - {alpha}, 0), 2) / ({h} + {lam})"

    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(features))
    names = ", ".join(f"x{i}" for i in range(len(features)))
    out = [f"m0 AS (SELECT {xs}, CAST({label} AS DOUBLE) AS y, avg(CAST({label} AS DOUBLE)) OVER () AS m FROM {table}{f' WHERE NOT ({held})' if held else ''})"]
    if held:
        out.append(f"h0 AS (SELECT {xs}, (SELECT any_value(m) FROM m0) AS m FROM {table} WHERE {held})")
    parts = []
    for t in range(trees):
        out.append(f"r{t}_0 AS (SELECT {names}, y, m, m - y AS g, 0 AS node FROM m{t})")
        if held:
            out.append(f"p{t}_0 AS (SELECT {names}, m, 0 AS node FROM h{t})")
        for d in range(depth):
            long = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, g FROM r{t}_{d}" for i in range(len(features)))
            out.append(f"c{t}_{d} AS (SELECT node, f, v, sum(g) AS g, count(*) AS h FROM ({long}) GROUP BY ALL)")
            out.append(f"w{t}_{d} AS (SELECT node, f, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER p AS gt, sum(h) OVER p AS ht FROM c{t}_{d} "
                       "WINDOW o AS (PARTITION BY node, f ORDER BY v), p AS (PARTITION BY node, f))")
            out.append(f"s{t}_{d} AS (SELECT node, f, v, {score('gl', 'hl')} + {score('(gt - gl)', '(ht - hl)')} - {score('gt', 'ht')} AS gain FROM w{t}_{d} WHERE ht > hl)")
            out.append(f"b{t}_{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS rn FROM s{t}_{d}) WHERE rn = 1 AND gain > 1e-6)")
            value = "CASE b.f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(features))) + " END"
            out.append(f"r{t}_{d + 1} AS (SELECT {names}, y, m, r.g, 2 * r.node + coalesce(CAST({value} > b.v AS INTEGER), 0) AS node FROM r{t}_{d} r LEFT JOIN b{t}_{d} b ON b.node = r.node)")
            if held:
                out.append(f"p{t}_{d + 1} AS (SELECT {names}, m, 2 * r.node + coalesce(CAST({value} > b.v AS INTEGER), 0) AS node FROM p{t}_{d} r LEFT JOIN b{t}_{d} b ON b.node = r.node)")
            name = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features)) + " END"
            parts.append(f"SELECT {t} AS tree, {d} AS level, CAST(node AS INTEGER) AS node, {name} AS feature, round(v, 4) AS cut, "
                         f"round(gain / (SELECT var_pop(y) * count(*) FROM m0), 6) AS value FROM b{t}_{d}")
        out.append(f"l{t} AS (SELECT node, -({soft('sum(g)')}) / (count(*) + {lam}) * {rate} AS step FROM r{t}_{depth} GROUP BY node)")
        out.append(f"m{t + 1} AS (SELECT {names}, y, m + step AS m FROM r{t}_{depth} JOIN l{t} USING (node))")
        if held:
            out.append(f"h{t + 1} AS (SELECT {names}, m + coalesce(step, 0) AS m FROM p{t}_{depth} LEFT JOIN l{t} USING (node))")
        parts.append(f"SELECT {t}, {depth}, CAST(node AS INTEGER), NULL, NULL, round(step, 2) FROM l{t} WHERE step <> 0")
    if held:
        return "WITH " + ", ".join(out) + f" SELECT x0 AS quantity, count(*) AS n, round(avg(m), 2) AS prediction FROM h{trees} GROUP BY x0"
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(parts)


O["boosted_splits"] = _boosted_sql(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lineitem", 2, 2, 0.5, 1000.0, 2.0)
O["predict_holdout"] = _boosted_sql(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lineitem", 2, 2, 0.5, 1000.0, 2.0, held="l_linenumber = 1")
O["model_log"] = (
    "SELECT CAST(i AS INTEGER) AS attempt, m AS model, f AS features, c AS cv, t AS target, u AS rmse_unit, CAST(n AS BIGINT) AS folds, true AS has_r2, true AS has_rmse FROM (VALUES "
    "(0, 'baseline', 'full', NULL, 'raw', 'PLN', 0), " + ", ".join(
        f"({i}, '{m}', '{f}', 'RepeatedKFold-5x10', '{t}', '{u}', 50)" for i, m, f, t, u in (
            (1, "gbt_regularised", "full", "raw", "PLN"), (2, "gbt_tuned", "full", "raw", "PLN"), (3, "gbt_regularised", "correlated", "raw", "PLN"),
            (4, "ridge", "full", "log", "log(PLN)"), (5, "lasso", "full", "log", "log(PLN)"), (7, "gbt_regularised", "with building", "raw", "PLN"),
            (8, "gbt_regularised", "with signals per user", "raw", "PLN"))) + ") v(i, m, f, c, t, u, n)")
