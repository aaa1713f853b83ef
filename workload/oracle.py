"""The SQL each query is checked against."""

from __future__ import annotations

from workload import tables as views

# Written out here from the published analysis, so that the check does not rest on the code it checks.
ROOM_TITLES = (
    " (ROOM RENT|ROOMMATE|ROOMIE) | ONE (BED)?ROOM IN (TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE"
    "|HOUSE|CONDO|APARTMENT) | (BED)?ROOM AVAILABLE IN (TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE"
    "|HOUSE|CONDO|APARTMENT) "
)

# Group keys of the tables, then whether there is a mean and which units they come from.
PERIOD_KEYS = {
    "full": "numRooms",
    "muni": "muni numRooms",
    "nhood": "neighborhood_01 muni numRooms",
    "ct": "ct10_id muni numRooms",
    "zip": "zip_code muni numRooms",
    "full_age": "source_id numRooms periodblt",
    "muni_age": "source_id muni numRooms periodblt",
    "nhood_age": "source_id neighborhood_01 muni numRooms periodblt",
    "ct_age": "source_id ct10_id numRooms periodblt",
    "zip_age": "source_id zip_code numRooms periodblt",
}
ANNUAL_KEYS = {
    "annual_full": "numRooms year",
    "annual_muni": "muni numRooms year",
    "annual_ct": "ct10_id numRooms year",
    "annual_nhood": "neighborhood_01 muni numRooms year",
    "annual_zip": "zip_code muni numRooms year",
    "annual_full_age": "source_id numRooms year periodblt",
    "annual_muni_age": "source_id muni ct10_id numRooms year periodblt",
    "annual_nhood_age": "source_id neighborhood_01 muni numRooms year periodblt",
    "annual_zip_age": "source_id zip_code muni numRooms year periodblt",
}
QUARTERLY_KEYS = {f"quarterly_{name}": f"{keys} quarter" for name, keys in PERIOD_KEYS.items()}


def _columns(exprs: dict[str, str], names: list[str] | None = None) -> str:
    return ", ".join(f"{exprs[n]} AS {n}" for n in names or exprs)


WITH = {
    "listings": f"SELECT {_columns(views.LISTING_COLUMNS)}"
    " FROM lineitem JOIN part ON l_partkey = p_partkey",
    "starts": f"SELECT {_columns(views.STARTS_COLUMNS)} FROM orders",
    "completions": f"SELECT {_columns(views.COMPLETIONS_COLUMNS)} FROM orders",
    "done": "SELECT parloc_id, cast(extract(year from try_strptime(complete_date, '%m/%d/%Y'))"
    " AS int) AS bos_yr_built FROM completions",
    "parcels": f"SELECT {_columns(views.PARCEL_COLUMNS)} FROM supplier",
    "zips": f"SELECT {_columns(views.ZIP_COLUMNS)} FROM supplier",
    "flagged": "SELECT *, date_diff('day', post_date, updated_date) AS lag_days,"
    f" coalesce(regexp_matches(title, '{ROOM_TITLES}'), false) AS roomrent,"
    " coalesce(contains(title, ' SUBLET '), false) AS sublet,"
    " coalesce(contains(title, ' SHORT TERM '), false) AS shortterm,"
    " coalesce(contains(title, ' SHARED ') OR contains(title, ' SHARE '), false) AS shared"
    " FROM listings",
    "units": "SELECT *, cast(lag_days AS int) AS update_lag, CASE WHEN yr_built IS NULL"
    " OR yr_built = 0 THEN 'd_NA' WHEN yr_built >= 2011 THEN 'b_2011 or later'"
    " ELSE 'a_Before 2011' END AS periodblt, concat(year, ' Q', cast(ceil(month/3.0) AS int))"
    " AS quarter FROM flagged WHERE NOT roomrent AND NOT sublet AND NOT shortterm"
    " AND NOT shared AND lag_days <= 30",
    "clean": "SELECT * REPLACE (CASE WHEN muni = 'ARLINGTON' THEN cast(ct10_id AS varchar)"
    " WHEN muni IS NOT NULL THEN neighborhood_01 END AS neighborhood_01) FROM units"
    " WHERE NOT (zip_code = '02108' AND (BASE_merge = 'Acorn' OR BASE_merge = 'Willow')"
    " AND ask < 700) AND numRooms <> -1",
    "latest": "SELECT parloc_id, camb_yr_built, ord FROM (SELECT *,"
    " max(camb_yr_built) OVER (PARTITION BY parloc_id) AS my,"
    " max(ord) OVER (PARTITION BY parloc_id) AS mo FROM starts)"
    " WHERE camb_yr_built = my AND ord = mo",
}

NEEDS = {
    "done": ["completions"],
    "flagged": ["listings"],
    "units": ["flagged"],
    "clean": ["units"],
    "latest": ["starts"],
}


def _with(body: str, *names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{n} AS ({WITH[n]})" for n in order)
    return f"WITH {parts} {body}"


IN_PARCEL = (
    "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (poly_idx%3 <> 0"
    " OR (x-x0)*(y1-y0) + (y-y0)*(x1-x0) <= (x1-x0)*(y1-y0))"
)
IN_ZIP = (
    "x BETWEEN x0 AND x0+200 AND y BETWEEN y0 AND y0+100"
    " AND NOT (x > x0+50 AND x < x0+100 AND y > y0+25 AND y < y0+50)"
)


def _last_match(name: str, points: str, layer: str, inside: str, attrs: str) -> str:
    """CTE ``name(x, y, poly_idx, attrs)``: the last polygon of each covered point."""
    return (
        f"{name} AS (SELECT m.x, m.y, p.poly_idx, {attrs} FROM (SELECT x, y, max(poly_idx) AS"
        f" last_idx FROM (SELECT DISTINCT x, y FROM {points}) JOIN {layer} ON {inside}"
        f" GROUP BY x, y) m JOIN {layer} p ON p.poly_idx = m.last_idx)"
    )


def _stats(source: str, keys: tuple[str, ...], mean: bool = True, where: str = "") -> str:
    names = ", ".join(keys)
    whole = "count(ask) = count(*)"
    meanrent = f"CASE WHEN {whole} THEN round_even(avg(cast(ask AS double)), 0) END AS meanrent"
    medrent = f"CASE WHEN {whole} THEN round_even(median(cast(ask AS double)), 0) END AS medrent"
    return (
        f"SELECT {names}, count(*) AS rentcount, {meanrent + ', ' if mean else ''}{medrent}"
        f" FROM {source} {where} GROUP BY {names}"
    )


def _table(keys: str, mean: bool = True, source: str = "clean", where: str = "") -> str:
    return _with(_stats(source, tuple(keys.split()), mean, where), source)


TYPES = {
    "year": "int", "month": "int", "source_id": "int", "numRooms": "int", "ct10_id": "bigint",
}


def _one_pass(products: dict[str, str]) -> str:
    dims = list(dict.fromkeys(k for keys in products.values() for k in keys.split()))

    def one(name: str, keys: tuple[str, ...]) -> str:
        cells = ", ".join(
            d if d in keys else f"cast(NULL AS {TYPES.get(d, 'varchar')}) AS {d}" for d in dims
        )
        body = _stats("clean", keys)
        return f"SELECT '{name}' AS product, {cells}, rentcount, meanrent, medrent FROM ({body})"

    parts = [one(name, tuple(keys.split())) for name, keys in products.items()]
    return _with(" UNION ALL ".join(parts), "clean")


# The projection from its published parameters, step by step.
CONE_STEPS = (
    "ell AS (SELECT 6378137.0::double AS a, sqrt(f * (2 - f)) AS e FROM (SELECT"
    " 1 / 298.257222101::double AS f)),"
    " par AS (SELECT a, e, radians(41.0::double) AS p0, radians(41.71666666666667::double) AS p1,"
    " radians(42.68333333333333::double) AS p2 FROM ell),"
    " mt AS (SELECT a, e, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1,"
    " cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,"
    " tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0,"
    " tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1,"
    " tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2 FROM par),"
    " pw AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM mt),"
    " cone AS (SELECT e, n, a * m1 / (n * pow(t1, n)) AS s, a * m1 / (n * pow(t1, n)) * pow(t0, n)"
    " AS r0 FROM pw)"
)


def _project(more: str = "") -> str:
    """Forward projection written out from the published closed form."""
    lat, lon = "radians(latitude)", "radians(longitude + 71.5)"
    t = f"(tan(pi() / 4 - {lat} / 2) / pow((1 - e * sin({lat})) / (1 + e * sin({lat})), e / 2))"
    rho = f"(s * pow({t}, n))"
    head = _with("", "listings").rstrip()
    return (
        f"{head}, {CONE_STEPS} SELECT id, round(200000 + {rho} * sin(n * {lon}), 2) AS x,"
        f" round(750000 + r0 - {rho} * cos(n * {lon}), 2) AS y{more} FROM listings, cone"
    )


def _override(parity: bool) -> str:
    def one(axis: str) -> str:
        merged = f"coalesce({axis}_merge, 0)"
        test = f"{merged} < 0" if parity else f"{merged} <> 0"
        return (
            f"CASE WHEN {test} AND source_id = 2 THEN {merged} WHEN {test} AND source_id IS NULL"
            f" THEN NULL ELSE {axis} END AS {axis},"
            f" {axis} AS {axis}_original, cast({merged} AS double) AS {axis}_merge"
        )

    return f"SELECT id, source_id, {one('longitude')}, {one('latitude')} FROM listings"


ROW_LAG = "cast(date_diff('day', post_date, updated_date) AS int) AS update_lag"
BAND = (
    "CASE WHEN yr_built IS NULL OR yr_built = 0 THEN 'd_NA' WHEN yr_built >= 2011"
    " THEN 'b_2011 or later' ELSE 'a_Before 2011' END AS periodblt"
)


def _flag(name: str) -> str:
    return _with(f"SELECT id, title, {name} FROM flagged", "flagged")


def _scams(suspect: str) -> str:
    return _with(
        "SELECT id, ask, zip_code, BASE_merge, numRooms FROM listings"
        f" WHERE NOT ({suspect}) AND numRooms <> -1",
        "listings",
    )


def _pip_one(points: str, layer: str, inside: str, ids: str, attrs: list[str]) -> str:
    picked = ", ".join(f"m.{a}" for a in attrs)
    named = ", ".join(f"p.{a}" for a in attrs if a != "poly_idx")
    head = _with("", points, layer).rstrip()
    found = _last_match("found", points, layer, inside, named)
    return (
        f"{head}, {found} SELECT {ids}, {picked} FROM {points} l"
        " LEFT JOIN found m ON l.x = m.x AND l.y = m.y"
    )


PIP_PARCELS_ONE = _pip_one(
    "listings", "parcels", IN_PARCEL, "l.id, l.x, l.y", ["poly_idx", "parloc_id"]
)
PIP_PARCELS_ALL = _with(
    "SELECT id, l.x, l.y, poly_idx, p.parloc_id FROM listings l LEFT JOIN parcels p"
    f" ON {IN_PARCEL.replace('x ', 'l.x ').replace(' y ', ' l.y ')}",
    "listings", "parcels",
)

PIP_TOWN = _with("", "starts", "parcels").rstrip() + (
    ", town AS (SELECT * FROM parcels WHERE town = 'Cambridge'), "
    + _last_match("found", "starts", "town", IN_PARCEL, "p.parloc_id")
    + " SELECT l.ord, l.camb_yr_built, l.x, l.y, m.parloc_id FROM starts l"
    " LEFT JOIN found m ON l.x = m.x AND l.y = m.y"
)

END_TO_END = (
    _with("", "flagged", "parcels", "zips", "latest", "done").rstrip()
    + ", "
    + _last_match("at_parcel", "listings", "parcels", IN_PARCEL, "p.parloc_id, p.yr_built")
    + ", "
    + _last_match("at_zip", "listings", "zips", IN_ZIP, "p.postcode")
    + ", enriched AS (SELECT f.* EXCLUDE (zip_code, parloc_id, yr_built), z.postcode AS zip_code,"
    " CASE WHEN coalesce(d.bos_yr_built, 0) > 0 THEN d.bos_yr_built"
    " WHEN coalesce(s.camb_yr_built, 0) > 0 THEN s.camb_yr_built"
    " ELSE coalesce(try_cast(p.yr_built AS int), 0) END AS yr_built"
    " FROM flagged f LEFT JOIN at_parcel p ON f.x = p.x AND f.y = p.y"
    " LEFT JOIN at_zip z ON f.x = z.x AND f.y = z.y"
    " LEFT JOIN latest s ON p.parloc_id = s.parloc_id"
    " LEFT JOIN done d ON p.parloc_id = d.parloc_id), "
    f"kept AS (SELECT *, {BAND} FROM enriched WHERE NOT roomrent AND NOT sublet"
    " AND NOT shortterm AND NOT shared AND lag_days <= 30 AND NOT (zip_code = '02108'"
    " AND (BASE_merge = 'Acorn' OR BASE_merge = 'Willow') AND ask < 700) AND numRooms <> -1) "
    + _stats("kept", ("source_id", "muni", "zip_code", "numRooms", "periodblt"))
)

def _rings() -> str:
    """Rings, points and coordinate sums of the parcel texts, from the boxes alone."""
    return _with(
        "SELECT poly_idx, cast(CASE poly_idx%7 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS int) AS"
        " n_rings, cast(CASE poly_idx%7 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 5 END AS int) AS n_points,"
        " cast(CASE poly_idx%7 WHEN 0 THEN 0 ELSE 3*x0 + 2*x1 + CASE poly_idx%7 WHEN 1 THEN 4*x0+2"
        " ELSE 0 END END AS double) AS sum_x, cast(CASE poly_idx%7 WHEN 0 THEN 0 ELSE 3*y0 + 2*y1"
        " + CASE poly_idx%7 WHEN 1 THEN 4*y0+1 ELSE 0 END END AS double) AS sum_y FROM parcels",
        "parcels",
    )


ORACLE: dict[str, str] = {
    "units_filter": _with(
        "SELECT id, ask, numRooms, source_id, muni, update_lag FROM units", "units"
    ),
    "scam_filter_address": _scams(
        "zip_code = '02108' AND (BASE_merge = 'Acorn' OR BASE_merge = 'Willow') AND ask < 700"
    ),
    "scam_filter_zip": _scams("zip_code = '02108' AND ask < 700"),
    "flag_roomrent": _flag("roomrent"),
    "flag_sublet": _flag("sublet"),
    "flag_shortterm": _flag("shortterm"),
    "flag_shared": _flag("shared"),
    "update_lag": _with(
        f"SELECT id, post_date, updated_date, {ROW_LAG} FROM listings", "listings"
    ),
    "quarter_label": _with(
        "SELECT id, year, month, concat(year, ' Q', cast(ceil(month/3.0) AS int)) AS quarter"
        " FROM listings",
        "listings",
    ),
    "coord_override": _with(_override(True), "listings"),
    "coord_override_nonzero": _with(_override(False), "listings"),
    "recode_if_null_safe": _with(
        "SELECT id, rooms8, CASE WHEN rooms8 = 8 THEN cast(eight_bedroom = 1 AS int)"
        " WHEN rooms8 IS NOT NULL THEN 0 END AS eight_bedroom FROM listings",
        "listings",
    ),
    "arlington_nhood": _with(
        "SELECT id, muni, ct10_id, CASE WHEN muni = 'ARLINGTON' THEN cast(ct10_id AS varchar)"
        " WHEN muni IS NOT NULL THEN neighborhood_01 END AS neighborhood_01 FROM listings",
        "listings",
    ),
    "split_location": _with(
        "SELECT ord, try_cast(replace(split_part(location, ',', 1), '(', '') AS double) AS"
        " latitude, try_cast(replace(split_part(location, ',', 2), ')', '') AS double) AS"
        " longitude FROM starts",
        "starts",
    ),
    "completion_year": _with("SELECT * FROM done", "done"),
    "year_built_override": _with(
        f"SELECT id, parloc_id, camb_yr_built, bos_yr_built, yr_built, {BAND} FROM (SELECT id,"
        " l.parloc_id, coalesce(camb_yr_built, 0) AS camb_yr_built, coalesce(bos_yr_built, 0) AS"
        " bos_yr_built, CASE WHEN bos_yr_built > 0 THEN bos_yr_built WHEN camb_yr_built > 0 THEN"
        " camb_yr_built ELSE coalesce(yr_built, 0) END AS yr_built FROM listings l"
        " LEFT JOIN latest s ON l.parloc_id = s.parloc_id"
        " LEFT JOIN done d ON l.parloc_id = d.parloc_id)",
        "listings", "latest", "done",
    ),
    "age_band": _with(f"SELECT id, yr_built, {BAND} FROM listings", "listings"),
    "latest_per_parcel": _with("SELECT * FROM latest", "latest"),
    "latest_per_parcel_lexicographic": _with(
        "SELECT parloc_id, camb_yr_built, ord FROM (SELECT *, row_number() OVER (PARTITION BY"
        " parloc_id ORDER BY camb_yr_built DESC, ord DESC) AS rn FROM starts) WHERE rn = 1",
        "starts",
    ),
    "max_year_per_parcel": _with(
        "SELECT parloc_id, CASE WHEN count(bos_yr_built) = count(*) THEN max(bos_yr_built) END"
        " AS bos_yr_built FROM done GROUP BY parloc_id",
        "done",
    ),
    "join_starts": _with(
        "SELECT id, l.parloc_id, yr_built, coalesce(camb_yr_built, 0) AS camb_yr_built"
        " FROM listings l LEFT JOIN latest s ON l.parloc_id = s.parloc_id",
        "listings", "latest",
    ),
    "join_completions_fanout": _with(
        "SELECT id, l.parloc_id, yr_built, coalesce(bos_yr_built, 0) AS bos_yr_built"
        " FROM listings l LEFT JOIN done d ON l.parloc_id = d.parloc_id",
        "listings", "done",
    ),
    "join_completions_latest": _with(
        "SELECT id, l.parloc_id, yr_built, coalesce(bos_yr_built, 0) AS bos_yr_built"
        " FROM listings l LEFT JOIN (SELECT parloc_id, max(bos_yr_built) AS bos_yr_built"
        " FROM done GROUP BY parloc_id) d ON l.parloc_id = d.parloc_id",
        "listings", "done",
    ),
    "completions_fanout_report": _with(
        "SELECT parloc_id, count(*) AS completions FROM done WHERE parloc_id IS NOT NULL"
        " GROUP BY parloc_id HAVING count(*) > 1",
        "done",
    ),
    "union_quarters": _with(
        "SELECT id, month, CASE WHEN ceil(month/3.0) <> 3 THEN zip_code END AS zip_code,"
        " CASE WHEN ceil(month/3.0) <> 1 THEN BASE_merge END AS BASE_merge FROM listings",
        "listings",
    ),
    "union_keep_left": _with(
        "SELECT parloc_id, complete_date FROM completions UNION ALL"
        " SELECT parloc_id, NULL FROM starts",
        "completions", "starts",
    ),
    "project_to_state_plane": _project(),
    "unit_points": _project(", cast(26986 AS int) AS srid"),
    "project_and_back": _with(
        "SELECT id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude"
        " FROM listings",
        "listings",
    ),
    "pip_parcels_one": PIP_PARCELS_ONE,
    "pip_parcels_one_shuffled": PIP_PARCELS_ONE,
    "pip_parcels_all": PIP_PARCELS_ALL,
    "pip_parcels_all_shuffled": PIP_PARCELS_ALL,
    "pip_zip": _pip_one(
        "listings", "zips", IN_ZIP, "l.id, l.x, l.y", ["poly_idx", "postcode", "pc_name"]
    ),
    "pip_town_subset": PIP_TOWN,
    "counts": _table("year month source_id", mean=False),
    "annual_counts": _table("year month source_id", mean=False, source="units"),
    "annual_fwd": _table("numRooms year periodblt", where="WHERE fwd_geolocated"),
    **{f"sum_{name}": _table(keys) for name, keys in PERIOD_KEYS.items()},
    **{name: _table(keys) for name, keys in (ANNUAL_KEYS | QUARTERLY_KEYS).items()},
    "summaries_one_pass": _one_pass(PERIOD_KEYS),
    "annual_one_pass": _one_pass(ANNUAL_KEYS | QUARTERLY_KEYS),
    "parcel_rings_wkt": _rings(),
    "parcel_rings_geojson": _rings(),
    "geojson_features": _with(
        "SELECT muni AS town, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":['"
        " || cast(x AS varchar) || ',' || cast(y AS varchar) || ']},\"properties\":{\"id\":' || id ||"
        " ',\"muni\":' || coalesce('\"' || muni || '\"', 'null') || '}}' AS value FROM listings",
        "listings",
    ),
    "printable": _with(
        "SELECT id, cast(ask AS varchar) AS ask, upper(cast(fwd_geolocated AS varchar)) AS"
        " fwd_geolocated, cast(latitude AS varchar) AS latitude FROM listings",
        "listings",
    ),
    "parse_starts": _with(
        "SELECT camb_yr_built, ord, try_cast(replace(split_part(location, ',', 1), '(', '')"
        " AS double) AS latitude, try_cast(replace(split_part(location, ',', 2), ')', '')"
        " AS double) AS longitude, 'Cambridge' AS Muni, 'MA' AS State FROM (SELECT * REPLACE ("
        " CASE WHEN ord%17=0 THEN NULL ELSE camb_yr_built END AS camb_yr_built,"
        " CASE WHEN ord%13=0 AND ord%11<>0 THEN '' ELSE location END AS location) FROM starts)",
        "starts",
    ),
    "conform_types": _with(
        "SELECT cast(id AS varchar) AS id, CASE WHEN id%53<>0 THEN cast(ask AS double) END AS ask,"
        " numRooms, CASE WHEN id%59<>0 THEN year END AS year, month, ct10_id, source_id, muni,"
        " cast(NULL AS int) AS four_bedroom FROM listings",
        "listings",
    ),
    "unreadable_values": _with(
        "SELECT 'ask' AS \"column\", count(*) FILTER (id%53=0 AND ask IS NOT NULL) AS \"rows\" FROM"
        " listings UNION ALL SELECT 'year', count(*) FILTER (id%59=0) FROM listings",
        "listings",
    ),
    "clean_names": f"SELECT {views.COMPLETIONS_COLUMNS['parloc_id']} AS ward_parcel,"
    f" {views.COMPLETIONS_COLUMNS['complete_date']} AS complete_date, o_orderkey AS permit_number,"
    " o_orderkey%7 AS complete_date_2 FROM orders",
    "first_of_repeated": _with("SELECT id, muni, numRooms FROM listings", "listings"),
    "ordered_by_keys": _with(
        "SELECT muni, numRooms, cast(row_number() OVER (ORDER BY muni NULLS LAST, numRooms NULLS"
        " LAST) AS int) AS place FROM clean GROUP BY muni, numRooms",
        "clean",
    ),
    "town_partition": _with(
        "SELECT * FROM (" + _stats("clean", ("muni", "numRooms")) + ") WHERE muni IN ('BOSTON',"
        " 'CAMBRIDGE', 'QUINCY', 'SOMERVILLE', 'ARLINGTON')",
        "clean",
    ),
    "period_end_to_end": END_TO_END,
}
