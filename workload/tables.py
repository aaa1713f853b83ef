"""Derived columns as expressions that Spark and the checking engine both read."""

from __future__ import annotations

# One expression per column, valid in Spark and in the checking engine alike.
LISTING_COLUMNS = {
    "id": "l_orderkey*10 + l_linenumber",
    "ask": "case when l_partkey%97=0 and l_linenumber=7 then null"
    " else cast(floor(l_extendedprice/25) as int) end",
    "numRooms": "l_linenumber - 2",
    "source_id": "case when l_orderkey%41=0 then null else cast(1 + l_suppkey%2 as int) end",
    "muni": "case l_partkey%6 when 0 then 'BOSTON' when 1 then 'CAMBRIDGE' when 2 then 'QUINCY'"
    " when 3 then 'SOMERVILLE' when 4 then 'ARLINGTON' end",
    "neighborhood_01": "concat('N', cast(l_suppkey%7 as varchar(10)))",
    "ct10_id": "25017000000 + l_partkey%50",
    "zip_code": "case when l_partkey%11=0 then null when l_partkey%11<3 then '02108'"
    " else concat('0213', cast(l_partkey%10 as varchar(10))) end",
    "BASE_merge": "case l_suppkey%5 when 0 then 'Acorn' when 1 then 'Willow' when 2 then null"
    " when 3 then '' else 'Main' end",
    "post_date": "cast(l_shipdate as date)",
    "updated_date": "cast(l_shipdate as date) + cast(l_quantity as int)",
    "year": "cast(extract(year from l_shipdate) as int)",
    "month": "cast(extract(month from l_shipdate) as int)",
    "title": "case when l_partkey%101=0 then null else concat(' ', upper(p_name), ' ',"
    " case l_orderkey%29 when 0 then 'SUBLET' when 1 then 'ROOMMATE' when 2 then 'SHORT TERM'"
    " when 3 then 'SHARE' when 4 then 'ONE BEDROOM IN THREE' when 5 then 'ROOMIE'"
    " when 6 then 'ROOM RENT' when 7 then 'SHARED' when 8 then 'ONE ROOM IN HOUSE'"
    " when 9 then 'BEDROOM AVAILABLE IN CONDO' when 10 then 'ROOM AVAILABLE IN APARTMENT'"
    " when 11 then 'ONE ROOM IN TEN' when 12 then 'ROOMMATES' else 'APARTMENT' end, ' ') end",
    "x": "cast((l_partkey%400)*10 as double)",
    "y": "cast(floor(l_suppkey/20)*100 + l_orderkey%100 as double)",
    "parloc_id": "case when l_partkey%17=0 then null"
    " else concat('P', cast(l_partkey as varchar(20))) end",
    "yr_built": "case l_partkey%4 when 0 then null when 1 then 1990 when 2 then 2011"
    " else 2015 end",
    "longitude": "-71.2 + cast(l_partkey%400 as double)*cast(0.001 as double)",
    "latitude": "42.2 + cast(l_suppkey%100 as double)*cast(0.002 as double)",
    "longitude_merge": "case when l_orderkey%3=0 then null when l_orderkey%3=1"
    " then cast(-71.05 as double) - cast(l_partkey%10 as double)*cast(0.01 as double)"
    " else cast(0 as double) end",
    "latitude_merge": "case when l_orderkey%3=0 then null when l_orderkey%3=1"
    " then cast(42.35 as double) else cast(0 as double) end",
    "fwd_geolocated": "case l_suppkey%4 when 0 then null when 1 then false else true end",
    "eight_bedroom": "cast(l_quantity as int)%2",
    "rooms8": "case when l_linenumber=7 then null when l_linenumber>4 then 8"
    " else l_linenumber end",
}

STARTS_COLUMNS = {
    "parloc_id": "case when o_custkey%13=0 then null"
    " else concat('P', cast(o_custkey as varchar(20))) end",
    "camb_yr_built": "cast(extract(year from o_orderdate) as int)",
    "ord": "o_orderkey",
    "location": "case when o_orderkey%11=0 then 'unknown' when o_orderkey%13=0 then ''"
    " when o_orderstatus='F' then concat('(', cast(o_orderkey%90 as varchar(10)), ')') else concat('(',"
    " cast(o_orderkey%90 as varchar(10)), '.25, -', cast(o_custkey%180 as varchar(10)),"
    " '.5)') end",
    "x": "cast((o_custkey%400)*10 as double)",
    "y": "cast(floor(o_orderkey/30) as double)",
}

COMPLETIONS_COLUMNS = {
    "parloc_id": "concat('P', cast(o_custkey as varchar(20)))",
    "complete_date": "case when o_orderkey%9=0 then 'n/a' when o_orderstatus='O' then ''"
    " else concat("
    "cast(extract(month from o_orderdate) as varchar(10)), '/',"
    " cast(extract(day from o_orderdate) as varchar(10)), '/',"
    " cast(extract(year from o_orderdate) as varchar(10))) end",
}

PARCEL_COLUMNS = {
    "poly_idx": "s_suppkey",
    "parloc_id": "concat('P', cast(s_suppkey as varchar(20)))",
    "town": "case s_nationkey%3 when 0 then 'Cambridge' when 1 then 'Boston' else 'Quincy' end",
    "yr_built": "case s_suppkey%5 when 0 then null when 1 then 'n/a'"
    " else cast(1960 + s_suppkey%60 as varchar(10)) end",
    "x0": "(s_suppkey%20)*200",
    "x1": "(s_suppkey%20)*200 + 220",
    "y0": "cast(floor(s_suppkey/20)*100 as bigint)",
    "y1": "cast(floor(s_suppkey/20)*100 + 110 as bigint)",
}

ZIP_COLUMNS = {
    "poly_idx": "s_suppkey",
    "postcode": "case when s_suppkey%11<3 then '02108'"
    " else concat('0213', cast(s_suppkey%10 as varchar(10))) end",
    "pc_name": "s_name",
    "x0": "(s_suppkey%20)*200",
    "y0": "cast(floor(s_suppkey/20)*100 as bigint)",
}

# Text forms of the parcels: whole, in two parts, or empty.
PARCEL_WKT = (
    "case when poly_idx%7=0 then 'POLYGON EMPTY' when poly_idx%7=1 then concat('MULTIPOLYGON ((('"
    ", {box}, ')), ((', {small}, ')))') else concat('POLYGON ((', {box}, '))') end"
)
PARCEL_GEOJSON = (
    "case when poly_idx%7=0 then 'null' when poly_idx%7=1 then concat("
    "'{{\"type\":\"MultiPolygon\",\"coordinates\":[[[', {box}, ']],[[', {small}, ']]]}}')"
    " else concat('{{\"type\":\"Polygon\",\"coordinates\":[[', {box}, ']]}}') end"
)


def _spelled(open_: str, between: str, close: str, corners: list[tuple[str, str]]) -> str:
    def number(expr: str) -> str:
        return f"cast({expr} as varchar(20))"

    return ", ', ', ".join(
        f"'{open_}', {number(x)}, '{between}', {number(y)}, '{close}'" for x, y in corners
    )


def parcel_text(kind: str) -> str:
    """Expression for the well-known text or GeoJSON geometry of a parcel box."""
    box = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    small = [("x0", "y0"), ("x0+1", "y0"), ("x0+1", "y0+1"), ("x0", "y0")]
    marks = ("", " ", "") if kind == "wkt" else ("[", ",", "]")
    form = PARCEL_WKT if kind == "wkt" else PARCEL_GEOJSON
    return form.format(box=_spelled(*marks, box), small=_spelled(*marks, small))
