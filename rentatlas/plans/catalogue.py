"""The published tables as data: group keys, statistics and input of each product."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Product:
    name: str
    keys: tuple[str, ...]
    mean: bool = True
    source: str = "clean"
    by_town: bool = False


# Names and group keys of the published tables.
COUNTS = Product("counts", ("year", "month", "source_id"), mean=False)

PERIOD_TABLES = [
    Product("full", ("numRooms",)),
    Product("muni", ("muni", "numRooms"), by_town=True),
    Product("nhood", ("neighborhood_01", "muni", "numRooms"), by_town=True),
    Product("ct", ("ct10_id", "muni", "numRooms")),
    Product("zip", ("zip_code", "muni", "numRooms")),
    Product("full_age", ("source_id", "numRooms", "periodblt")),
    Product("muni_age", ("source_id", "muni", "numRooms", "periodblt"), by_town=True),
    Product(
        "nhood_age", ("source_id", "neighborhood_01", "muni", "numRooms", "periodblt"),
        by_town=True,
    ),
    Product("ct_age", ("source_id", "ct10_id", "numRooms", "periodblt")),
    Product("zip_age", ("source_id", "zip_code", "numRooms", "periodblt")),
]

ANNUAL_COUNTS = Product("annual_counts", COUNTS.keys, mean=False, source="units")

ANNUAL_TABLES = [
    Product("annual_full", ("numRooms", "year")),
    Product("annual_muni", ("muni", "numRooms", "year"), by_town=True),
    Product("annual_ct", ("ct10_id", "numRooms", "year")),
    Product("annual_nhood", ("neighborhood_01", "muni", "numRooms", "year"), by_town=True),
    Product("annual_zip", ("zip_code", "muni", "numRooms", "year")),
    Product("annual_full_age", ("source_id", "numRooms", "year", "periodblt")),
    Product(
        "annual_muni_age", ("source_id", "muni", "ct10_id", "numRooms", "year", "periodblt"),
        by_town=True,
    ),
    Product(
        "annual_nhood_age",
        ("source_id", "neighborhood_01", "muni", "numRooms", "year", "periodblt"),
        by_town=True,
    ),
    Product("annual_zip_age", ("source_id", "zip_code", "muni", "numRooms", "year", "periodblt")),
]

ANNUAL_FORWARD = Product("annual_fwd", ("numRooms", "year", "periodblt"), source="forward")

QUARTERLY_TABLES = [
    Product(f"quarterly_{p.name}", (*p.keys, "quarter"), by_town=p.by_town)
    for p in PERIOD_TABLES
]

PERIOD_PRODUCTS = [COUNTS, *PERIOD_TABLES]
ANNUAL_PRODUCTS = [*ANNUAL_TABLES, *QUARTERLY_TABLES]
