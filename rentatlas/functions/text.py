"""Keyword flags on titles and text clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that mark a room, sublet, short-term or shared offer. Titles are
# upper case and every phrase stands between spaces.
ROOM_PHRASES = ["ROOM RENT", "ROOMMATE", "ROOMIE"]
ROOM_IN = ["ONE ROOM IN", "ONE BEDROOM IN", "ROOM AVAILABLE IN", "BEDROOM AVAILABLE IN"]
ROOM_PLACES = [
    "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE",
    "HOUSE", "CONDO", "APARTMENT",
]
SUBLET_PHRASE = "SUBLET"
SHORT_TERM_PHRASE = "SHORT TERM"
SHARED_PHRASES = ["SHARED", "SHARE"]

ROOM_PATTERN = (
    f" (?:{'|'.join(ROOM_PHRASES)}|(?:{'|'.join(ROOM_IN)}) (?:{'|'.join(ROOM_PLACES)})) "
)
SHARED_PATTERN = f" (?:{'|'.join(SHARED_PHRASES)}) "


def _found(test: Column) -> Column:
    # A missing title carries no phrase, so the flag is false rather than NULL.
    return F.coalesce(test, F.lit(False))


def is_room_rent(title: Column) -> Column:
    return _found(title.rlike(ROOM_PATTERN))


def is_sublet(title: Column) -> Column:
    return _found(title.contains(f" {SUBLET_PHRASE} "))


def is_short_term(title: Column) -> Column:
    return _found(title.contains(f" {SHORT_TERM_PHRASE} "))


def is_shared(title: Column) -> Column:
    return _found(title.rlike(SHARED_PATTERN))


def location_part(location: Column, index: int) -> Column:
    """Number ``index`` of a ``"(first, second)"`` text; NULL when absent or not a number.

    The first number loses the opening bracket only and the second the closing one, so a text that
    lacks its second part has no first number either.
    """
    part = F.get(F.split(location, ",", -1), F.lit(index))
    return F.trim(F.replace(part, F.lit(")" if index else "("), F.lit(""))).try_cast("double")


def drop_header_dots(name: str) -> str:
    return name.replace(".", "")


def snake_case(name: str) -> str:
    """Lower-case words joined by underscores; ``#`` and ``%`` are spelled out."""
    text = name.replace("'", "").replace('"', "")
    text = text.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if text[:1].isdigit() else text or "x"


def unique_names(names: list[str]) -> list[str]:
    """Number repeated names ``a, a_2, a_3``; names are compared without regard to case.

    A number that another column already carries is skipped.
    """
    given = {n.lower() for n in names}
    used: set[str] = set()
    result = []
    for name in names:
        unique, number = name, 1
        while unique.lower() in used or (number > 1 and unique.lower() in given):
            number += 1
            unique = f"{name}_{number}"
        used.add(unique.lower())
        result.append(unique)
    return result
