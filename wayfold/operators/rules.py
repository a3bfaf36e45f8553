"""Tags to categories: ordered rules, the first that fits wins.

Rules are data: (conditions, category), a condition being a key with a value or with '*' for any value. They become one
``coalesce(when ...)`` chain, which Spark compiles. A full set is derived from the public wiki tables with
``wayfold.sources.wiki``; RULES below are the ones that scoring and place search rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[tuple[tuple[str, str], ...], str]

# Conditions and category, in order of precedence. place=city is met by place_6 first, so "city" is never given.
_FEATURES: list[Rule] = [
    ((("amenity", "restaurant"),), "restaurant_14"),
    ((("amenity", "food_court"),), "restaurant_14"),
    ((("amenity", "cafe"),), "cafe_16"),
    ((("amenity", "fast_food"),), "fast_food_16"),
    ((("amenity", "bar"),), "bar_16"),
    ((("amenity", "pub"),), "pub_16"),
    ((("amenity", "ice_cream"),), "ice_cream_14"),
    ((("amenity", "biergarten"),), "biergarten_16"),
    ((("leisure", "outdoor_seating"),), "outdoor_seating_14"),
    ((("tourism", "artwork"),), "artwork_14"),
    ((("amenity", "community_centre"),), "community_centre_14"),
    ((("amenity", "library"),), "library_16"),
    ((("tourism", "museum"),), "museum_16"),
    ((("amenity", "theatre"),), "theatre_16"),
    ((("amenity", "vehicle_inspection"),), "vehicle_inspection_14"),
    ((("shop", "dairy"),), "dairy"),
    ((("shop", "*"),), "shop_other_16"),
    ((("amenity", "driving_school"),), "shop_other_16"),
    ((("office", "*"),), "office_16"),
    ((("power", "tower"),), "power_tower"),
    ((("power", "pole"),), "power_pole"),
    ((("place", "city"),), "place_6"),
    ((("capital", "*"),), "place_capital_8"),
    ((("entrance", "yes"),), "rect"),
    ((("entrance", "main"),), "entrance_main"),
    ((("entrance", "service"),), "entrance"),
    ((("entrance", "*"), ("access", "no")), "rectdiag"),
]
# Kinds of places, each its own category.
_PLACES = (
    "country", "state", "region", "province", "district", "county", "subdistrict", "municipality", "city", "borough", "suburb", "quarter", "neighbourhood", "city_block", "plot", "town",
    "village", "hamlet", "isolated_dwelling", "farm", "allotments", "continent", "archipelago", "island", "islet", "square", "locality", "polder", "sea", "ocean",
)

RULES: list[Rule] = _FEATURES + [((("place", p),), p) for p in _PLACES]


def without_shadowed(rules: list[Rule]) -> list[Rule]:
    """Rules that can be reached: none whose conditions an earlier rule's follow from, none that ask one key for two values."""
    out: list[Rule] = []
    for conditions, name in rules:
        values: dict[str, set[str]] = {}
        for k, v in conditions:
            values.setdefault(k, set()).add(v)
        if any(len(v - {"*"}) > 1 for v in values.values()):
            continue
        held = lambda c: c in conditions or c[1] == "*" and c[0] in values  # noqa: E731, B023
        if not any(all(held(c) for c in earlier) for earlier, _ in out):
            out.append((conditions, name))
    return out


def category(tags: Column, rules: list[Rule] = RULES) -> Column:
    """Category of a tag map; 'none' where no rule fits or the map is null. An empty value is no value."""
    def holds(k: str, v: str) -> Column:
        c = tags[k]
        return F.length(c) > 0 if v == "*" else c == v

    out = []
    for conditions, name in without_shadowed(rules):
        test = holds(*conditions[0])
        for c in conditions[1:]:
            test = test & holds(*c)
        out.append(F.when(test, F.lit(name)))
    return F.coalesce(*out, F.lit("none"))
