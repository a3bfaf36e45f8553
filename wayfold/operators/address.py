"""Addresses as one line, by templates of countries.

Templates are a small part of the public Mustache language: {{field}}, {{{field}}} and {{#first}} a || b {{/first}}, which
gives the first alternative that is not blank. Countries without a template get number and road.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("house_number", "road", "neighbourhood", "suburb", "postcode", "city", "county", "state", "country", "country_code")

_ROAD_FIRST = "{{{road}}} {{{house_number}}}\n{{{postcode}}} {{#first}} {{{city}}} || {{{county}}} || {{{state}}} {{/first}}\n{{{country}}}"
_NUMBER_FIRST = "{{{house_number}}} {{{road}}}\n{{{postcode}}} {{#first}} {{{city}}} || {{{county}}} || {{{state}}} {{/first}}\n{{{country}}}"
_ENGLISH = "{{{house_number}}} {{{road}}}\n{{#first}} {{{city}}} || {{{suburb}}} || {{{county}}} {{/first}}\n{{{postcode}}}\n{{{country}}}"
_AMERICAN = "{{{house_number}}} {{{road}}}\n{{#first}} {{{city}}} || {{{county}}} {{/first}}, {{{state}}} {{{postcode}}}\n{{{country}}}"
_CITY_FIRST = "{{#first}} {{{city}}} || {{{county}}} {{/first}}\n{{{road}}} {{{house_number}}}\n{{{postcode}}}\n{{{country}}}"

TEMPLATES: dict[str, str] = (
    {c: _ROAD_FIRST for c in "DE AT CH NL BE DK SE NO FI PL CZ IT ES PT BG".split()} | {c: _NUMBER_FIRST for c in ("FR", "LU", "MC")} | {c: _ENGLISH for c in ("GB", "IE", "NZ")} | {c: _AMERICAN for c in ("US", "CA", "AU")} | {"HU": _CITY_FIRST}
)


def render(template: str, address: dict[str, str | None]) -> str:
    filled = re.sub(r"\{\{\{?\s*(\w+)\s*\}?\}\}", lambda m: address.get(m.group(1)) or "", template)
    filled = re.sub(r"\{\{#first\}\}(.*?)\{\{/first\}\}", lambda m: next((p.strip() for p in m.group(1).split("||") if p.strip()), ""), filled, flags=re.S)
    lines = [re.sub(r"\s+", " ", x).strip(" ,") for x in filled.replace(", ", "\n").split("\n")]
    return ", ".join(x for x in lines if x).replace(" .", "")


def format_address(address: dict[str, str | None], templates: dict[str, str] = TEMPLATES) -> str:
    template = templates.get(address.get("country_code") or "")
    if template is None:
        return " ".join(x for x in (address.get("house_number"), address.get("road")) if x)
    return render(template, address)


def address_col(address: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """One line of a struct with any of the FIELDS; null gives an empty line."""

    @F.pandas_udf(T.StringType())
    def run(a: pd.DataFrame) -> pd.Series:
        return pd.Series([format_address({k: (v if isinstance(v, str) else None) for k, v in r.items()}, templates) for r in a.to_dict("records")], dtype="object")

    return run(address)


def fallback_col(house_number: Column, road: Column) -> Column:
    """Number and road without a template, inside the JVM."""
    return F.concat_ws(" ", F.nullif(house_number, F.lit("")), F.nullif(road, F.lit("")))
