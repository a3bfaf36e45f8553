"""Queries of packed fields (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import current_rows
from ..operators.multi_value import explode_values, may_hold_several
from ..sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of each name or alt_name field with two names or more, of current nodes without an office tag."""
    tags = F.col("tags")
    wanted = {t: F.when(~F.map_contains_key(tags, F.lit("office")) & may_hold_several(tags[t]), tags[t]) for t in ("name", "alt_name")}
    nodes = current_rows(table(spark, folder, "osm_nodes"), wanted).where(F.col("name").isNotNull() | F.col("alt_name").isNotNull())
    return explode_values(nodes.withColumnRenamed("id", "node_id"), ["node_id"], ["name", "alt_name"], at_least=2)


QUERIES = {"p1_found": p1_found}

_BLANK = "[\\s\\x{a0}\\x{3000}]"


def _trimmed(v: str) -> str:
    return f"regexp_replace({v}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _open_quotes(v: str) -> str:
    """A value without the marks that enclose it, one pair of marks after the other."""
    for a, b in (('"', '"'), ("“", "”"), ("«", "»")):
        inner = f"substr({v}, 2, length({v}) - 2)"
        rest = f"replace({inner}, '{b}{b}', '')" if a == b else inner
        v = f"CASE WHEN length({v}) >= 2 AND starts_with({v}, '{a}') AND ends_with({v}, '{b}') AND NOT contains({rest}, '{a}') AND NOT contains({rest}, '{b}') THEN replace({inner}, '{b}{b}', '{b}') ELSE {v} END"
    return v


SQL: dict[str, str] = {
    "p1_found": f"""
WITH newest AS (SELECT DISTINCT id, version, tags FROM osm_nodes JOIN (SELECT id, max(version) AS version FROM osm_nodes GROUP BY id) USING (id, version)),
fields AS (SELECT id, unnest(['name', 'alt_name']) AS tag, tags FROM newest WHERE map_extract(tags, 'office')[1] IS NULL),
runs AS (SELECT id, tag, regexp_extract_all(map_extract(tags, tag)[1], '"[^"]*"|“[^”]*”|«[^»]*»|[^"“«]+|["“«]') AS rs FROM fields WHERE map_extract(tags, tag)[1] IS NOT NULL),
folded AS (SELECT id, tag, array_to_string(list_transform(rs, lambda r: CASE WHEN length(r) >= 2 AND r[1] IN ('"', '“', '«') THEN r ELSE regexp_replace(r, '[;|¦•\\n\\r]|,\\s|\\s/\\s', chr(30), 'g') END), '') AS f FROM runs),
parts AS (SELECT id, tag, list_transform(string_split(f, chr(30)), lambda v: {_trimmed('v')}) AS vs FROM folded),
opened AS (SELECT id, tag, list_filter(list_transform(vs, lambda v: {_trimmed(_open_quotes('v'))}), lambda v: v <> '') AS vs FROM parts)
SELECT DISTINCT id AS node_id, tag, i::INT AS pos, vs[i] AS value FROM opened, range(1, 100) t(i) WHERE len(vs) >= 2 AND i <= len(vs)""",
}
