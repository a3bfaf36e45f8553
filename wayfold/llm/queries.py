"""The queries of this package, gathered from its modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import current_rows
from ..sources.tables import table
from . import canonical, mixing, packing, script_forms, shared_spans, term_counts, tokens, variant_names


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current nodes whose name, alt_name or official_name look the same in print but differ as stored."""
    tags = ("name", "alt_name", "official_name")
    nodes = current_rows(table(spark, folder, "osm_nodes"), {t: F.col("tags")[t] for t in tags})
    fields = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in tags])).alias("f")).select("id", "f.tag", "f.value")
    return script_forms.look_alikes(fields, "tag", "id", "value")


TERM_KEYS = ("amenity", "place", "operator", "surface", "wheelchair", "check_date")


def _terms(rows: DataFrame) -> DataFrame:
    packed = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}__"), F.col(k))) for k in TERM_KEYS])
    return rows.select(F.explode(packed).alias("term")).where(F.col("term").isNotNull())


def _marked_terms(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "osm_nodes")
    keys = {k: F.col("tags")[k] for k in TERM_KEYS}
    current = current_rows(nodes, keys)
    counts = term_counts.term_counts(_terms(nodes.select(*[c.alias(k) for k, c in keys.items()])), _terms(current))
    ids = nodes.where(F.col("id").isNotNull()).agg(F.count_distinct("id")).first()[0]
    return term_counts.marked(counts, ids)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of current rows that are too rare or too common."""
    return _marked_terms(spark, folder).where((F.col("records") > 0) & F.col("mark").isNotNull()).select("term", "mark")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences over all delivered rows, the nodes whose current row has it, and its mark."""
    return _marked_terms(spark, folder).select("term", "occurrences", F.col("records").alias("nodes"), "mark")


_P3 = """
WITH t AS (SELECT id, version, unnest(['amenity','place','operator','surface','wheelchair','check_date']) AS k, tags FROM osm_nodes),
d AS (SELECT id, version, k || '__' || map_extract(tags, k)[1] AS term FROM t),
v AS (SELECT id, max(version) AS version FROM osm_nodes GROUP BY id),
c AS (SELECT DISTINCT d.id, d.term FROM d JOIN v USING (id, version) WHERE d.term IS NOT NULL),
n AS (SELECT term, count(*) AS nodes FROM c GROUP BY term),
o AS (SELECT term, count(*) AS occurrences FROM d WHERE term IS NOT NULL GROUP BY term),
m AS (SELECT o.term, occurrences, coalesce(nodes, 0) AS nodes,
  CASE WHEN coalesce(nodes, 0) < 3 THEN 'rare' WHEN nodes * 20 > (SELECT count(DISTINCT id) FROM osm_nodes) THEN 'common' END AS mark
  FROM o LEFT JOIN n ON o.term = n.term)
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current nodes with an office tag that stand for the same person or firm."""
    tags = F.col("tags")
    columns = {k: tags[k] for k in ("office", "name", "old_name", "short_name", "alt_name")} | {"city": tags["addr:city"]}
    nodes = current_rows(table(spark, folder, "osm_nodes").where(F.col("id").isNotNull()), columns).where(F.col("office").isNotNull())
    names = F.array_compact(F.array("name", "old_name", "short_name", "alt_name"))
    return variant_names.links(nodes.withColumn("names", names), "office", "id", "city", "names")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current nodes whose amenity tag is not a list entry, with the entry meant, or '(none)'."""
    nodes = current_rows(table(spark, folder, "osm_nodes"), {"typed": F.col("tags")["amenity"]}).where(F.col("typed").isNotNull())
    listed = table(spark, folder, "amenity_list")
    open_nodes = nodes.join(listed.select(F.col("value").alias("typed")), "typed", "left_anti")
    mapped = canonical.map_to_list(open_nodes, listed, value="typed")
    return open_nodes.join(mapped, "typed").select(F.col("id").alias("node_id"), F.coalesce("entry", F.lit("(none)")).alias("value"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of text shared with another document in stretches of 200 characters or more."""
    return shared_spans.shared_spans(table(spark, folder, "documents"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each document's text that is found elsewhere."""
    docs = table(spark, folder, "documents")
    return shared_spans.shared_shares(docs, shared_spans.shared_spans(docs))


CONTAINER = 2048


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every text, or piece of a text over 2,048 tokens, with the fill of the container."""
    docs = table(spark, folder, "documents")
    # reads one number column, and the texts only if that is not filled everywhere; it sets how many parts there are
    known = docs.agg(F.sum("n_chars").alias("n"), F.count(F.lit(1)).alias("all"), F.count("n_chars").alias("told")).first() if "n_chars" in docs.columns else None
    chars = (known.n if known is not None and known.told == known["all"] else docs.agg(F.sum(F.length("text"))).first()[0]) or 0
    sized = docs.select("doc_id", tokens.n_tokens(F.col("text")).alias("n_tokens"))
    packed = packing.pack(sized, "doc_id", "n_tokens", CONTAINER, parts=packing.parts_for(chars // 4, CONTAINER))
    return packed.select(F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "part", "container", "fill")


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    docs = table(spark, folder, "documents").where(F.col("source").isNotNull())
    sized = docs.select(F.col("doc_id").alias("id"), "source", tokens.n_tokens(F.col("text")).alias("size"))
    return mixing.mix(sized, table(spark, folder, "source_weights"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Texts mixed to the sources' target shares of all tokens: shard, position, document, copy, source, tokens."""
    return _mix(spark, folder).records.select(F.col("shard").cast("int").alias("shard"), "pos", F.col("id").alias("doc_id"), "copy", "source", F.col("size").alias("n_tokens"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return _mix(spark, folder).report


QUERIES = {"p4_found": p4_found, "p3_found": p3_found, "p3_terms": p3_terms, "p7_pack": p7_pack, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shares": p9_shares, "p5_found": p5_found, "p6_found": p6_found}
#: Every window of 200 characters of every text, and the windows that two texts have, merged where they overlap or touch.
_P9 = """
WITH w AS (SELECT doc_id, s::INT AS s, md5(substr(text, s + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM documents WHERE length(text) >= 200)),
shared AS (SELECT doc_id, s FROM w JOIN (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) USING (h)),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM shared),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
spans AS (SELECT doc_id, min(s) AS start_pos, max(s) + 200 AS end_pos FROM runs GROUP BY doc_id, run)
"""
SQL: dict[str, str] = {
    "p9_found": _P9 + "SELECT * FROM spans",
    "p9_shares": _P9 + "SELECT doc_id, length(text)::INT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) END AS share FROM documents LEFT JOIN (SELECT doc_id, sum(end_pos - start_pos) AS n FROM spans GROUP BY doc_id) USING (doc_id)",
    "p3_found": _P3 + "SELECT term, mark FROM m WHERE nodes > 0 AND mark IS NOT NULL",
    "p3_terms": _P3 + "SELECT term, occurrences, nodes, mark FROM m",
}
