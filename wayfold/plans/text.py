"""Queries of the text and similarity functions and of the string index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import index as I
from ..sources.tables import table

#: Inline inputs of queries about single strings.
SAMPLES = ("hbf", "hauptbahnhof", "hauptbf", "bahnhof", "bhf", "hauptstr", "hauptstr.", "bergstrasse", "str", "abc", "98", "9a", "0aa")
ASKED = ("blue widget", "large bolt", "united kingdm", "germny", "small gear", "steel", "saudi arabia", "red")


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.normalize_col(F.col("text")).alias("norm"))


def erase_fillers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.erase_fillers_col(F.col("text")).alias("cleaned"))


def tokenize_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.posexplode(X.query_tokens_col(F.col("text"))).alias("token_no", "token"))


def token_spans(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "part").select("p_partkey", F.posexplode(X.token_spans_col(F.concat("p_name", F.lit("  "), "p_type"))).alias("token_no", "span"))
    return spans.select("p_partkey", "token_no", F.col("span.start").alias("start_idx"), F.col("span.size").alias("size"))


def numeric_tokens_mask(s: SparkSession, d: str) -> DataFrame:
    mask = X.numeric_mask_col(X.query_tokens_col(F.col("text")))
    return table(s, d, "documents").select("doc_id", mask.alias("mask"), X.mask_text_col(mask).alias("mask_text"))


def dataset_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.posexplode(X.dataset_tokens_col(X.normalize_col(F.col("text")))).alias("token_no", "token"))


def _samples(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(t,) for t in SAMPLES], "token string")


def synonym_expand(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).unionByName(_samples(s)).distinct()
    return words.select("token", X.synonym_col(F.col("token")).alias("synonym"))


def phrase_enumeration(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_brand"), F.lower("p_type")).alias("name")).distinct()
    tokens = X.query_tokens_col(F.col("name"), F.col("name"))
    return names.select("name", F.explode(X.phrases_col(tokens)).alias("p")).select("name", F.col("p.bits").alias("bits"), F.col("p.s").alias("phrase"))


def sorted_phrases(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.lower("p_name").alias("name")).unionByName(s.createDataFrame([("hauptstr 12",), ("darmstadt hbf",)], "name string")).distinct()
    tokens = X.query_tokens_col(F.col("name"), F.col("name"))
    return names.select("name", F.posexplode(X.sorted_phrases_col(tokens)).alias("rank", "p")).select("name", "rank", F.col("p.bits").alias("bits"), F.col("p.s").alias("phrase"))


def _names(s: SparkSession, d: str) -> DataFrame:
    """Names of parts, nations and customers, once each."""
    cols = (("part", "p_name"), ("nation", "n_name"), ("customer", "c_name"))
    out = None
    for t, c in cols:
        one = table(s, d, t).select(F.col(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _ngrams(n: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        return _names(s, d).select("value", F.posexplode(X.byte_ngrams_col(F.lower("value"), n)).alias("pos", "ngram"))

    return run


def bigram_set(s: SparkSession, d: str) -> DataFrame:
    grams = X.split_bigrams_col(F.lower("value"))
    return _names(s, d).select("value", F.size(grams).alias("n_in"), F.explode(F.array_distinct(grams)).alias("bigram"))


def string_dictionary(s: SparkSession, d: str) -> DataFrame:
    return I.strings(_names(s, d)).select("string_id", "value", "norm", "n_bigrams")


def ngram_index_build(s: SparkSession, d: str) -> DataFrame:
    return I.bigram_index(I.strings(_names(s, d)))


def ngram_count_per_string(s: SparkSession, d: str) -> DataFrame:
    return I.strings(_names(s, d)).select("value", "n_bigrams")


def asked(s: SparkSession, d: str) -> DataFrame:
    """Worked examples, and the names of every twentieth part."""
    own = table(s, d, "part").where(F.col("p_partkey") % 20 == 0).select((F.col("p_partkey") + 1000).alias("query_id"), F.lower("p_name").alias("text"))
    return s.createDataFrame(list(enumerate(ASKED)), "query_id long, text string").unionByName(own)


def ngram_match_count(s: SparkSession, d: str) -> DataFrame:
    strings = I.strings(_names(s, d))
    counts = I.match_counts(I.asked_bigrams(asked(s, d)), I.bigram_index(strings))
    return counts.hint("merge").join(strings.hint("merge"), "string_id").select("query_id", "value", "matches")


def cosine_candidates(s: SparkSession, d: str) -> DataFrame:
    strings = I.strings(_names(s, d))
    return I.candidates(asked(s, d), strings, I.bigram_index(strings)).select("query_id", "value", F.round("cosine", 6).alias("cosine"))


def candidate_topk(s: SparkSession, d: str) -> DataFrame:
    strings = I.strings(_names(s, d))
    return I.candidates(asked(s, d), strings, I.bigram_index(strings), most=5).select("query_id", "value", F.round("cosine", 6).alias("cosine"), "rank")


def posting_lists(s: SparkSession, d: str) -> DataFrame:
    strings = I.strings(_names(s, d))
    streets = table(s, d, "part").select(F.col("p_name").alias("value")).distinct().withColumn("loc_type", F.lit("street"))
    places = table(s, d, "customer").select(F.col("c_name").alias("value")).distinct().withColumn("loc_type", F.lit("place"))
    return I.postings(strings, streets.unionByName(places)).join(strings.select("string_id", "value"), "string_id").select("string_id", "value", "loc_type")


def integrity_check(s: SparkSession, d: str) -> DataFrame:
    """Postings of parts and customers held against a register that has lost the customers with a key divisible by 7."""
    strings = I.strings(_names(s, d))
    parts = table(s, d, "part").select(F.col("p_name").alias("value")).distinct()
    customers = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("value"))
    posted = parts.withColumn("loc_type", F.lit("street")).unionByName(customers.select("value").distinct().withColumn("loc_type", F.lit("place")))
    return I.broken_postings(I.postings(strings, posted), strings, parts.unionByName(customers.where("c_custkey % 7 <> 0").select("value")))


def db_stats(s: SparkSession, d: str) -> DataFrame:
    parts = {"strings": _names(s, d), "streets": table(s, d, "part").select("p_name").distinct(), "places": table(s, d, "customer"), "areas": table(s, d, "nation")}
    return I.stats(parts)


#: A stated set of asked words that every name is held against.
WORDS = ("blue", "bolt", "widgt", "gear", "smal", "larg", "steel", "red bolt", "green gaer", "valve")


def _part_pairs(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.lower("p_name").alias("a")).distinct()
    return names.select("a", F.explode(F.array(*map(F.lit, WORDS))).alias("b"))


def levenshtein_threshold(s: SparkSession, d: str) -> DataFrame:
    pairs = _part_pairs(s, d).withColumn("limit", (F.floor(F.least(F.length("a"), F.length("b")) / 2) + 2).cast("int"))
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= F.col("limit")).select("a", "b", "distance")


def _scored(f):
    def run(s: SparkSession, d: str) -> DataFrame:
        return _part_pairs(s, d).select("a", "b", f(F.col("a"), F.col("b")).alias("score"))

    return run


def icon_slug(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_type").distinct().select("p_type", X.slug_col(F.col("p_type")).alias("slug"))


QUERIES = {
    "normalize_text": normalize_text, "erase_fillers": erase_fillers, "tokenize_query": tokenize_query, "token_spans": token_spans, "numeric_tokens_mask": numeric_tokens_mask,
    "dataset_tokens": dataset_tokens, "synonym_expand": synonym_expand, "phrase_enumeration": phrase_enumeration, "sorted_phrases": sorted_phrases,
    "byte_bigrams": _ngrams(2), "byte_trigrams": _ngrams(3), "bigram_set": bigram_set, "string_dictionary": string_dictionary, "ngram_index_build": ngram_index_build,
    "ngram_count_per_string": ngram_count_per_string, "ngram_match_count": ngram_match_count, "cosine_candidates": cosine_candidates, "candidate_topk": candidate_topk,
    "posting_lists": posting_lists, "integrity_check": integrity_check, "db_stats": db_stats, "levenshtein_threshold": levenshtein_threshold,
    "sift4_distance": _scored(S.distance_col), "token_match_score": _scored(S.token_score_col), "name_match_score": _scored(S.name_score_col), "icon_slug": icon_slug,
}

_NORM = "replace(strip_accents(lower(text)), 'ß', 'ss')"
_ERASE = "trim(regexp_replace(regexp_replace({0}, '[,;\\-/().]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_TOKENS = f"list_transform(list_slice(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''), 1, 8), lambda x: {_ERASE.format('x')})"
_NAMES = "names AS (SELECT p_name AS value FROM part UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer)"
_HEXED = "hexed AS (SELECT value, lower(value) AS norm, hex(encode(lower(value))) AS h, strlen(value) AS n FROM names)"
_BIGRAMS = "grams AS (SELECT value, norm, n, list_filter(list_transform(range(0, n - 1), lambda i: substr(h, (2 * i + 1)::INT, 4)), lambda g: g[1:2] <> '20' AND g[3:4] <> '20') AS gs FROM hexed)"
_STRINGS = f"{_NAMES}, {_HEXED}, {_BIGRAMS}, strings AS (SELECT row_number() OVER (ORDER BY value) - 1 AS string_id, value, norm, least(255, n - 1) AS n_bigrams, gs FROM grams)"
_INDEX = "idx AS (SELECT DISTINCT unnest(gs) AS bigram, string_id FROM strings)"
_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(ASKED)) + ") t(query_id, text) UNION ALL SELECT p_partkey + 1000, lower(p_name) FROM part WHERE p_partkey % 20 = 0)"
_QGRAMS = "qgrams AS (SELECT query_id, list_filter(list_transform(range(0, strlen(text) - 1), lambda i: substr(hex(encode(text)), (2 * i + 1)::INT, 4)), lambda g: g[1:2] <> '20' AND g[3:4] <> '20') AS gs FROM asked)"
_COUNTS = "qg AS (SELECT DISTINCT query_id, len(gs) AS n_in, unnest(gs) AS bigram FROM qgrams), counts AS (SELECT query_id, n_in, string_id, count(*) AS matches FROM qg JOIN idx USING (bigram) GROUP BY ALL)"
_COSINE = (
    "cand AS (SELECT query_id, value, string_id, matches * matches / (n_bigrams * n_in)::DOUBLE AS c FROM counts JOIN strings USING (string_id) "
    "WHERE matches >= 2 + n_in // (4 + n_in // 10) AND matches * matches / (n_bigrams * n_in)::DOUBLE >= 0.17)"
)
_ALL = f"WITH {_STRINGS}, {_INDEX}, {_ASKED}, {_QGRAMS}, {_COUNTS}, {_COSINE} "
_TOKEN_ROWS = "tok AS (SELECT name, string_split(name, ' ')[1:8] AS ts FROM names)"
_RUNS = (
    "runs AS (SELECT name, ts, f, l FROM tok, range(0, 8) a(f), range(1, 5) b(l) WHERE f + l <= len(ts)), "
    "ph AS (SELECT name, f, l, (((1 << l) - 1) << f)::INT AS bits, array_to_string(ts[(f + 1):(f + l)], ' ') AS phrase FROM runs)"
)

SQL = {
    "normalize_text": f"SELECT doc_id, {_NORM} AS norm FROM documents",
    "erase_fillers": f"SELECT doc_id, {_ERASE.format('text')} AS cleaned FROM documents",
    "tokenize_query": f"SELECT doc_id, i::INT AS token_no, ts[i + 1] AS token FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents), range(0, 8) r(i) WHERE i < len(ts)",
    "token_spans": (
        "WITH t AS (SELECT p_partkey, string_split(p_name || '  ' || p_type, ' ') AS ts FROM part), "
        "u AS (SELECT p_partkey, i, ts[i + 1] AS tok, coalesce(list_sum(list_transform(ts[1:i], lambda x: strlen(x) + 1)), 0)::INT AS start_idx FROM t, range(0, 40) r(i) WHERE i < len(ts)) "
        "SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INT AS token_no, start_idx, strlen(tok)::INT AS size FROM u WHERE tok <> ''"
    ),
    "numeric_tokens_mask": (
        f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), b AS (SELECT doc_id, list_transform(range(0, 8), lambda i: CASE WHEN i < len(ts) AND len(regexp_replace(ts[i + 1], '[^0-9]', '', 'g')) > 0 "
        "AND len(regexp_replace(ts[i + 1], '[^0-9]', '', 'g')) >= (strlen(ts[i + 1]) + 1) // 2 THEN 1 ELSE 0 END) AS bs FROM t) "
        "SELECT doc_id, list_sum(list_transform(range(0, 8), lambda i: bs[i + 1] << i))::INT AS mask, array_to_string(bs, '') AS mask_text FROM b"
    ),
    "dataset_tokens": f"SELECT doc_id, i::INT AS token_no, ts[i + 1] AS token FROM (SELECT doc_id, list_slice(list_filter(regexp_split_to_array({_NORM}, '[ \\-,;/().]'), lambda x: x <> ''), 1, 8) AS ts FROM documents), range(0, 8) r(i) WHERE i < len(ts)",
    "synonym_expand": (
        "WITH w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part UNION SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in SAMPLES) + ") v(token)) "
        "SELECT token, CASE WHEN token = 'hbf' THEN 'hauptbahnhof' WHEN token IN ('hauptbahnhof', 'hauptbf') THEN 'hbf' WHEN token = 'bahnhof' THEN 'bhf' WHEN token = 'bhf' THEN 'bahnhof' "
        "WHEN token LIKE '%str' THEN token || 'asse' WHEN token LIKE '%str.' THEN left(token, len(token) - 1) || 'asse' WHEN token LIKE '%strasse' THEN left(token, len(token) - 4) || '.' END AS synonym FROM w"
    ),
    "phrase_enumeration": "WITH names AS (SELECT DISTINCT lower(p_name || ' ' || p_brand || ' ' || p_type) AS name FROM part), tok AS (SELECT name, list_transform(string_split(name, ' ')[1:8], lambda x: trim(regexp_replace(regexp_replace(x, '[,;\\-/().]', ' ', 'g'), ' +', ' ', 'g'))) AS ts FROM names), " + _RUNS + " SELECT name, bits, phrase FROM ph",
    "byte_bigrams": f"WITH {_NAMES}, {_HEXED}, {_BIGRAMS} SELECT value, (i - 1)::INT AS pos, gs[i] AS ngram FROM grams, range(1, 256) r(i) WHERE i <= len(gs)",
    "byte_trigrams": f"WITH {_NAMES}, {_HEXED} SELECT value, i::INT AS pos, substr(h, (2 * i + 1)::INT, 6) AS ngram FROM hexed, range(0, 256) r(i) WHERE i <= n - 3",
    "bigram_set": f"WITH {_NAMES}, {_HEXED}, {_BIGRAMS}, c AS (SELECT value, list_transform(gs[1:128], lambda g: ('0x' || g[3:4] || g[1:2])::INT) AS gs FROM grams) SELECT value, len(gs)::INT AS n_in, unnest(list_distinct(gs)) AS bigram FROM c",
    "string_dictionary": f"WITH {_STRINGS} SELECT string_id, value, norm, n_bigrams::INT AS n_bigrams FROM strings",
    "ngram_index_build": f"WITH {_STRINGS}, {_INDEX} SELECT ('0x' || bigram[3:4] || bigram[1:2])::INT AS bigram, string_id FROM idx",
    "ngram_count_per_string": f"WITH {_STRINGS} SELECT value, n_bigrams::INT AS n_bigrams FROM strings",
    "ngram_match_count": _ALL + "SELECT query_id, value, matches FROM counts JOIN strings USING (string_id)",
    "cosine_candidates": _ALL + "SELECT query_id, value, round(c, 6) AS cosine FROM cand",
    "candidate_topk": _ALL + "SELECT query_id, value, round(c, 6) AS cosine, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, string_id))::INT AS rank FROM cand) WHERE rank <= 5",
    "posting_lists": f"WITH {_STRINGS} SELECT string_id, value, loc_type FROM strings JOIN (SELECT DISTINCT p_name AS value, 'street' AS loc_type FROM part UNION ALL SELECT DISTINCT c_name, 'place' FROM customer) USING (value)",
    "integrity_check": f"WITH {_STRINGS}, lost AS (SELECT c_name AS value FROM customer GROUP BY 1 HAVING bool_and(c_custkey % 7 = 0)) SELECT string_id, 'place' AS loc_type FROM strings JOIN lost USING (value) WHERE value NOT IN (SELECT p_name FROM part)",
    # the examples' phrases are written out; of all others, runs are put in order by bytes, then by start and length
    "sorted_phrases": (
        "WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part), " + _TOKEN_ROWS + ", " + _RUNS + ", "
        "r AS (SELECT name, (row_number() OVER (PARTITION BY name ORDER BY strlen(phrase) DESC, f, l) - 1)::INT AS rank, bits, phrase FROM ph) SELECT * FROM r WHERE rank < 32 "
        "UNION ALL SELECT * FROM (VALUES ('hauptstr 12', 0, 3, 'hauptstrasse 12'), ('hauptstr 12', 1, 1, 'hauptstrasse'), ('hauptstr 12', 2, 3, 'hauptstr 12'), ('hauptstr 12', 3, 1, 'hauptstr'), ('hauptstr 12', 4, 2, '12'), "
        "('darmstadt hbf', 0, 3, 'darmstadthauptbahnhof'), ('darmstadt hbf', 1, 3, 'darmstadt hbf'), ('darmstadt hbf', 2, 2, 'hauptbahnhof'), ('darmstadt hbf', 3, 1, 'darmstadt'), ('darmstadt hbf', 4, 2, 'hbf')) v"
    ),
    "db_stats": f"WITH {_NAMES} SELECT 'strings' AS part, count(*) AS n FROM names UNION ALL SELECT 'streets', count(DISTINCT p_name) FROM part UNION ALL SELECT 'places', count(*) FROM customer UNION ALL SELECT 'areas', count(*) FROM nation",
    "levenshtein_threshold": (
        "WITH a AS (SELECT DISTINCT lower(p_name) AS a FROM part), b AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS b) "
        "SELECT a, b, levenshtein(a, b)::INT AS distance FROM a, b WHERE levenshtein(a, b) <= least(len(a), len(b)) // 2 + 2"
    ),
    "icon_slug": "SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
}
