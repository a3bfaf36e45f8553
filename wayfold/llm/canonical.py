"""Free-typed values mapped to the entries of a reference list.

Distinct values are normalised and cut into character grams of three families (neighbouring pairs, pairs with one letter
between, unordered pairs), which keeps swapped, lost and doubled letters close and ignores word order. An
inverted index of the list's grams gives the candidates; they are scored by weighted cosine, grams that few entries have
counting more. The best candidate is accepted above a threshold and a margin over the second; a weaker cosine is accepted
only if the edit distance of the two, blanks aside, bears it out. Everything runs in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that typists add to a value without changing what is meant.
SIDE_WORDS = ("former", "closed", "new", "amenity")

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000) + chr(0xA0)
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  "

#: The index is broadcast only if the list has at most this many entries (some 100 grams each); else it is joined by shuffle.
BROADCAST_ENTRIES = 50_000


def words(c: Column) -> Column:
    """Lower-case words of a value without side words."""
    plain = F.lower(F.translate(c, _WIDE, _NARROW))
    parts = F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*SIDE_WORDS))


def grams(tokens: Column) -> Column:
    def of(t: Column) -> Column:
        p = F.concat(F.lit("^"), t, F.lit("$"))
        n = F.length(p)
        at = lambda i: F.substring(p, i, F.lit(1))
        twos = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(p, i, F.lit(2)))
        gaps = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(at(i), F.lit("_"), at(i + 2)))
        loose = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("~"), F.least(at(i), at(i + 1)), F.greatest(at(i), at(i + 1))))
        return F.concat(twos, gaps, loose)

    return F.flatten(F.transform(tokens, of))


def map_to_list(values: DataFrame, reference: DataFrame, value: str = "value", entry: str = "value", threshold: float = 0.5, weak: float = 0.25, near: float = 0.45, margin: float = 0.02) -> DataFrame:
    """One row per distinct non-null value: ``typed``, ``entry`` (null if none was meant), ``score``, ``lead``.

    ``score`` is the cosine of the best entry, ``lead`` its distance to the second. Accepted if lead >= margin and either
    score >= threshold, or score >= weak with an edit distance of at most ``near`` times the entry's length. A value without
    letters or digits maps to nothing. Repeated or null list entries count once; an empty list maps everything to null.
    """
    listed = reference.where(F.col(entry).isNotNull()).select(F.col(entry).alias("e")).distinct().withColumn("ew", words(F.col("e")))
    total = listed.count()  # one number
    counted = listed.select("e", F.array_join("ew", "").alias("ec"), F.explode(grams(F.col("ew"))).alias("g")).groupBy("e", "ec", "g").agg(F.count(F.lit(1)).alias("c"))
    weights = counted.groupBy("g").agg(F.count(F.lit(1)).alias("df")).select("g", F.log1p(F.lit(float(total)) / F.col("df")).alias("w"))
    unseen = F.log1p(F.lit(float(max(total, 1))))
    index = counted.join(weights, "g").withColumn("x", F.col("c") * F.col("w"))
    index = index.withColumn("en", F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("e")))).select("g", "e", "ec", "w", (F.col("x") / F.col("en")).alias("x"))
    if total <= BROADCAST_ENTRIES:
        index, weights = F.broadcast(index), F.broadcast(weights)
    # few bytes but much work: spread over a stated number of tasks, which adaptive execution leaves alone; it must not be
    # the number that shuffles have anyway, or the planner takes this one out
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    distinct = values.where(F.col(value).isNotNull()).select(F.col(value).alias("typed")).distinct().repartition(tasks, "typed")
    typed = distinct.withColumn("tw", words(F.col("typed")))
    asked = typed.select("typed", F.array_join("tw", "").alias("tc"), F.explode(grams(F.col("tw"))).alias("g")).groupBy("typed", "tc", "g").agg(F.count(F.lit(1)).alias("c"))
    asked = asked.join(weights, "g", "left").withColumn("q", F.col("c") * F.coalesce(F.col("w"), unseen)).drop("w")
    asked = asked.withColumn("norm", F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("typed"))))
    # a gram that many entries have is many rows, which a join may split, not one large one
    scored = asked.join(index.select("g", "e", "ec", "x"), "g").groupBy("typed", "tc", "e", "ec").agg(F.round(F.sum(F.col("q") * F.col("x")) / F.first("norm"), 9).alias("s"))
    at = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("s"), "e"))
    two = scored.withColumn("at", at).where(F.col("at") <= 2).groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("at", "s", "e", "ec", "tc"))).alias("b"))
    first, second = F.col("b")[0], F.try_element_at("b", F.lit(2))
    score, lead = first["s"], first["s"] - second["s"]
    close = F.levenshtein(first["tc"], first["ec"]) <= F.floor(F.lit(near) * F.length(first["ec"]))
    accepted = (F.coalesce(lead, score) >= margin) & ((score >= threshold) | ((score >= weak) & close))
    found = two.select("typed", F.when(accepted, first["e"]).alias("entry"), score.alias("score"), F.coalesce(lead, score).alias("lead"))
    return typed.select("typed").join(found, "typed", "left")
