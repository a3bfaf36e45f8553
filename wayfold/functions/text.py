"""Text functions of the search: normal form, tokens, phrases, synonyms, byte n-grams.

Plain Python functions state the meaning; the Column functions next to them compute the same inside the JVM, or, where no
built-in can, as an Arrow function over whole batches. Lengths and n-grams are those of UTF-8 bytes. Null gives null.
"""

from __future__ import annotations

import unicodedata
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the search.
MAX_TOKENS = 8
MAX_PHRASES = 32
MAX_RUN = 4
MAX_BIGRAMS = 128
FILLERS = ",;-/()."
EXACT_SYNONYMS = {"hbf": "hauptbahnhof", "hauptbahnhof": "hbf", "hauptbf": "hbf", "bahnhof": "bhf", "bhf": "bahnhof"}
SUFFIX_SYNONYMS = (("str", "strasse"), ("str.", "strasse"), ("strasse", "str."))


def normalize(s: str) -> str:
    """Case folded, decomposed, without marks."""
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(T.StringType())
def _normalize(s: pd.Series) -> pd.Series:
    return s.map(normalize, na_action="ignore")


def normalize_col(c: Column) -> Column:
    """``normalize`` as a column. ASCII stays in the JVM; only other texts are handed to Python."""
    odd = c.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_normalize(F.when(odd, c)), F.lower(c))


def erase_fillers(s: str) -> str:
    for f in FILLERS:
        s = s.replace(f, " ")
    return " ".join(p for p in s.split(" ") if p)


def erase_fillers_col(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[,;\-/().]", " "), " +", " "))


def query_tokens(s: str) -> list[str]:
    """Tokens of a query. A token of fillers only becomes an empty one and stays; one with a hyphen stays one token."""
    return [erase_fillers(normalize(t)) for t in s.split(" ") if t][:MAX_TOKENS]


def query_tokens_col(raw: Column, normalized: Column | None = None) -> Column:
    parts = F.filter(F.split(normalized if normalized is not None else normalize_col(raw), " "), lambda t: t != "")
    return F.transform(F.slice(parts, 1, MAX_TOKENS), erase_fillers_col)


def token_spans_col(raw: Column) -> Column:
    """(start, size) in bytes of every token of the raw query, however many."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.octet_length(t) + 1).alias("at"),
        F.when(t == "", acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.octet_length(t).alias("size"))))).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))
    return F.aggregate(F.split(raw, " "), zero, step, lambda acc: acc["spans"])


def dataset_tokens(normalized: str) -> list[str]:
    for f in FILLERS:
        normalized = normalized.replace(f, " ")
    return [t for t in normalized.split(" ") if t][:MAX_TOKENS]


def dataset_tokens_col(normalized: Column) -> Column:
    return F.slice(F.filter(F.split(normalized, r"[ \-,;/().]"), lambda t: t != ""), 1, MAX_TOKENS)


def synonym(token: str) -> str | None:
    """The one alternative of a token: an exact synonym, else the first suffix that fits."""
    if token in EXACT_SYNONYMS:
        return EXACT_SYNONYMS[token]
    return next((token[: len(token) - len(a)] + b for a, b in SUFFIX_SYNONYMS if token.endswith(a)), None)


def synonym_col(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in reversed(SUFFIX_SYNONYMS):
        out = F.when(t.endswith(a), F.concat(F.substring(t, F.lit(1), F.length(t) - len(a)), F.lit(b))).otherwise(out)
    for a, b in EXACT_SYNONYMS.items():
        out = F.when(t == a, F.lit(b)).otherwise(out)
    return out


def phrases(tokens: list[str]) -> list[tuple[int, str]]:
    """(token mask, phrase) of each run of up to four tokens in each choice of alternatives.

    An alternative is put without a blank before it, an original with one.
    """
    out = []
    choices = [[("", a)] * (a is not None) + [(" ", t)] for t, a in ((t, synonym(t)) for t in tokens)]
    for start in range(len(tokens)):
        for end in range(start + 1, min(len(tokens), start + MAX_RUN) + 1):
            mask = sum(1 << i for i in range(start, end))
            for parts in product(*choices[start:end]):
                text = ""
                for gap, word in parts:
                    text += (gap if text else "") + word
                out.append((mask, text))
    return out


def sorted_phrases(tokens: list[str]) -> list[tuple[int, str]]:
    """The longest phrases first, by bytes; equal ones in order of generation."""
    return sorted(phrases(tokens), key=lambda p: -len(p[1].encode()))[:MAX_PHRASES]


PHRASES = T.ArrayType(T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("s", T.StringType())]))


@F.pandas_udf(PHRASES)
def sorted_phrases_col(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [{"bits": b, "s": s} for b, s in sorted_phrases(list(t))], na_action="ignore")


@F.pandas_udf(PHRASES)
def phrases_col(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [{"bits": b, "s": s} for b, s in phrases(list(t))], na_action="ignore")


def is_numeric(token: str) -> bool:
    digits = sum("0" <= c <= "9" for c in token)
    return digits > 0 and digits >= (len(token.encode()) + 1) // 2


def is_numeric_col(t: Column) -> Column:
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (digits > 0) & (digits >= F.floor((F.octet_length(t) + 1) / 2))


def numeric_mask(tokens: list[str]) -> int:
    return sum(1 << i for i, t in enumerate(tokens) if is_numeric(t))


def numeric_mask_col(tokens: Column) -> Column:
    bits = F.transform(tokens, lambda t, i: F.when(is_numeric_col(t), F.pow(F.lit(2.0), i).cast("int")).otherwise(F.lit(0)))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def mask_text(mask: int, width: int = MAX_TOKENS) -> str:
    return "".join(str(mask >> i & 1) for i in range(width))


def mask_text_col(mask: Column, width: int = MAX_TOKENS) -> Column:
    return F.reverse(F.lpad(F.bin(mask), width, "0"))


def byte_ngrams(s: str, n: int) -> list[bytes]:
    """Neighbouring bytes; bigrams with a blank are passed over, trigrams keep them."""
    b = s.encode()
    grams = [b[i : i + n] for i in range(len(b) - n + 1)]
    return [g for g in grams if b" " not in g] if n == 2 else grams


def byte_ngrams_col(c: Column, n: int) -> Column:
    """The same as hexadecimal text."""
    hexed = F.hex(F.encode(c, "UTF-8"))
    size = F.octet_length(c)
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2 * n)))).otherwise(F.array().cast("array<string>"))
    grams = F.when(c.isNotNull(), grams)
    return F.filter(grams, lambda g: (F.substring(g, 1, 2) != "20") & (F.substring(g, 3, 2) != "20")) if n == 2 else grams


def compress_bigram(g: bytes) -> int:
    """Two bytes as a number, the first in the low byte."""
    return g[0] | g[1] << 8


def decompress_bigram(v: int) -> bytes:
    return bytes((v & 255, v >> 8))


def compress_bigram_col(g: Column) -> Column:
    return F.conv(F.concat(F.substring(g, 3, 2), F.substring(g, 1, 2)), 16, 10).cast("int")


def split_bigrams_col(c: Column) -> Column:
    """The first 128 bigrams, repeats included, in order of their numbers."""
    return F.array_sort(F.transform(F.slice(byte_ngrams_col(c, 2), 1, MAX_BIGRAMS), compress_bigram_col))


def stored_bigrams_col(normalized: Column) -> Column:
    """Bigrams of a stored string for the cosine: bytes less one, at most 255; an empty string wraps to 255."""
    size = F.octet_length(normalized)
    return F.when(size == 0, F.lit(255)).otherwise(F.least(F.lit(255), size - 1)).cast("int")


def guess_text(raw: str) -> str:
    """Text whose bigrams ask the index: the normal form with exact synonyms of tokens behind it, without a blank."""
    return normalize(raw) + "".join(EXACT_SYNONYMS.get(t, "") for t in query_tokens(raw))


def guess_text_col(normalized: Column, tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in EXACT_SYNONYMS.items() for x in p])
    return F.concat(normalized, F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(""))), ""))


def slug(name: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or name.lower()


def slug_col(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lower(c)).otherwise(s)
