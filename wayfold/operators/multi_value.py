"""Several values packed in one field, taken apart into one row per value.

A field is cut into quoted and plain runs. Plain runs are cut at delimiters, quoted runs are carried over whole, and the
runs are then folded back together, so that a name may be partly quoted. All of it is built from SQL functions: there is
no Python in the plan and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing quotation marks, and the delimiters that hold outside of them. A comma counts only
#: before a blank, a slash only between blanks.
QUOTES = (('"', '"'), ("“", "”"), ("«", "»"))
DELIMITERS = r"[;|¦•\n\r\x{1e}]|,(?=\s)|(?<=\s)/(?=\s)"

#: The ASCII record separator stands for "a delimiter was here" while runs are folded together; in the input it delimits too.
MARK = "\u001e"

_QUOTED = "|".join(f"{a}[^{b}]*{b}" for a, b in QUOTES)
_OPENERS = "".join(a for a, _ in QUOTES)
_RUNS = f"{_QUOTED}|[^{_OPENERS}]+|[{_OPENERS}]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")


def _unquote(c: Column) -> Column:
    """Drop marks that enclose the whole value and turn doubled ones inside into one."""
    out = c
    for a, b in QUOTES:
        inner = c.substr(F.lit(2), F.length(c) - 2)
        closed = inner if a != b else F.replace(inner, F.lit(b + b), F.lit(""))
        whole = c.startswith(a) & c.endswith(b) & (F.length(c) >= 2) & ~closed.contains(a) & ~closed.contains(b)
        out = F.when(whole, F.replace(inner, F.lit(b + b), F.lit(b))).otherwise(out)
    return out


def split_values(field: Column) -> Column:
    """The values of a field as an array, in order.

    Null gives null, a field without a value an empty array. Values are trimmed, empty ones are skipped, repeated ones are
    kept. A quotation mark that is never closed is an ordinary character.
    """
    runs = F.regexp_extract_all(field, F.lit(f"({_RUNS})"), F.lit(1))
    quoted = lambda r: (F.length(r) >= 2) & F.substring(r, 1, 1).isin([a for a, _ in QUOTES])
    folded = F.array_join(F.transform(runs, lambda r: F.when(quoted(r), F.replace(r, F.lit(MARK), F.lit(" "))).otherwise(F.regexp_replace(r, DELIMITERS, MARK))), "")
    values = F.transform(F.split(folded, MARK, -1), lambda v: _trim(_unquote(_trim(v))))
    return F.filter(values, lambda v: v != "")


def may_hold_several(field: Column) -> Column:
    """Cheap test that is true for every field with more than one value."""
    return field.rlike(r"[;|¦•\n\r\x{1e},/]")


def explode_values(rows: DataFrame, keys: list[str], fields: list[str], at_least: int = 1, names: tuple[str, str, str] = ("tag", "pos", "value")) -> DataFrame:
    """One row per value of each of ``fields``: the key columns, the field's name, the position from 1 and the value.

    Fields with fewer than ``at_least`` values are left out. Other columns of ``rows`` are dropped, whatever their names.
    """
    tag, pos, value = names
    packed = F.array(*[F.struct(F.lit(f).alias("t"), split_values(F.col(f)).alias("v")) for f in fields])
    one = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(packed).alias("_f")).where(F.size("_f.v") >= at_least)
    out = one.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_f.t").alias(tag), F.posexplode("_f.v").alias("_p", value))
    return out.select(*keys, tag, (F.col("_p") + 1).cast("int").alias(pos), value)
