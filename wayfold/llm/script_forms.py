"""One written form for texts that look alike in print.

Method: every token is looked at as a whole. For each of its letters the set of scripts is resolved in which a letter of
that shape exists; the intersection over the token tells whether one script can spell it all. A token that mixes scripts,
or whose letters all have look-alikes in another script, is brought to the spelling of one consistent script; what is left
(letter width, ligatures, combining marks, blanks, invisible characters, hyphens) is normalised. Letters of different
shape are never brought together, nor are letters with different accents or of different case.

The work is done once per distinct value; only values with a character outside plain ASCII need Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of the same printed shape, Latin first, then Cyrillic and Greek where they have one ("" if not).
LOOK_ALIKES = """
A А Α|B В Β|C С Ϲ|E Е Ε|F - Ϝ|H Н Η|I І Ι|J Ј Ϳ|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y Ү Υ|Z - Ζ
a а -|c с ϲ|e е -|h һ -|i і -|j ј ϳ|o о ο|p р -|q ԛ -|s ѕ -|w ԝ -|x х -|y у -|v ѵ ν|d ԁ -|l ӏ -
- Г Γ|- П Π|- Ф Φ|- ф φ
"""
# Letters of further scripts with the shape of a Latin one.
FURTHER = {
    "armenian": "Օ O|օ o|հ h|ո n|ս u|Տ S|զ q",
    "cherokee": "Ꭺ A|Ᏼ B|Ꮯ C|Ꭰ D|Ꭼ E|Ꮐ G|Ꮋ H|Ꭻ J|Ꮶ K|Ꮮ L|Ꮇ M|Ꮲ P|Ꮪ S|Ꭲ T|Ꮩ V|Ꮃ W|Ꮓ Z",
    "coptic": "Ⲁ A|Ⲃ B|Ⲥ C|Ⲏ H|Ⲓ I|Ⲕ K|Ⲙ M|Ⲛ N|Ⲟ O|ⲟ o|Ⲣ P|Ⲧ T|Ⲩ Y|Ⲭ X|ⲥ c",
}
# Characters that are printed like the letters they stand for (width, ligatures, digraphs, Roman numerals).
PRINTED_ALIKE = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFF01, 0xFFEE))
# Blanks of any width; characters that print nothing; hyphens of one printed length.
BLANKS = "".join(map(chr, (0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x206A), 0xFEFF)))
HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0xFE63, 0xFF0D)))

SCRIPTS = ("latin", "cyrillic", "greek", *FURTHER)


def _tables() -> tuple[dict[str, frozenset], dict[tuple[str, str], str]]:
    scripts: dict[str, frozenset] = {}
    to: dict[tuple[str, str], str] = {}
    further = {s: {latin: c for c, latin in (p.split() for p in text.split("|"))} for s, text in FURTHER.items()}
    for group in LOOK_ALIKES.replace("\n", "|").split("|"):
        if not group.strip():
            continue
        row = {s: c for s, c in zip(SCRIPTS, group.split(), strict=False) if c != "-"}
        row |= {s: c for s, table in further.items() if (c := table.get(row.get("latin", ""))) is not None}
        _enter(row, scripts, to)
    for s, table in further.items():  # letters whose Latin one has no look-alike above
        for latin, c in table.items():
            if c not in scripts:
                _enter({"latin": latin, s: c}, scripts, to)
    return scripts, to


def _enter(row: dict[str, str], scripts: dict[str, frozenset], to: dict[tuple[str, str], str]) -> None:
    there = frozenset(row) | scripts.get(row.get("latin", ""), frozenset())
    full = {s: to[row["latin"], s] for s in scripts.get(row.get("latin", ""), ())} | row
    for c in full.values():
        scripts[c] = there
        for s, spelt in full.items():
            to[c, s] = spelt


_SHAPE_SCRIPTS, _SPELT = _tables()
_STRIP = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS}


@lru_cache(maxsize=8192)
def _own_script(c: str) -> str | None:
    """Script of a letter; None for what belongs to all scripts."""
    if not c.isalpha():
        return None
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), name.split(" ")[0].lower() or None)


def _resolved(c: str) -> frozenset | None:
    if c in _SHAPE_SCRIPTS:
        return _SHAPE_SCRIPTS[c]
    own = _own_script(c)
    return None if own is None else frozenset((own,))


def _token(token: str) -> str:
    """Spelling of a token in one script, if one script has all its shapes, else letter by letter in the first that has it."""
    possible = None
    for c in token:
        r = _resolved(c)
        if r is not None:
            possible = r if possible is None else possible & r
    if possible:
        script = next((s for s in SCRIPTS if s in possible), None)
        return token if script is None else "".join(_SPELT.get((c, script), c) for c in token)
    return "".join(_SPELT.get((c, next(s for s in SCRIPTS if s in _SHAPE_SCRIPTS[c])), c) if c in _SHAPE_SCRIPTS else c for c in token)


def printed_form(text: str | None) -> str | None:
    """The form that stands for all texts which look like ``text`` in print; null gives null."""
    if text is None:
        return None
    wide = "".join(unicodedata.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in PRINTED_ALIKE) else c for c in text.translate(_STRIP))
    shapes = unicodedata.normalize("NFD", wide.translate(_STRIP))
    return unicodedata.normalize("NFC", " ".join(_token(t) for t in shapes.strip().split(" ")))


@F.pandas_udf(T.StringType())
def _printed(values: pd.Series) -> pd.Series:
    return values.map(printed_form, na_action="ignore")


def printed_form_column(c: Column) -> Column:
    """Printed form as a column. Plain ASCII never reaches Python: its form is the trimmed text itself."""
    odd = c.rlike(r"[^\x20-\x7e]")
    return F.coalesce(_printed(F.when(odd, c)), F.trim(c))


def look_alikes(fields: DataFrame, group: str, node: str, value: str) -> DataFrame:
    """Pairs of different nodes of one ``group`` whose values look the same in print but differ as stored.

    Columns: the group's name as in the input, ``id_a`` < ``id_b``. Null and empty values take no part; a node with several
    values counts with each; other columns are ignored. The printed form is found once per distinct value. Pairs are first
    made between the few spellings of one form and only then spread to their nodes, so nodes that share one spelling are
    never held against each other, however many they are.
    """
    rows = fields.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(value).alias("v")).where((F.length("v") > 0) & F.col("n").isNotNull())
    stored = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k")).select("g", "v", printed_form_column(F.col("v")).alias("form"))
    spellings = stored.groupBy("g", "form").agg(F.collect_list("v").alias("vs")).where(F.size("vs") > 1)
    a = spellings.select("g", "vs", F.explode("vs").alias("va"))
    pairs = a.select("g", "va", F.explode(F.filter("vs", lambda v: v > F.col("va"))).alias("vb"))
    left = pairs.join(rows.select("g", F.col("v").alias("va"), F.col("n").alias("na")), ["g", "va"])
    both = left.join(rows.select("g", F.col("v").alias("vb"), F.col("n").alias("nb")), ["g", "vb"]).where(F.col("na") != F.col("nb"))
    return both.select(F.col("g").alias(group), F.least("na", "nb").alias("id_a"), F.greatest("na", "nb").alias("id_b")).distinct()
