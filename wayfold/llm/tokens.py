"""Sizes of texts in tokens of a public tokenizer, read from its rank file and never trained.

The folder of vocabulary files is a parameter (or the setting ``wayfold.tokenizers`` of the session). It must be there on
every executor, like any installed package.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"

# Fixed value: how this public vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts go to the tokenizer in cuts of about this many characters at white space; only then does its cost stay in
#: proportion. A cut falls before a single blank that stands between two non-blanks, where the pattern cuts anyway.
CUT = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cuts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > CUT:
        at = start + CUT
        while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def count(text: str, path: str) -> int:
    e = _encoding(path)
    if len(text) <= CUT:
        return len(e.encode_ordinary(text))
    return sum(len(e.encode_ordinary(c)) for c in _cuts(text))


def n_tokens(text: Column, folder: str | None = None, file: str = FILE) -> Column:
    """Tokens of a text; 0 for an empty one, null for null."""
    path = f"{folder or setting()}/{file}"

    @F.pandas_udf(T.LongType())
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else count(t, path)).astype("Int64")

    return sizes(text)


def setting() -> str:
    s = SparkSession.getActiveSession()
    return s.conf.get("wayfold.tokenizers", FOLDER) if s else FOLDER
