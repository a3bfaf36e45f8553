"""Variant spellings of the names of persons and firms linked to each other.

Names are folded (case, accents, umlauts written out), side words (legal forms, titles, joining words, words of the trade)
are set aside, and short forms of given names are brought to the full one. What is left are the name's own words, in any
order; a single letter stands for every word it begins.

Names of one group and place are compared with each other. A name whose place is unknown is compared with the names of its
group that share a key of a word (see ``name_keys``), which every pair that can be accepted does. Both are done in blocks by
the bags of letters of names and words, as bits, which rule out nearly all pairs and none that can be accepted. A candidate is verified on the
whole names by soft token similarity: words are assigned to each other at the least cost in edits (swapped neighbours count once), every word must be
similar, and the mean similarity, weighted so that rare words count more, must reach a threshold. Names are compared once
per distinct spelling; nodes are only attached to the links that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

# Side words by sort, and short forms of given names.
LEGAL = "gmbh sarl ltd inc llc ag kg sa"
TITLES = "dr prof"
TRADES = (
    "law office off architecture studio arch survey company co veterinary vet clinic insurance agency agcy ins dental practice pract "
    "engineering bureau eng bur tax advisory adv translation service transl serv"
)
BUILDINGS = "house campus centre forum contor"
SHORT_FORMS = (
    "vally valentina|minna wilhelmina|dora theodora|otto ottokar|nastja anastasia|lisa elisabeth|rike friederike|tina christina|greg gregorius|"
    "dikt benedikt|kosta konstantin|klaus nikolaus|kaethe katharina|josy josephine|ulli ursulina|leo leonhard|bill william|bobbie robertine|"
    "nelly penelope|sascha alexander|greta margarete|leni magdalena|basti sebastian|hannes johannes|bob robert|liz elizabeth|peggy margaret|"
    "jack john|dick richard|ted edward|tony anthony|sepp josef|hans johann|fritz friedrich|heinz heinrich|toni anton|gustl august|resi theresia"
)

_ACCENTED, _PLAIN = "áàâãåçéèêëíìîïñóòôõøúùûýÿśšžćčłńřťďě", "aaaaaceeeeiiiinooooouuuyysszcclnrtde"


def folded(c: Column) -> Column:
    s = F.lower(c)
    for letter, base in zip("äöü", "aou", strict=True):
        s = F.replace(F.replace(s, F.lit(letter), F.lit(f"{base}e")), F.lit(f"{base}\u0308"), F.lit(f"{base}e"))
    s = F.replace(s, F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(s, _ACCENTED, _PLAIN), r"\p{M}", "")


def name_words(c: Column) -> Column:
    """The name's own words, sorted; an empty array where there are none or the last word is that of a building."""
    s = F.regexp_replace(folded(c), rf"\band partners\b|\be\.\s?v\b\.?|\b({'|'.join((LEGAL + ' ' + TITLES + ' ' + TRADES).split())})\b\.?", " ")
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{N}]{2})\s*(?:[&+]|\bu\.|\bund\b|\band\b)\s*(?=[\p{L}\p{N}]{2})", " & ")
    words = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    short = dict(p.split() for p in SHORT_FORMS.split("|"))
    table = F.create_map(*[F.lit(x) for p in short.items() for x in p])
    full = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    building = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*BUILDINGS.split()), F.lit(False))
    return F.when(building, F.array().cast("array<string>")).otherwise(F.array_sort(full))


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs, swapped neighbours counting once; the arrays run over the pairs."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    m, n = int(la.max(initial=0)), int(lb.max(initial=0))
    grid = lambda words, k: np.array(memoryview("".join(w.ljust(k, "\0") for w in words).encode("utf-32-le", "surrogatepass")).cast("i"), np.int32).reshape(len(words), k)
    x, y = grid(a, m), grid(b, n)
    rows = [np.tile(np.arange(n + 1, dtype=np.int32), (len(a), 1))]
    out = np.where(la == 0, lb, 0)
    for i in range(1, m + 1):
        row = np.empty((len(a), n + 1), np.int32)
        row[:, 0] = i
        up = rows[-1]
        for j in range(1, n + 1):
            best = np.minimum(np.minimum(up[:, j], row[:, j - 1]) + 1, up[:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swap, np.minimum(best, rows[-2][:, j - 2] + 1), best)
            row[:, j] = best
        rows.append(row)
        rows = rows[-2:]
        done = la == i
        if done.any():
            out[done] = row[done, lb[done]]
    return out


#: Edits and similarity that count for a word the other name does not have, and the edits for a lone letter.
UNMATCHED, UNMATCHED_SIMILARITY, UNMATCHED_LETTER = 1.0, 0.5, 0.5
#: Edits up to which two words of one name written as one are taken for a word of the other ("Karl-Heinz", "Karlheinz").
JOINED = 2
_SHORTER: dict[str, list[str]] = {}
for _short, _full in (p.split() for p in SHORT_FORMS.split("|")):
    _SHORTER.setdefault(_full, []).append(_short)


def assigned(cost: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least sum (Hungarian method); there are at least as many columns as rows."""
    n, m = len(cost), len(cost[0])
    u, v, row, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row[j0]:
            used[j0], delta, j1 = True, float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    d = cost[row[j0] - 1][j - 1] - u[row[j0]] - v[j]
                    if d < least[j]:
                        least[j], way[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row[j]], v[j] = u[row[j]] + delta, v[j] - delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row[j0] = row[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row[j]:
            out[row[j] - 1] = j - 1
    return out


def joined(p: str, q: str) -> list[str]:
    """Two words of a name written as one, in either order, given names also in their short forms."""
    forms = [(x, y) for x in (p, *_SHORTER.get(p, ())) for y in (q, *_SHORTER.get(q, ()))]
    return [x + y for x, y in forms] + [y + x for x, y in forms]


def _rests(b: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """The ways of taking two full words out of a name: (words left, the two written as one)."""
    for i in range(len(b)):
        for j in range(i + 1, len(b)):
            if len(b[i]) > 1 and len(b[j]) > 1:
                yield [*b[:i], *b[i + 1 : j], *b[j + 1 :]], joined(b[i], b[j])


def compared(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of words whose edits ``similarity`` may ask for."""
    if len(a) > len(b):
        a, b = b, a
    yield from ((p, q) for p in a for q in b)
    if len(b) > len(a):
        near = lambda p, q: abs(len(p) - len(q)) <= JOINED
        yield from ((p, q) for _, forms in _rests(b) for q in forms for p in a if near(p, q))


def similarity(a: list[str], b: list[str], wa: dict[str, float], cost: dict[tuple[str, str], int]) -> tuple[float, float, float]:
    """(cost in edits, weighted similarity, least similarity of a word) of the best assignment of two names' words.

    Every word of the name with fewer words is assigned; words left over in the other cost ``UNMATCHED`` edits each and
    count as half alike, unless two of them are one word of the other name. A single word is never a name of several.
    """
    if a == b:
        return 0.0, 1.0, 1.0
    if len(a) > len(b):
        a, b = b, a

    def pair(p: str, q: str) -> tuple[float, float]:
        if len(p) == 1 or len(q) == 1:
            return (0.0 if p == q else 0.5, 1.0 if p == q else 0.8) if p[0] == q[0] else (99.0, 0.0)
        d = cost[p, q] if (p, q) in cost else cost[q, p]
        return d, 1 - d / max(len(p), len(q))

    best = (float("inf"), 0.0, 0.0)
    if len(a) == len(b) or len(a) > 1:
        table = [[pair(p, q) for q in b] for p in a]
        # of assignments with equal edits, the more similar
        order = assigned([[d + 1e-6 * (1 - s) for d, s in line] for line in table])
        total = sims = weights = 0.0
        least = 1.0
        for i, j in enumerate(order):
            d, s = table[i][j]
            w = max(wa.get(a[i], 0.0), wa.get(b[j], 0.0))
            total, sims, weights, least = total + d, sims + w * s, weights + w, min(least, s)
        for j in set(range(len(b))) - set(order):
            w = wa.get(b[j], 0.0)
            total, sims, weights = total + (UNMATCHED if len(b[j]) > 1 else UNMATCHED_LETTER), sims + w * UNMATCHED_SIMILARITY, weights + w
        best = (total, sims / weights if weights else 0.0, least)
    if len(b) > len(a):
        for rest, forms in _rests(b):
            for q in forms:
                for i, p in enumerate(a):
                    if abs(len(p) - len(q)) > JOINED or len(p) < 2:
                        continue
                    d, s = pair(p, q)
                    if d > JOINED:
                        continue
                    left = [*a[:i], *a[i + 1 :]]
                    if not left:
                        if rest:
                            continue
                        total, score, least = d, s, s
                    else:
                        total, score, least = similarity(left, rest, wa, cost)
                        own = wa.get(p, 0.0)
                        others = sum(max(0.0, wa.get(x, 0.0)) for x in rest)
                        total, score, least = total + d, (score * others + own * s) / (others + own) if others + own else 0.0, min(least, s)
                    if total < best[0]:
                        best = (total, score, least)
    return best


def _many_edits(open_pairs: list[tuple[str, str]]) -> list[int]:
    order = sorted(range(len(open_pairs)), key=lambda k: max(map(len, open_pairs[k])))
    out, at = [0] * len(order), 0
    while at < len(order):
        # long words in smaller parts, so that memory stays the same
        longest = max(map(len, open_pairs[order[min(at + 4999, len(order) - 1)]]))
        part = order[at : at + max(1, min(5000, 250_000 // max(1, longest)))]
        for k, d in zip(part, edits([open_pairs[k][0] for k in part], [open_pairs[k][1] for k in part]).tolist(), strict=True):
            out[k] = d
        at += len(part)
    return out


def _two_by_two(a: list[list[str]], b: list[list[str]], wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``similarity`` of pairs of names of two full words each, as rows; and where both assignments are equally good, which is left to it."""
    words, code = np.unique(np.array([w for x in (a, b) for name in x for w in name], object), return_inverse=True)
    ca, cb = code.reshape(2, len(a), 2)
    met = ca[:, :, None] * len(words) + cb[:, None, :]
    pairs, at = np.unique(met, return_inverse=True)
    u, v = pairs // len(words), pairs % len(words)
    d, other = np.zeros(len(pairs)), np.flatnonzero(u != v)
    d[other] = _many_edits([(words[x], words[y]) for x, y in zip(u[other], v[other], strict=True)])
    size = np.array([len(w) for w in words])
    s = (1 - d / np.maximum(size[u], size[v]))[at].reshape(met.shape)
    d = d[at].reshape(met.shape)
    w = np.maximum(wa[:, :, None], wb[:, None, :])
    cost = d + 1e-6 * (1 - s)
    straight, crossed = cost[:, 0, 0] + cost[:, 1, 1], cost[:, 0, 1] + cost[:, 1, 0]
    each = lambda t: np.where((straight < crossed)[:, None], t[:, (0, 1), (0, 1)], t[:, (0, 1), (1, 0)])
    d, s, w = each(d), each(s), each(w)
    weight = w.sum(1)
    score = np.divide((w * s).sum(1), weight, out=np.zeros(len(a)), where=weight != 0)
    return np.stack((d.sum(1), score, s.min(1)), axis=1), np.abs(straight - crossed) < 1e-9


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        names_a, names_b = [list(x) for x in b["a"]], [list(x) for x in b["b"]]
        out = np.zeros((len(b), 3))
        usual = lambda x: len(x) == 2 and len(x[0]) > 1 and len(x[1]) > 1
        at = np.array([usual(p) and usual(q) for p, q in zip(names_a, names_b, strict=True)], bool)
        rows = np.flatnonzero(at)
        if len(rows):
            out[rows], equal = _two_by_two([names_a[k] for k in rows], [names_b[k] for k in rows], np.stack(b["wa"].to_numpy()[rows]), np.stack(b["wb"].to_numpy()[rows]))
            at[rows[equal]] = False
        pairs: dict[tuple[str, str], int] = {}
        rest = np.flatnonzero(~at).tolist()
        for k in rest:
            for u, v in compared(names_a[k], names_b[k]):
                if (u, v) not in pairs and (v, u) not in pairs:
                    pairs[u, v] = 0 if u == v else max(len(u), len(v))
        open_pairs = [k for k, d in pairs.items() if d]
        pairs.update(zip(open_pairs, _many_edits(open_pairs), strict=True))
        for k in rest:
            p, q = names_a[k], names_b[k]
            out[k] = similarity(p, q, dict(zip([*p, *q], [*b["wa"].iat[k], *b["wb"].iat[k]], strict=True)), pairs)
        yield pd.DataFrame({"na": b["na"], "nb": b["nb"], "edits": out[:, 0], "score": out[:, 1], "least": out[:, 2]})


#: Bits of a word's letters: so many places each, the rest for all other characters.
_PLACES = {c: 3 if c in "aeiou" else 2 for c in "abcdefghijklmnopqrstuvwxyz"}
_BIT = dict(zip(_PLACES, np.cumsum([0, *_PLACES.values()]).tolist()[:-1], strict=True))
_OTHER = sum(_PLACES.values())
#: Pairs of names that a task looks at in one go, and pairs of a block above which it is cut into tiles.
_ROOM, _TILE = 1_000_000, 400_000_000
#: Pairs of a block up to which it is looked at together with others.
_SMALL = 10_000


def letter_bits(text: str) -> int:
    """A bag of letters as 64 bits. One edit takes at most one bit away and adds at most one, swaps none."""
    bits = 0
    for c in set(text):
        if c in _BIT:
            bits |= ((1 << min(text.count(c), _PLACES[c])) - 1) << _BIT[c]
        else:
            bits |= 1 << _OTHER + ord(c) % (64 - _OTHER)
    return bits - (1 << 64) if bits >> 63 else bits


def _cuts(x: str) -> set[str]:
    return {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}


def word_keys(x: str) -> set[str]:
    """Two words at most one edit apart have one of these in common.

    The edit leaves the first letters alone or the last ones; short words meet by what is left without one letter. Words
    of a length between two of these ways have the keys of both.
    """
    n, keys = len(x), set()
    if n >= 7:
        keys |= {f"L{x[:3]}", f"R{x[-3:]}"}
    if 5 <= n <= 7:
        keys |= {f"l{x[:2]}", f"r{x[-2:]}"}
    if n <= 5:
        keys |= {f"D{v}" for v in _cuts(x)}
    return keys


def half_keys(x: str) -> set[str]:
    """Two words at most three edits apart have one of these in common.

    Of nine letters and more, the first four or the last four suffer one edit at most, as no swap touches both.
    """
    long = {*(f"H{v}" for v in _cuts(x[:4])), *(f"T{v}" for v in _cuts(x[-4:]))} if len(x) >= 6 else set()
    return long | ({"S"} if len(x) <= 8 else set())


_FULL_OF_CUT: dict[str, set[str]] = {}
for _full, _shorts in _SHORTER.items():
    for _cut in set().union(*map(_cuts, _shorts)):
        _FULL_OF_CUT.setdefault(_cut, set()).add(_full)


def piece_keys(x: str) -> set[str]:
    """If ``x`` is at most two edits from two words written as one, one of these is also in the ``word_keys`` of one of the two.

    One of the two words is at most an edit from the start or the end of ``x``; given names may be in their short forms.
    """
    pieces = {p for i in range(1, len(x)) for p in (x[:i], x[i:])}
    full = {f for p in pieces for c in _cuts(p) for f in _FULL_OF_CUT.get(c, ())}
    return {k for p in pieces | full | {x} for k in word_keys(p)}


def name_keys(words: list[str], far: float) -> set[str]:
    """Two names that can be accepted with at most ``far`` edits have one of these in common; "I" is for initials.

    Of two pairs of full words, one has half the edits at most. If there is only one such pair, an initial stands for
    a word, or a name is a single word.
    """
    full = [w for w in words if len(w) > 1]
    if not full:
        return set()
    if far >= 4:
        return {""}
    if len(words) == 1:
        return half_keys(words[0]) | piece_keys(words[0])
    twos = [q for _, forms in _rests(words) for q in forms] if len(words) > 2 else []
    return {k for w in [*full, *twos] for k in word_keys(w)} | {f"I{w[0]}" for w in words}


def _signed(far: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}

        def bits(w: str) -> int:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = letter_bits(w)
            return known[w]

        mask = lambda ws: sum({1 << ord(w[0]) % 63 for w in ws})
        for b in batches:
            if not len(b):
                continue
            out = []
            for ws in map(list, b["words"]):
                full = [w for w in ws if len(w) > 1]
                own = letter_bits("".join(full))
                whole = letter_bits("".join([*ws, *(s for w in ws for s in _SHORTER.get(w, ()))])) if len(full) < len(ws) or len(ws) != 2 or any(w in _SHORTER for w in ws) else own
                one, two = (bits(ws[0]), bits(ws[1])) if len(ws) == 2 else (0, 0)
                keys = name_keys(ws, far)
                out.append((len(ws), own, whole, one, two, mask(full), mask([w for w in ws if len(w) == 1]), sum((len(w) == 1) << i for i, w in enumerate(ws[:2])), [k for k in keys if k[:1] != "I"], [k for k in keys if k[:1] == "I"]))
            kinds = ["k", "own", "whole", "one", "two", "firsts", "lone", "which", "keys", "initials"]
            yield pd.concat([b[["g", "n", "unplaced", "places"]].reset_index(drop=True), pd.DataFrame(out, columns=kinds)], axis=1)

    return run


_BITS = ("own", "whole", "one", "two")
_COLUMNS = ("kind", "n", "k", *_BITS, "firsts", "lone", "which", "asks", "told")


class _Blocks:
    """Names by the key they share, and which pairs of a block their letters do not rule out; ``starts`` has the first row of each."""

    def __init__(self, b: np.ndarray, starts: np.ndarray, near: float, far: float):
        for c, values in zip(_COLUMNS, b.T, strict=True):
            setattr(self, c, np.ascontiguousarray(values.view(np.uint64) if c in _BITS else values))
        self.starts, self.sizes = starts, np.diff([*starts, len(b)])
        self.most, self.initials = np.where(self.kind > 0, int(far), int(near)), self.kind == 2
        # two full words; two words, initials among them; others
        self.sort = np.where(self.k != 2, 2, (self.lone != 0).astype(int))

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)).astype(np.float32)

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # where both ask, the pair comes in either order
        ok = (self.n[i] != self.n[j]) & ((self.n[i] < self.n[j]) | (self.asks[j] & self.told[i] == 0))
        i, j = i[ok], j[ok]
        ok = ~self.initials[i] | (self.lone[i] != 0) | (self.lone[j] != 0)
        i, j = i[ok], j[ok]
        # the letters of the name with fewer words are in the other, unless an initial may stand for one of its words
        for turned in (False, True):
            x, y = (j, i) if turned else (i, j)
            out = (self.k[x] <= self.k[y]) & ((self.lone[y] & self.firsts[x]) == 0) & (np.bitwise_count(self.own[x] & ~self.whole[y]) > self.most[x])
            i, j = i[~out], j[~out]
        two = (self.k[i] == 2) & (self.k[j] == 2)
        at = np.flatnonzero(two)
        x, y = i[at], j[at]
        sums = []
        for p, q in (((0, 0), (1, 1)), ((0, 1), (1, 0))):
            total, full = np.zeros(len(at), np.float32), np.zeros(len(at), bool)
            for u, v in (p, q):
                a, b = (self.one, self.two)[u][x], (self.one, self.two)[v][y]
                la, lb = (self.which[x] >> u) & 1, (self.which[y] >> v) & 1
                # an initial's letter is at least somewhere in the word
                short = np.where(la == 1, a & ~b, b & ~a) != 0
                total += np.where(la | lb, np.where(short, 99, np.where(la & lb, 0, 0.5)), self.near(a, b))
                full |= (la | lb) == 0
            sums.append(np.where(full, total, 99))
        good = np.ones(len(i), bool)
        good[at] = np.minimum(*sums) <= self.most[x]
        return i[good], j[good]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = np.add.reduceat(self.asks, self.starts)
        large = asks * self.sizes > _SMALL
        for k in np.flatnonzero(large):
            yield from self._dense(np.arange(self.starts[k], self.starts[k] + self.sizes[k]))
        # all small blocks together
        own = np.repeat(np.arange(len(self.starts)), self.sizes)
        i = np.flatnonzero((self.asks != 0) & ~large[own] & (self.sizes[own] > 1))
        done = np.cumsum(self.sizes[own[i]])
        for part in np.split(i, np.searchsorted(done, np.arange(_ROOM, done[-1], _ROOM))) if len(i) else ():
            if len(part):
                many = self.sizes[own[part]]
                u = np.repeat(part, many)
                v = np.repeat(self.starts[own[part]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                told = self.told[v] != 0
                yield self.possible(u[told], v[told])

    def _dense(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most, initials = self.most[rows[0]], self.initials[rows[0]]
        for s in range(3):
            for t in range(3):
                if initials and s == t == 0:
                    continue
                us, vs = rows[(self.asks[rows] != 0) & (self.sort[rows] == s)], rows[(self.told[rows] != 0) & (self.sort[rows] == t)]
                if not len(us) or not len(vs):
                    continue
                many = max(1, _ROOM // len(vs))
                for at in range(0, len(us), many):
                    u = us[at : at + many]
                    if s == t == 0:
                        open_ = np.bitwise_count(self.own[u][:, None] & ~self.own[vs]) <= most
                    elif s == 1 and t == 0:
                        open_ = np.bitwise_count(self.own[u][:, None] & ~self.whole[vs]) <= most
                    elif s == 0 and t == 1:
                        open_ = np.bitwise_count(~self.whole[u][:, None] & self.own[vs]) <= most
                    else:
                        open_ = np.ones((len(u), len(vs)), bool)
                    i, j = np.nonzero(open_)
                    yield self.possible(u[i], vs[j])


def _met(near: float, far: float):
    """Pairs of names of each block; the rows come sorted by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            keys, values = b[["block", "row", "column"]].to_numpy(np.int64), b[list(_COLUMNS)].to_numpy(np.int64)
            # the last block may go on in the next batch
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if held and ((keys[0] != held[-1][0][-1]).any() or len(new)):
                end = 0 if (keys[0] != held[-1][0][-1]).any() else new[0]
                out += whole([*held, (keys[:end], values[:end])])
                keys, values, held = keys[end:], values[end:], []
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if len(new):
                out += whole([(keys[: new[-1]], values[: new[-1]])])
                keys, values = keys[new[-1] :], values[new[-1] :]
            held.append((keys, values))
            if sum(map(len, out)) > 50_000:
                yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["na", "nb"])
                out = []
        if held:
            out += whole(held)
        if out:
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["na", "nb"])

    def whole(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        keys, values = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        found = _Blocks(values, np.array([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)]), near, far)
        for i, j in found.pairs():
            x, y = found.n[i], found.n[j]
            yield np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1)

    return run


def candidates(spelt: DataFrame, near: float, far: float) -> DataFrame:
    """Pairs (na, nb) of names that may be accepted, of ``spelt``: g, n, words, unplaced (some holder's place is unknown), places.

    Names of one place are compared with each other. A name with an unknown place asks all names of its group that it shares
    one of ``name_keys`` with. Within these blocks every pair is looked at by the bits of its letters. A block of very many
    pairs is cut into tiles.
    """
    kinds = "g string, n long, unplaced boolean, places array<string>, k int, own long, whole long, one long, two long, firsts long, lone long, which int, keys array<string>, initials array<string>"
    signed = kept(spelt.select("g", "n", "unplaced", "places", "words").mapInPandas(_signed(far), kinds))
    signed = signed.where(F.col("firsts") != 0)
    block = lambda kind, keys, asks: F.transform(keys, lambda x: F.struct(F.xxhash64("g", F.lit(kind), x).alias("block"), F.lit(kind).alias("kind"), asks.alias("asks")))
    blocks = F.concat(block(0, F.col("places"), F.lit(True)), block(1, F.col("keys"), F.col("unplaced")), block(2, F.col("initials"), F.col("unplaced")))
    names = ["n", "k", "own", "whole", "one", "two", "firsts", "lone", "which"]
    placed = signed.select(*names, F.inline(blocks))
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("ask"))
    side = lambda c: F.ceil(F.col(c) / F.lit(float(_TILE) ** 0.5)).cast("int")
    # at most one in 20,000 rows
    large = sizes.where((F.col("ask") > 0) & ((F.col("all") * F.col("ask") > _TILE) | (F.col("all") > 200_000))).select("block", side("all").alias("rows"), side("ask").alias("columns"))
    tiled = placed.join(F.broadcast(large), "block", "left").withColumn("rows", F.coalesce("rows", F.lit(1))).withColumn("columns", F.coalesce("columns", F.lit(1)))
    spot = lambda many: F.pmod(F.xxhash64("n"), many).cast("int")
    upto = lambda many: F.sequence(F.lit(0), many - 1)
    tile = lambda row, column, asks, told: F.struct(row.alias("row"), column.alias("column"), asks.alias("asks"), told.alias("told"))
    rows, columns, asks, yes, no = F.col("rows"), F.col("columns"), F.col("asks"), F.lit(True), F.lit(False)
    told = F.transform(upto(columns), lambda c: tile(spot(rows), c, no, yes))
    asking = F.transform(upto(rows), lambda r: tile(r, spot(columns), yes, no))
    only = F.array(tile(F.lit(0), F.lit(0), asks, yes))
    tiles = F.when((rows == 1) & (columns == 1), only).otherwise(F.concat(told, F.when(asks, asking).otherwise(F.slice(asking, 1, 0))))
    spread = tiled.select("block", "kind", *names, F.inline(tiles)).repartition("block", "row", "column").sortWithinPartitions("block", "row", "column")
    return spread.mapInPandas(_met(near, far), "na long, nb long").distinct()


def links(
    records: DataFrame, group: str, key: str, place: str, names: str, near: float = 4.0, far: float = 3.0, score: float = 0.7, least: float = 0.5,
) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of records of one ``group`` of which some names mean the same.

    ``names`` is an array; ``place`` tells records apart: with equal places up to ``near`` edits are allowed, with one
    unknown up to ``far``, and records of different places are not linked. Equal names are linked too. Null groups, keys and
    names, and names without words of their own, take no part. An initial alone is no reason to link: two different names
    need a full word each that are like each other.
    """
    flat = records.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(place).alias("place"), F.explode(names).alias("name"))
    rows = kept(flat.select("g", "id", "place", name_words(F.col("name")).alias("words")).where(F.size("words") > 0).distinct().withColumn("n", F.xxhash64("g", "words")))
    spelt = rows.groupBy("n").agg(F.first("g").cast("string").alias("g"), F.first("words").alias("words"), F.max(F.col("place").isNull()).alias("unplaced"), F.collect_set(F.col("place").cast("string")).alias("places"))
    pairs = kept(candidates(spelt, near, far))

    each = rows.select("n", "words").distinct()
    total = each.count()  # one number
    worded = each.select("n", "words", F.explode(F.array_distinct("words")).alias("w"))
    df = worded.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    asked = pairs.select(F.explode(F.array("na", "nb")).alias("n")).distinct()
    weighed = worded.join(df, "w").join(asked, "n").withColumn("weight", F.log1p(F.lit(float(max(total, 1))) / F.col("df")))
    weights = weighed.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("w", "weight"))).alias("m"), F.first("words").alias("words"))
    weights = weights.select("n", "words", F.transform("words", lambda w: F.col("m")[w]).alias("ws"))
    full = pairs.join(weights.select(F.col("n").alias("na"), F.col("words").alias("a"), F.col("ws").alias("wa")), "na")
    full = full.join(weights.select(F.col("n").alias("nb"), F.col("words").alias("b"), F.col("ws").alias("wb")), "nb")
    checked = full.select("na", "nb", "a", "b", "wa", "wb").mapInPandas(_verified, "na long, nb long, edits double, score double, least double")
    good = checked.where((F.col("edits") <= near) & (F.col("score") >= score) & (F.col("least") >= least))

    same = each.select(F.col("n").alias("na"), F.col("n").alias("nb"), F.lit(0.0).alias("edits"))
    alike = good.select("na", "nb", "edits").unionByName(same)
    held = rows.select("n", "id", "place")
    x = alike.join(held.select(F.col("n").alias("na"), F.col("id").alias("ia"), F.col("place").alias("pa")), "na")
    y = x.join(held.select(F.col("n").alias("nb"), F.col("id").alias("ib"), F.col("place").alias("pb")), "nb")
    apart = (F.col("ia") != F.col("ib")) & ((F.col("na") != F.col("nb")) | (F.col("ia") < F.col("ib")))
    allowed = F.when(F.col("pa").isNull() | F.col("pb").isNull(), F.col("edits") <= far).otherwise(F.col("pa") == F.col("pb"))
    return y.where(apart & allowed).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
