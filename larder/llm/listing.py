"""Reading product listings and notices: kind of food, flavour, variant, net content, number of units and coined names.

No word list tells what a word means: the vocabulary is learned from the catalogue itself (`learn`).

* A word is common if it stands in names of several firms, else it is coined: the name of a brand or product line. Words of notices
  are counted by the firms that recall, together with those of the names: a firm's own name stays one, whoever recalls its products.
* Neighbouring common words that mostly stand together are a phrase.
* Two phrases mean the same if listings of one product line use either, not both: where the one stands in a listing, the other one's
  rate in the line's other listings is near its own rate there. Other names, plurals, translations and short forms of a word all
  come out as one concept this way; a phrase whose rate is the same in every line (selling phrases, particles) means nothing.
* A concept that all listings of a line share is a kind of food. Of the others, a flavour shows in the ingredients, a variant
  does not; the variant whose lines name none most often is the plain one.
* Net contents are rounded when units are converted, so an amount close to one that is stated in metric units means that.

A word that was too rare to be learned is taken as an abbreviation of the vocabulary word with its first letter of which it
keeps the largest share of letters in order, if it is short of vowels.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.llm.text import fold, mend

#: A word is common from this many firms on (effective number, by which one firm's many listings count little).
FIRMS = 4.0
#: Least count of a phrase, share of its rarer word's listings that it makes up, and times by which its words stand together more
#: often than by chance.
LEAST, TOGETHER, LIFT = 5, 0.1, 3.0
#: Least share of all listings of lines for a phrase (beside LEAST), for a new concept (beside NEW), of all listings for a common
#: word (beside FIRMS), and of names that state a usual amount (beside 3): they bound the vocabulary for catalogues of any size.
LEAST_SHARE, NEW_SHARE, COMMON_SHARE, USUAL_SHARE = 5e-5, 2.5e-4, 1e-4, 3e-5
#: Times by which a concept, and a further phrase of one, is more frequent in lines that use it than elsewhere; least rate there.
STICKY, JOIN, OWN = 1.5, 1.5, 0.1
#: Share of a concept's own rate that a phrase of the same meaning reaches; least listings of a new concept.
SAME, NEW = 0.65, 25
#: Share of a phrase's listings that may have another phrase of the same meaning.
APART = 0.1
#: Share of the listings of its lines that use a kind of food.
KIND = 0.75
#: Share of listings that a flavour's ingredient has beyond that of all listings.
SHOWS = 0.4
#: Relative distance of amounts that are one amount, converted and rounded.
ROUNDED = 0.016

# Factors of units of mass and volume.
_FACTOR = {"g": ("g", 1.0), "kg": ("g", 1000.0), "mg": ("g", 0.001), "oz": ("g", 28.349523125), "lb": ("g", 453.59237), "ml": ("ml", 1.0), "cl": ("ml", 10.0), "dl": ("ml", 100.0), "l": ("ml", 1000.0), "floz": ("ml", 29.5735295625)}
_METRIC = ("g", "kg", "ml", "cl", "dl", "l")

_UNIT = r"(fl\.?\s*oz|fl\.?\s*ounces?|fluid\s*ounces?|kg|kilograms?|grams?|gr|g|ounces?|oz|lbs?|pounds?|milliliters?|millilitres?|ml|cl|dl|liters?|litres?|l)"
_SIZE = re.compile(rf"(?<![a-z0-9.])(?:(\d{{1,3}})\s*[x×]\s*)?(\d+(?:[.,]\d+)?)\s*{_UNIT}(?![a-z])\.?")
_COUNT = re.compile(r"\bpack of (\d{1,3})\b|\b(\d{1,3})\s*[- ]\s*pack\b|\b(\d{1,3})\s*(?:ct|count|pk|pcs)\b\.?|\bcase of (\d{1,3})\b")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+(?:'s)?")
_PIECE = re.compile(r"[^\W\d_]+(?:'s)?|[|,;():]")
_MARKS = re.compile(r"[®™©]")
_JOINED = re.compile(r"(?<=[a-z])-(?=[a-z])")
_ITEM = re.compile(r"[,;•]")
_SHARE = re.compile(r"\([^()]*\)|\*.*$|\.\s.*$|\.$")


def folded(name: str) -> str:
    """Folded name without trade marks; plain ASCII needs no more than lower case."""
    if name.isascii() and "&" not in name and "<" not in name:
        return name.lower()
    return fold(mend(_MARKS.sub(" ", name)))


@lru_cache(10_000)
def unit_of(u: str) -> str:
    """Symbol of a unit as written."""
    u = re.sub(r"[\s.]", "", u)
    if u.startswith("fl"):
        return "floz"
    return {"kilogram": "kg", "gram": "g", "gr": "g", "ounce": "oz", "lb": "lb", "pound": "lb", "milliliter": "ml", "millilitre": "ml", "liter": "l", "litre": "l"}.get(u.rstrip("s") if len(u) > 2 else u, u)


@lru_cache(100_000)
def measure(number: str, unit: str) -> tuple[str, float]:
    """g or ml, and the amount in it."""
    kind, factor = _FACTOR[unit_of(unit)]
    return kind, float(number.replace(",", ".")) * factor


def pieces(name: str) -> list[str]:
    """Words of a name in order, with marks between its parts; amounts and counts are left out."""
    t = folded(name)
    if _DIGIT.search(t):
        t = _COUNT.sub(" | ", _SIZE.sub(" | ", t))
    return _PIECE.findall(t.replace("-", " "))


def words_of(name: str | None, joined: bool = True) -> list[str]:
    """All words of a name; those joined by hyphens are one word if `joined`."""
    return _words(folded(name), joined) if name else []


def _words(text: str, joined: bool) -> list[str]:
    return _TOKEN.findall(_JOINED.sub("" if joined else " ", text) if "-" in text else text)


def item_of(text: str) -> tuple[str, int]:
    """An ingredient as written in a list, without shares, remarks and what stands before a colon, and its number above 0."""
    item = _SHARE.sub("", text.split(":")[-1]).strip()
    return item, int.from_bytes(hashlib.blake2b(item.encode(), digest_size=8).digest(), "big") >> 1 | 1


def items_of(ingredients: str | None) -> list[int]:
    """Numbers of the ingredients of a list, each once."""
    if not ingredients:
        return []
    # Entities and broken characters may hold or hide a mark between items; else items are folded one by one, and kept.
    whole = "&" in ingredients or "<" in ingredients or not ingredients.isascii() and mend(ingredients) != ingredients
    return sorted({x for numbers in map(_item_numbers, _ITEM.split(folded(ingredients) if whole else ingredients)) for x in numbers})


@lru_cache(200_000)
def _item_numbers(text: str) -> tuple[int, ...]:
    return tuple(number for item, number in map(item_of, _ITEM.split(folded(text))) if item)


class Vocabulary:
    """What the words of names mean. `phrases`: words to (role, code, weight); `common`: words that are no coined names; `usual`:
    amounts stated in metric units; `names`: (role, code) to the most frequent phrase; `plain`: code of the plain variant."""

    def __init__(self, phrases: dict[tuple[str, ...], tuple[str, int, float]], common: Iterable[str], usual: dict[str, Sequence[float]], plain: int = 0):
        self.phrases, self.common, self.plain = phrases, frozenset(common), plain
        self.usual = {k: tuple(sorted(v)) for k, v in usual.items()}
        self.words = frozenset(w for p in phrases for w in p)
        self.lengths = {w: sorted({len(p) for p in phrases if p[0] == w}, reverse=True) for w in {p[0] for p in phrases}}
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            self.by_letter[w[0]].append(w)

    def name(self, role: str, code: int) -> str:
        """The heaviest phrase of a concept (ties: the longest, then the first)."""
        return " ".join(min((p for p, (r, c, _) in self.phrases.items() if (r, c) == (role, code)), key=lambda p: (-self.phrases[p][2], -len(p), p)))


@lru_cache(100_000)
def firm_words(name: str | None) -> tuple[str, ...]:
    """All words of a brand or firm name."""
    return tuple(words_of(name))


def word_counts(rows: Iterable[tuple[str | None, str | None, str | None]], notices: bool = False) -> dict[tuple[str, str, str | None], list[int]]:
    """Counts of listings (name, brand, firm), or of notices (text, None, firm): (what, word, firm) to the number of listings and of
    those that have the word in their brand or firm name too. `what` is n (names), o and b (firm and brand names without their
    first word, which is the firm itself), t (texts of notices) or u (amounts in metric units, by the start of the name)."""
    counter = WordCounter(notices)
    for row in rows:
        counter.add(*row)
    return counter.counts()


class WordCounter:
    """Counts of `word_counts`: words are gathered as lists and counted as numbers."""

    def __init__(self, notices: bool = False):
        self.notices = notices
        self.firms: dict[str | None, int] = {}
        #: For each kind of text the words of its rows, and the number of words and the firm of each row; "" has words beside.
        self.words: dict[str, list[str]] = {w: [] for w in ("n", "o", "b", "t", "u", "")}
        self.rows: dict[str, tuple[list[int], list[int]]] = {w: ([], []) for w in self.words}

    def _gather(self, what: str, words: set[str] | tuple[str, ...], firm: int) -> None:
        self.words[what].extend(words)
        lengths, firms = self.rows[what]
        lengths.append(len(words))
        firms.append(firm)

    def add(self, name: str | None, brand: str | None, owner: str | None) -> None:
        b, o = firm_words(brand), firm_words(owner)
        firm = self.firms.setdefault(o[0] if o else b[0] if b else None, len(self.firms))
        if self.notices:
            self._gather("t", {*words_of(name, False)}, firm)
            return
        text = folded(name) if name else ""
        if (b or o) and text:
            words = {*_words(text, False)}
            self._gather("n", words, firm)
            beside = words.intersection(b) if b == o else words.intersection(b + o)
            if beside:
                self._gather("", beside, firm)
        if len(o) > 1:
            self._gather("o", {*o[1:]}, firm)
        if len(b) > 1:
            self._gather("b", {*b[1:]}, firm)
        if name and _DIGIT.search(name):
            amounts = _SIZE.findall(text)
            if amounts:
                self._gather("u", [f"{number} {unit}" for _, number, unit in amounts], self.firms.setdefault(name[:12], len(self.firms)))

    def _counted(self, what: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, and the number of a word, the firm and the count of each pair."""
        words = pa.array(self.words[what], pa.string()).dictionary_encode()
        lengths, firms = (np.array(x, np.int64) for x in self.rows[what])
        n = len(self.firms)
        word, of, firm = words.indices.to_numpy().astype(np.int64), words.dictionary, np.repeat(firms, lengths)
        if what == "u":  # amounts as written; those in metric units count
            meant = pa.array([_metric(*x.split(" ", 1)) for x in of.to_pylist()], pa.string()).dictionary_encode()
            number = meant.indices.fill_null(-1).to_numpy().astype(np.int64)[word]
            word, of, firm = number[number >= 0], meant.dictionary, firm[number >= 0]
        pairs, count = np.unique(word * n + firm, return_counts=True)
        return of, pairs // max(n, 1), pairs % max(n, 1), count

    def columns(self) -> tuple[pa.Array, ...]:
        """What has been added: what, word, firm, listings, beside."""
        firms = pa.array(list(self.firms), pa.string())
        out: list[list] = [[] for _ in range(5)]
        for what in ("n", "o", "b", "t", "u"):
            words, word, firm, count = self._counted(what)
            beside = np.zeros(len(count), np.int64)
            if what == "n":
                at = np.asarray(word * max(len(self.firms), 1) + firm)
                near, near_word, near_firm, n = self._counted("")
                # Words beside are words of names, so each has its number there.
                number = pc.index_in(near, words).to_numpy().astype(np.int64) if len(near) else np.empty(0, np.int64)
                beside[np.searchsorted(at, number[near_word] * max(len(self.firms), 1) + near_firm)] = n
            for to, x in zip(out, (pa.array([what] * len(count), pa.string()), words.take(pa.array(word)), firms.take(pa.array(firm)), pa.array(count.astype(np.int64)), pa.array(beside))):
                to.append(x)
        return tuple(pa.concat_arrays(x) for x in out)

    def counts(self) -> dict[tuple[str, str, str | None], list[int]]:
        """`columns` as one entry per what, word and firm."""
        what, word, firm, n, beside = (x.to_pylist() for x in self.columns())
        return {k: [x, y] for k, x, y in zip(zip(what, word, firm), n, beside)}


def _metric(number: str, unit: str) -> str | None:
    """An amount in metric units as text; null for others."""
    if unit_of(unit) not in _METRIC:
        return None
    kind, v = measure(number, unit)
    return f"{kind} {round(v, 3)!r}"


def common_of(counts: Iterable[tuple[str, str, int, int]]) -> tuple[set[str], set[str]]:
    """Common words, from (what, word, listings, those with it in brand or firm names too) of words with enough firms, and those of
    them that belong to brands: second words of brand names, company words."""
    of: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
    for what, word, there, beside in counts:
        of[what][word] = (there, beside)
    of_names, of_firms = set(of["n"]), {*of["o"], *of["b"]}
    house = {w for w, (there, beside) in of["n"].items() if beside * 3 >= there} | of_firms - of_names
    return of_names | of_firms | set(of["t"]), house


def learned_words(common: set[str], house: set[str]) -> list[str]:
    """Words whose meaning is learned: common ones that don't belong to brands."""
    return sorted(w for w in common if w not in house and w[0].isalpha())


def line_tokens(name: str, around: set[str], common: set[str], number: dict[str, int]) -> tuple[str, list[int]] | None:
    """The line of a listing and the numbers of its learned words in order, -1 for others; null without a line."""
    t = pieces(name)
    names = {w for w in {*t}.difference(common, around) if len(w) > 2 and w[0].isalpha()}
    return (names.pop(), [*map(number.get, t, repeat(-1))]) if len(names) == 1 else None


def known_phrases(listings: int, one: dict[int, int], two: dict[int, int], three: dict[int, int], v: int) -> set[tuple[int, ...]]:
    """Phrases of two and three of `v` words that mostly stand together, from the listings with each; (a, b) is a * v + b."""
    least = max(LEAST, LEAST_SHARE * listings)
    pairs = {x for x, n in two.items() if n >= max(least, TOGETHER * min(one[x // v], one[x % v])) and n * listings >= LIFT * one[x // v] * one[x % v]}
    triples = {x for x, n in three.items() if n >= least and x // v in pairs and x % (v * v) in pairs and 2 * n >= max(two[x // v], two[x % (v * v)])}
    return {(x // v, x % v) for x in pairs} | {(x // v // v, x // v % v, x % v) for x in triples}


def phrases_in(t: Sequence[int], known: set[tuple[int, ...]]) -> set[tuple[int, ...]]:
    """Phrases of the words of a listing, the longest first from the left."""
    out, i, n = set(), 0, len(t)
    while i < n:
        if t[i] < 0:
            i += 1
            continue
        p = next((x for k in (3, 2) if (x := tuple(t[i : i + k])) in known), (t[i],))
        out.add(p)
        i += len(p)
    return out


class PhraseNumbers:
    """Numbers of the phrases of a listing by `phrases_in`, of those in `ids`; words that begin no longer phrase are looked up alone."""

    def __init__(self, known: set[tuple[int, ...]], ids: dict[tuple[int, ...], int]):
        self.longer, self.begins = {p: ids.get(p) for p in known}, frozenset(p[0] for p in known)
        self.single = {p[0]: i for p, i in ids.items() if len(p) == 1}

    def of(self, t: Sequence[int]) -> list[int]:
        """In order, each once."""
        out, i, n, longer, single, begins = set(), 0, len(t), self.longer, self.single, self.begins
        while i < n:
            w = t[i]
            if w in begins:
                for k in (3, 2):
                    p = tuple(t[i : i + k])
                    if p in longer:
                        out.add(longer[p])
                        i += len(p)
                        break
                else:
                    out.add(single.get(w))
                    i += 1
            else:
                out.add(single.get(w))
                i += 1
        out.discard(None)
        return sorted(out)


class LineSums:
    """Sums over lines of several listings, for phrases 0 to `n` - 1. For two phrases p and q: `both`, listings with both, and `meet`, listings
    with p * listings with q / other listings of the line, so that meet[p, q] / both[p, p] is the rate of q in the lines of p. `own`
    is the sum of the listings with p / other listings, `total` the number of listings."""

    def __init__(self, n: int):
        self.n, self.total, self.own = n, 0, np.zeros(n)
        self.both, self.meet = np.zeros((n, n)), np.zeros((n, n))

    def add(self, lengths: np.ndarray, phrases: np.ndarray) -> None:
        """Add a line: the numbers of phrases of each listing, and all their phrases."""
        self.add_lines(np.array([len(lengths)]), lengths, phrases)

    def add_lines(self, sizes: np.ndarray, lengths: np.ndarray, phrases: np.ndarray, most: int = 200_000) -> None:
        """Add lines, given by the listings of each, as `add`; some `most` phrases at a time, of whole lines."""
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        part = np.concatenate([[0], ends[:-1]]) // most
        for lines in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
            if len(lines):
                first = int(sizes[: lines[0]].sum())
                many = sizes[lines]
                rows = lengths[first : first + int(many.sum())]
                self._add(many, rows, phrases[ends[lines[-1]] - int(rows.sum()) : ends[lines[-1]]])

    def _add(self, sizes: np.ndarray, lengths: np.ndarray, phrases: np.ndarray) -> None:
        n, listing = self.n, np.repeat(np.arange(len(lengths)), lengths)
        line = np.repeat(np.arange(len(sizes)), sizes)[listing]
        fine = sizes[line] > 1
        listing, line, phrases = listing[fine], line[fine], phrases[fine].astype(np.int64)
        self.total += int(sizes[sizes > 1].sum())
        said = np.unique(listing * n + phrases)  # each phrase of a listing once
        p, q = _pairs_within(said // max(n, 1))
        self._fill(self.both, said[p] % max(n, 1), said[q] % max(n, 1))
        cells, c = np.unique(line[np.searchsorted(listing, said // max(n, 1))] * n + said % max(n, 1), return_counts=True)
        of, others = cells % max(n, 1), sizes[cells // max(n, 1)] - 1.0
        p, q = _pairs_within(cells // max(n, 1))
        self._fill(self.meet, of[p], of[q], c[p] * c[q] / others[p])
        self.own += np.bincount(of, c / others, n)

    def _fill(self, table: np.ndarray, p: np.ndarray, q: np.ndarray, weights: np.ndarray | None = None) -> None:
        code, at = np.unique(p * self.n + q, return_inverse=True)
        table.reshape(-1)[code] += np.bincount(at, weights, len(code))


def _pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of elements of one group, an element with itself too; elements of a group follow each other."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    size = np.diff(np.concatenate([start, [len(group)]]))
    each = np.repeat(size, size)
    p = np.repeat(np.arange(len(group)), each)
    inside = np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)
    return p, np.repeat(np.repeat(start, size), each) + inside


def concepts_of(phrases: Sequence[tuple[str, ...]], sums: LineSums) -> list[dict]:
    """Phrases that mean the same, with the rate of each in lines of the others; `own` is the rate of a concept in its lines."""
    both, meet, total = sums.both, sums.meet, sums.total
    n = both.diagonal()
    least, new = max(LEAST, LEAST_SHARE * total), max(NEW, NEW_SHARE * total)
    concepts: list[dict] = []
    said, rates = np.zeros((64, len(phrases))), np.zeros((64, len(phrases)))  # sums over the phrases of each concept
    count, owned = np.zeros(64), np.zeros(64)
    for p in sorted(np.flatnonzero(n >= least).tolist(), key=lambda p: (-n[p], phrases[p])):
        k = len(concepts)
        # Names of one thing do not stand together, unless the one never stands without the other.
        beside, rate = said[:k, p] / n[p], rates[:k, p] / n[p]
        alone = (beside <= APART) | ((beside >= 1 - 2 * APART) & (n[p] >= NEW))
        fits = alone & (rate > 0) & (rate >= np.maximum(SAME * owned[:k], JOIN * count[:k] / max(total, 1)))
        own = (meet[p, p] - sums.own[p]) / n[p]
        if fits.any():
            k = int(np.flatnonzero(fits)[np.argmax(rate[fits])])
            concepts[k]["phrases"].append((p, float(rate[k])))
        elif n[p] >= new and own >= max(OWN, STICKY * n[p] / total):
            concepts.append({"phrases": [(p, float(own))]})
            if k == len(said):
                said, rates = (np.concatenate([x, np.zeros_like(x)]) for x in (said, rates))
                count, owned = (np.concatenate([x, np.zeros_like(x)]) for x in (count, owned))
        else:
            continue
        said[k] += both[p]
        rates[k] += meet[p]
        count[k] += n[p]
        ids = [x for x, _ in concepts[k]["phrases"]]
        concepts[k]["own"] = owned[k] = float((meet[np.ix_(ids, ids)].sum() - sums.own[ids].sum()) / count[k])
    return concepts


def item_counts(of: np.ndarray, lengths: np.ndarray, phrases: np.ndarray, item_lengths: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(concept, item, listings) of listings, given by their numbers of phrases and ingredients, all their phrases and ingredients;
    `of` has the concept of each phrase or -1. Concept -1 counts all listings, item 0 those with any ingredients."""
    told = item_lengths > 0
    row = np.repeat(np.arange(len(lengths)), lengths)
    k = of[phrases]
    pairs = np.unique(np.stack([row, k], 1)[(k >= 0) & told[row]], axis=0)
    pairs = np.concatenate([pairs, np.stack([np.flatnonzero(told), np.full(told.sum(), -1)], 1)])
    starts = np.concatenate([[0], np.cumsum(item_lengths)])
    m = item_lengths[pairs[:, 0]]
    at = np.repeat(starts[pairs[:, 0]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
    concept, item = np.concatenate([np.repeat(pairs[:, 1], m), pairs[:, 1]]), np.concatenate([items[at], np.zeros(len(pairs), np.int64)])
    order = np.lexsort((item, concept))
    concept, item = concept[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], (concept[1:] != concept[:-1]) | (item[1:] != item[:-1])])[: len(order)])
    return concept[first], item[first], np.diff(np.concatenate([first, [len(order)]]))


def roles_of(concepts: list[dict], counts: Iterable[tuple[int, int, int]]) -> list[str]:
    """Role of each concept, kind, flavour or variant, from (concept, item, listings)."""
    by: dict[int, dict[int, int]] = defaultdict(dict)
    for k, item, n in counts:
        by[k][item] = n
    told = by[-1].get(0, 0)
    shown = lambda c: max((v / c[0] - by[-1][i] / told for i, v in c.items() if i), default=0.0)
    return ["kind" if c["own"] >= KIND else "flavour" if not told or shown(by[k]) >= SHOWS else "variant" for k, c in enumerate(concepts)]


def unnamed_rates(variant: np.ndarray, lengths: np.ndarray, phrases: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """For a line, or several with `sizes` listings each, the sum over listings without a variant of the rates of each variant concept
    in the others; `variant` has the concept of phrases that name a variant, else -1."""
    sizes = np.array([len(lengths)]) if sizes is None else sizes
    line = np.repeat(np.arange(len(sizes)), sizes)
    k = variant[phrases]
    row = np.repeat(np.arange(len(lengths)), lengths)[k >= 0]
    named = np.zeros(len(lengths), bool)
    named[row] = True
    share = np.bincount(line[~named], minlength=len(sizes)) / np.maximum(sizes - 1, 1)
    return np.bincount(k[k >= 0], share[line[row]], variant.max(initial=-1) + 1)


def assemble(phrases: Sequence[tuple[str, ...]], concepts: list[dict], roles: list[str], unnamed: Sequence[float], common: Iterable[str], usual: dict[str, list[float]]) -> Vocabulary:
    """The vocabulary; the plain variant is the one whose lines most often name none."""
    out, codes, plain = {}, Counter(), 0
    best = max((k for k, r in enumerate(roles) if r == "variant"), key=lambda k: unnamed[k] / max(concepts[k]["own"], 1e-9), default=None)
    for k, c in enumerate(concepts):
        codes[roles[k]] += 1
        if k == best:
            plain = codes["variant"]
        for p, w in c["phrases"]:
            out[phrases[p]] = (roles[k], codes[roles[k]], round(w, 4))
    return Vocabulary(out, common, usual, plain)


def sequences(tokens: Iterable[Sequence[int]], v: int) -> tuple[Counter, Counter, Counter]:
    """Listings with each word, each two and each three neighbouring words of `v`; (a, b) is a * v + b."""
    one, two, three = Counter(), Counter(), Counter()
    for t in tokens:
        one.update({x for x in t if x >= 0})
        two.update({a * v + b for a, b in zip(t, t[1:]) if a >= 0 and b >= 0})
        three.update({(a * v + b) * v + c for a, b, c in zip(t, t[1:], t[2:]) if a >= 0 and b >= 0 and c >= 0})
    return one, two, three


def numbered(words: Sequence[str], one: dict[int, int], known: set[tuple[int, ...]], listings: int) -> dict[tuple[int, ...], int]:
    """Numbers of all phrases that stand in enough listings."""
    return {p: i for i, p in enumerate(sorted({(w,) for w, n in one.items() if n >= max(LEAST, LEAST_SHARE * listings)} | known))}


def common_words(rows: list[tuple[str | None, str | None, str | None]], notices: list[tuple[str | None, str | None]] = ()) -> tuple[set[str], set[str]]:
    """`common_of` for listings (name, brand, firm) and notices (text, firm) in memory."""
    by: dict[tuple[str, str], dict[str | None, list[int]]] = defaultdict(dict)
    for (what, word, firm), c in [*word_counts(rows).items(), *word_counts([(t, None, f) for t, f in notices], True).items()]:
        by[what, word][firm] = c
    firms = lambda n: sum(n) ** 2 >= FIRMS * sum(x * x for x in n)

    def enough(what: str, word: str, c: dict[str | None, list[int]]) -> bool:
        n = [x for x, _ in c.values()]
        if not firms(n) or sum(n) < COMMON_SHARE * len(notices if what == "t" else rows):
            return False
        # A word of notices that a firm of the catalogue names its own is not common because others recall it.
        named = by.get(("n", word), {}) if what == "t" else {}
        return firms([(c.get(f) or [0])[0] + (named.get(f) or [0])[0] for f in {*c, *named}])

    return common_of((what, w, sum(x for x, _ in c.values()), sum(y for _, y in c.values())) for (what, w), c in by.items() if what != "u" and enough(what, w, c))


def learn(rows: list[tuple[str, str | None, str | None, str | None]], common: set[str], house: set[str]) -> Vocabulary:
    """Vocabulary from listings (name, brand, firm, ingredients) in memory; `matching.vocabulary` does the same over tables. Without
    lines of several listings nothing but the common words is learned."""
    words = learned_words(common, house)
    number = {w: i for i, w in enumerate(words)}
    read = [(x, i) for n, b, o, i in rows if n and (x := line_tokens(n, {*firm_words(b), *firm_words(o)}, common, number))]
    one, two, three = sequences([t for (_, t), _ in read], len(words))
    known = known_phrases(len(read), one, two, three, len(words))
    ids = numbered(words, one, known, len(read))
    lines: dict[str, list] = defaultdict(list)
    for (line, t), i in read:
        lines[line].append(([ids[p] for p in phrases_in(t, known) if p in ids], items_of(i)))
    flat = lambda v, j: (np.array([len(x[j]) for x in v], int), np.array([y for x in v for y in x[j]], np.int64))
    lines = {k: (*flat(v, 0), *flat(v, 1)) for k, v in lines.items() if len(v) > 1}
    sums = LineSums(len(ids))
    for x in lines.values():
        sums.add(*x[:2])
    names = [tuple(words[w] for w in p) for p in ids]
    concepts = concepts_of(names, sums)
    of = concept_of(concepts, len(ids))
    counts: Counter = Counter()
    for x in lines.values():
        for k, item, n in zip(*item_counts(of, *x)):
            counts[int(k), int(item)] += int(n)
    roles = roles_of(concepts, ((*x, n) for x, n in counts.items()))
    variant = concept_of(concepts, len(ids), [r == "variant" for r in roles])
    unnamed = np.zeros(len(concepts))
    for x in lines.values():
        got = unnamed_rates(variant, *x[:2])
        unnamed[: len(got)] += got
    said: dict[str, set[str]] = defaultdict(set)
    for what, amount, name in word_counts([r[:3] for r in rows]):
        if what == "u":
            said[amount].add(name)
    return assemble(names, concepts, roles, unnamed, common | house, usual_of(a for a, x in said.items() if len(x) >= max(3, USUAL_SHARE * len(rows))))


def concept_of(concepts: list[dict], n: int, wanted: Sequence[bool] | None = None) -> np.ndarray:
    """Concept of each of `n` phrases, of the `wanted` concepts only; else -1."""
    of = np.full(n, -1)
    for k, c in enumerate(concepts):
        if wanted is None or wanted[k]:
            of[[p for p, _ in c["phrases"]]] = k
    return of


def usual_of(amounts: Iterable[str]) -> dict[str, list[float]]:
    """Usual amounts by unit, from texts such as "g 340.0"."""
    out: dict[str, list[float]] = {"g": [], "ml": []}
    for kind, v in (a.split() for a in amounts):
        out[kind].append(float(v))
    return {k: sorted(v) for k, v in out.items()}


class Parsed:
    """What a text says; `flavours` and `names` in the order named, other attributes None if nothing is said."""

    __slots__ = ("kind", "flavours", "variant", "content", "names")


class Reader:
    """Reads names with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._known = vocabulary.words | vocabulary.common
        self._single = {p[0]: hit for p, hit in vocabulary.phrases.items() if len(p) == 1}
        self._longer = {w: ks for w, n in vocabulary.lengths.items() if (ks := [k for k in n if k > 1])}
        self._word: dict[str, str] = {}
        self._told: dict[str, tuple] = {}
        self._names: dict[str, tuple[str, ...]] = {}
        self._amount: dict[tuple[str, str], tuple[str, float]] = {}

    def word(self, token: str) -> str:
        """Vocabulary word of a token, or the token itself."""
        v = self.v
        if token in v.words or token in v.common:
            return token
        if token not in self._word:
            if len(self._word) > 200_000:
                self._word.clear()
            best, share = token, 0.34
            if 2 < len(token) <= 8 and sum(c in "aeiou" for c in token) * 3 <= len(token):
                for w in v.by_letter.get(token[0], ()):
                    if len(w) > len(token) and len(token) / len(w) > share:
                        it = iter(w)
                        if all(c in it for c in token):
                            best, share = w, len(token) / len(w)
            if best == token and token.endswith("s") and token[:-1] in v.words:
                best = token[:-1]
            self._word[token] = best
        return self._word[token]

    def coined(self, name: str | None) -> tuple[str, ...]:
        """Coined words of a brand or firm name."""
        if not name:
            return ()
        if name not in self._names:
            if len(self._names) > 100_000:
                self._names.clear()
            self._names[name] = tuple(dict.fromkeys(t for t in words_of(name) if t not in self.v.common and len(t) > 2))
        return self._names[name]

    def amount(self, number: str, unit: str) -> tuple[str, float]:
        """Unit and amount, as the usual amount that it rounds to, if any."""
        key = (number, unit)
        if key not in self._amount:
            if len(self._amount) > 100_000:
                self._amount.clear()
            kind, value = measure(number, unit)
            near = min(self.v.usual.get(kind, ()), key=lambda u: abs(u - value), default=None)
            self._amount[key] = (kind, near if near is not None and abs(near - value) <= ROUNDED * near else value)
        return self._amount[key]

    def read(self, text: str) -> Parsed:
        """Read a listing name or a notice."""
        v, out = self.v, Parsed()
        t = folded(text)
        size = units = None
        if _DIGIT.search(t):
            m = _SIZE.search(t)
            if m:
                size = self.amount(m.group(2), m.group(3))
                units = int(m.group(1)) if m.group(1) else None
                t = f"{t[: m.start()]} | {t[m.end() :]}"
                if _DIGIT.search(t):
                    t = _SIZE.sub(" | ", t)
            c = _COUNT.search(t) if _DIGIT.search(t) else None
            if c:
                units = units or int(next(g for g in c.groups() if g))
                t = _COUNT.sub(" | ", t)
        out.content = content_code(size, units)
        told, tell = self._told, self._tell
        tokens = [told.get(x) or tell(x) for x in (self._hyphened(t) if "-" in t else _PIECE.findall(t))]
        out.kind, out.variant, out.flavours, out.names = None, None, [], []
        weight, i, n = 0.0, 0, len(tokens)
        phrases = v.phrases
        while i < n:
            w, longer, hit, coined = tokens[i]
            step = 1
            for k in longer:
                if i + k <= n:
                    found = phrases.get(tuple([x[0] for x in tokens[i : i + k]]))
                    if found:
                        hit, step = found, k
                        break
            if hit:
                role, code, weighs = hit
                if role == "flavour":
                    if code not in out.flavours:
                        out.flavours.append(code)
                elif role == "kind":
                    if weighs > weight:
                        out.kind, weight = code, weighs
                elif out.variant is None:
                    out.variant = code
            elif coined:
                out.names.append(w)
            i += step
        return out

    def _tell(self, token: str) -> tuple[str, tuple[int, ...], tuple[str, int, float] | None, bool]:
        """Word of a token, lengths of longer phrases that it begins, what it means alone, whether it is a coined name else."""
        if len(self._told) > 200_000:
            self._told.clear()
        w = self.word(token)
        got = self._told[token] = (w, tuple(self._longer.get(w, ())), self._single.get(w), w not in self._known and len(w) > 2 and not w.endswith("'s"))
        return got

    def _hyphened(self, t: str) -> list[str]:
        """Tokens of a text with hyphens: common words are separated at it, coined ones joined."""
        out = []
        for chunk in t.split():
            parts = [p for p in chunk.split("-") if p]
            bare = [p.strip("(),;.|:") for p in parts]
            if len(parts) > 1 and all(_TOKEN.fullmatch(p) for p in bare) and not all(p in self.v.words or p in self.v.common for p in bare):
                chunk = "".join(parts)
            out.extend(_PIECE.findall(chunk.replace("-", " ")))
        return out


def flavour_code(flavours: Sequence[int]) -> int | None:
    """One number for a set of flavours: a single one's own, else a 62-bit hash; null for none."""
    if len(flavours) < 2:
        return flavours[0] if flavours else None
    return int.from_bytes(hashlib.blake2b(",".join(map(str, sorted(flavours))).encode(), digest_size=8).digest(), "big") >> 2 | 1 << 61


def content_code(size: tuple[str, float] | None, units: int | None) -> int | None:
    """One number for a net content and the number of units: units, then tenths of g or ml, then 1 for ml; null without a size."""
    if not size:
        return None
    kind, value = size
    tenths = round(float(f"{value:.3g}") * 10) if value < 100 else round(value) * 10
    return (units or 1) * 10**9 + tenths * 10 + (kind == "ml")
