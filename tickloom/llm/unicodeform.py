"""Unicode normalisation as Column expressions: compatibility composition (NFKC) with full case folding.

The tables come from Python's unicodedata when an expression is built; the work is done in the JVM. Texts are taken apart
only where they hold characters that need it: marks to order and compose, characters that stand for several, conjoining
jamo. Everything else is at most one translate().
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that have a normal form of their own lie below these ends; surrogates and unassigned ones don't.
PLANES = [(0x80, 0xD800), (0xE000, 0x32000), (0xE0000, 0xE0200)]
#: Characters that most texts are made of and that are their own normal form: a quick look leaves them out.
COMMON = r"\x00-\x7F\xDF-\xFFА-яЀ-џא-תء-ي\x{3041}-\x{3093}\x{30A1}-\x{30F6}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
#: The one letter of many texts that folds to two; it is replaced first, so that they need no closer look.
SHARP_S = "ß"
#: Iota subscript: a mark that folds to a letter, so it is folded after marks are ordered.
IOTA = "ͅ"
#: Conjoining jamo, as ranges of initial, medial and final ones, and syllables.
INITIAL, MEDIAL, FINAL, SYLLABLE = r"[\x{1100}-\x{1112}]", r"[\x{1161}-\x{1175}]", r"[\x{11A8}-\x{11C2}]", r"[\x{AC00}-\x{D7A3}]"


def char_class(chars) -> str:
    """A regular expression for any of the characters."""
    codes = sorted(map(ord, chars))
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return f"(?=[^{COMMON}])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@dataclass(frozen=True)
class Tables:
    compatible: dict[str, str]  # character -> its other normal form, before marks are composed
    folded: dict[str, str]  # character -> its case folding, after
    classes: dict[str, int]  # mark -> its combining class
    parts: dict[str, str]  # character -> base and marks
    pairs: dict[str, dict[str, str]]  # second -> first -> composed


@lru_cache(maxsize=1)
def tables() -> Tables:
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    chars = [c for a, b in PLANES for c in map(chr, range(a, b)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not 0xAC00 <= ord(c) < 0xD7A4]
    compatible, folded, classes, parts, pairs = {}, {}, {}, {}, {}
    for c in chars:
        full, whole = unicodedata.normalize("NFD", c), nfkc(c)
        fold = nfkc(whole.casefold())
        while fold != (again := nfkc(fold.casefold())):
            fold = again
        if whole != c and IOTA not in full:
            compatible[c] = fold
        elif fold not in (c, c.lower()) and c != SHARP_S:
            folded[c] = fold
        if n := unicodedata.combining(c):
            classes[c] = n
        if full != c:
            parts[c] = full
        direct = unicodedata.decomposition(c).split()
        if len(direct) == 2 and direct[0][0] != "<":
            first, second = (chr(int(x, 16)) for x in direct)
            if unicodedata.normalize("NFC", first + second) == c:
                pairs.setdefault(second, {})[first] = c
    return Tables(compatible, folded, classes, parts, pairs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _remade(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """text with every match of a pattern remade."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(made(m), F.lit("")))), "")


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _replaced(text: Column, table: dict[str, str]) -> Column:
    """text with characters replaced by one or more others."""
    single = {c: to for c, to in table.items() if len(to) == 1}
    several = dict(sorted(((c, to) for c, to in table.items() if len(to) != 1), key=lambda x: -len(x[1])))
    out = F.when(text.rlike(char_class(single)), F.translate(text, "".join(single), "".join(single.values()))).otherwise(text)
    if not several:
        return out
    here = char_class(several)
    longest = [c for c, to in several.items() if len(to) > 8]
    for c in longest:  # a few ligatures of whole phrases
        out = F.replace(out, F.lit(c), F.lit(several.pop(c)))
    # the k-th characters of the longer forms; where a form is shorter, translate() leaves nothing
    places = ["".join(to[k] for to in several.values() if len(to) > k) for k in range(max(map(len, several.values())))]
    each = lambda c: F.concat(*[F.translate(c, "".join(several), p) for p in places])
    return let(out, lambda x: F.when(x.rlike(here), _remade(x, here, each)).otherwise(x))


def _pair(first: Column, second: Column, seconds: dict[str, dict[str, str]]) -> Column:
    """The composed character of two, or the first where there is none."""
    out = F.when(F.lit(False), first)
    for s, firsts in seconds.items():
        out = out.when(second == s, F.translate(first, "".join(firsts), "".join(firsts.values())))
    return out.otherwise(first)


def _composed(text: Column) -> Column:
    """Marks in canonical order and composed with the character before them."""
    t = tables()
    mark = char_class(t.classes)
    marks, ranks = "".join(t.classes), "".join(chr(0x100 + n) for n in t.classes.values())
    parted = dict(sorted(t.parts.items(), key=lambda x: -len(x[1])))
    whole, longest = "".join(parted), max(map(len, parted.values()))
    apart = lambda c: F.concat(*[F.translate(c, whole, "".join(p[k] for p in parted.values() if len(p) > k)) for k in range(longest)])
    taken = lambda c: F.when((F.translate(c, whole, "") == "") & (c != ""), apart(c)).otherwise(c)

    def ordered(every: Column) -> Column:
        bare = ~every[0].rlike(f"^{mark}$")
        start = F.when(bare, every[0]).otherwise("")
        rest = F.when(bare, F.slice(every, 2, F.size(every))).otherwise(every)
        ranked = F.array_sort(F.transform(rest, lambda c, i: F.struct(F.when(c.rlike(f"^{mark}$"), F.translate(c, marks, ranks)).otherwise("").alias("rank"), i.alias("i"), c.alias("c"))))

        def step(s: Column, m: Column) -> Column:
            made = F.when(s["rank"] == m["rank"], s["base"]).otherwise(_pair(s["base"], m["c"], t.pairs))
            return let(made, lambda base: F.when(base != s["base"], F.struct(base.alias("base"), s["after"].alias("after"), s["rank"].alias("rank"))).otherwise(F.struct(base.alias("base"), F.concat(s["after"], m["c"]).alias("after"), m["rank"].alias("rank"))))

        none = F.struct(start.alias("base"), F.lit("").alias("after"), F.lit("none").alias("rank"))
        return F.aggregate(ranked, none, step, lambda s: F.concat(s["base"], s["after"]))

    cluster = lambda x: let(_chars(F.array_join(F.transform(_chars(x), taken), "")), ordered)
    return _remade(text, f"(?s)(?:(?!{mark}).)?(?:{mark})+", cluster)


def _letters_composed(text: Column) -> Column:
    """Letters that are written in two, the second no mark: Indic vowels."""
    t = tables()
    for made, letters in sorted((made, first + second) for second, firsts in t.pairs.items() if second not in t.classes for first, made in firsts.items()):
        text = F.replace(text, F.lit(letters), F.lit(made))
    return text


def _syllables(text: Column) -> Column:
    """Conjoining jamo as Hangul syllables, by arithmetic on code points."""
    pattern = f"(?:{SYLLABLE}|{INITIAL}{MEDIAL}){FINAL}?"

    def char(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def made(m: Column) -> Column:
        a, b, c = F.substring(m, 1, 1), F.substring(m, 2, 1), F.substring(m, 3, 1)
        jamo = lambda last: char(F.lit(0xAC00) + ((F.ascii(a) - 0x1100) * 21 + F.ascii(b) - 0x1161) * 28 + last)
        ends = (F.length(m) == 2) & ((F.ascii(a) - 0xAC00) % 28 == 0)
        return F.when(a.rlike(INITIAL), F.when(c == "", jamo(F.lit(0))).otherwise(jamo(F.ascii(c) - 0x11A7))).when(ends, char(F.ascii(a) + F.ascii(b) - 0x11A7)).otherwise(m)

    return _remade(text, pattern, made)


@lru_cache(maxsize=1)
def _looks() -> tuple[str, str, str, str]:
    """Patterns of what needs a look: anything, marks, letters in two, jamo."""
    t = tables()
    seconds = [s for s in t.pairs if s not in t.classes]
    jamo = r"[\x{1161}-\x{1175}\x{11A8}-\x{11C2}]"
    every = {*t.compatible, *t.folded, *t.classes, *seconds, *map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))}
    return char_class(every), char_class(t.classes), char_class(seconds), jamo


def normal(text: Column) -> Column:
    """NFKC with full case folding, as Unicode's tables of the driver's Python have it. Null stays null."""
    t = tables()
    anything, marks, seconds, jamo = _looks()
    steps = [
        lambda x: _replaced(x, t.compatible),
        lambda x: F.when(x.rlike(seconds), _letters_composed(x)).otherwise(x),
        lambda x: F.when(x.rlike(jamo), _syllables(x)).otherwise(x),
        lambda x: F.when(x.rlike(marks), _composed(x)).otherwise(x),
        lambda x: _replaced(x, t.folded),
    ]

    def other(lower: Column) -> Column:
        return F.when(lower.rlike(anything), reduce(let, steps, lower)).otherwise(lower)

    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(let(F.replace(F.lower(text), F.lit(SHARP_S), F.lit("ss")), other))
