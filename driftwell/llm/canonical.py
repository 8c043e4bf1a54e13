"""Canonical text as Spark expressions: Unicode composition (NFC), case folding, white-space folding.

Most texts are composed already; a character class tells, and they pass untouched.  The others are decomposed, their
marks ordered by combining class and composed again, working on the distinct characters and mark runs of the text only.
The tables come from Python's ``unicodedata`` by rule when the expression is built.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLANES = [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]


def _escaped(chars: list[str]) -> str:
    """A regular-expression class of the characters, as ranges."""
    out, codes = [], sorted(map(ord, chars))
    start = previous = codes[0]
    for c in [*codes[1:], None]:
        if c is None or c != previous + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{previous:X}}}" if previous > start else f"\\x{{{start:X}}}")
            start = c
        previous = c
    return "".join(out)


@lru_cache(maxsize=1)
def _tables() -> dict:
    chars = [chr(c) for c in _PLANES]
    split = {c: d for c in chars if (d := unicodedata.normalize("NFD", c)) != c}
    joined: dict[str, str] = {}
    for c in split:
        parts = unicodedata.decomposition(c).split()
        pair = "".join(chr(int(x, 16)) for x in parts) if parts and parts[0][0] != "<" else ""
        if len(pair) == 2 and unicodedata.normalize("NFC", pair) == c:
            joined[pair] = c
    jamo = [chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]]
    marks = [c for c in chars if unicodedata.combining(c)]
    seconds = sorted({p[1] for p in joined} | set(jamo))
    unstable = sorted({c for c in split if unicodedata.normalize("NFC", c) != c} | set(seconds))
    split = {c: d for c, d in split.items() if not 0xAC00 <= ord(c) < 0xD7A4}
    return {"split": split, "joined": joined, "marks": marks, "seconds": seconds, "unstable": unstable}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands in the plan once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(c: Column, k: int) -> Column:
    """The k-th character of a decomposable character's decomposition, or nothing."""
    split = _tables()["split"]
    has = [x for x in split if len(split[x]) > k]
    none = [x for x in split if len(split[x]) <= k]
    return F.translate(c, "".join(has + none), "".join(split[x][k] for x in has))


#: Hangul syllables stand in order of lead, vowel and tail (0: none).
_FIRST, _VOWELS, _TAILS = 0xAC00, 21, 28
_LEAD = "".join(chr(0x1100 + i) for i in range(19))
_VOWEL = "".join(chr(0x1161 + i) for i in range(_VOWELS))
_TAIL = "".join(chr(0x11A8 + i) for i in range(_TAILS - 1))


def _spelled(c: Column) -> Column:
    """A Hangul syllable as jamo."""
    n = F.ascii(c) - _FIRST
    at = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))
    tail = F.when(n % _TAILS > 0, at(_TAIL, n % _TAILS - 1)).otherwise("")
    return F.concat(at(_LEAD, F.floor(n / (_VOWELS * _TAILS))), at(_VOWEL, F.floor(n / _TAILS) % _VOWELS), tail)


def _syllable(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex((number + _FIRST).cast("long")), 8, "0")), "UTF-32")


def _class(c: Column) -> Column:
    """A character that sorts as the combining class does; ``Ā`` (class 0) for all that is no mark."""
    marks = _tables()["marks"]
    known = F.translate(c, "".join(marks), "".join(chr(0x100 + unicodedata.combining(x)) for x in marks))
    return F.when(known == c, F.lit("Ā")).otherwise(known)


def _replaced(text: Column, found: Column, by) -> Column:
    """``text`` with each string of the array ``found`` replaced by ``by`` of it, longest first."""
    longest = F.array_sort(F.transform(F.array_distinct(found), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.aggregate(F.transform(longest, lambda x: F.struct(x["s"].alias("old"), by(x["s"]).alias("new"))), text, lambda acc, x: F.replace(acc, x["old"], x["new"]))


def _composed_run(run: Column) -> Column:
    """A starter and what follows it, composed: a mark joins the starter unless one of its class or above stands between."""
    joined = _tables()["joined"]
    keys, values = "".join("\u0001" + pair for pair in joined), "".join(joined.values())

    def jamo(a: Column, b: Column) -> Column:
        """A lead and a vowel, or a syllable without tail and a tail."""
        lead, vowel, tail = F.instr(F.lit(_LEAD), a), F.instr(F.lit(_VOWEL), b), F.instr(F.lit(_TAIL), b)
        n = F.ascii(a) - _FIRST
        bare = (a >= chr(_FIRST)) & (a <= "\ud7a3") & (n % _TAILS == 0)
        return F.when((lead > 0) & (vowel > 0), _syllable(((lead - 1) * _VOWELS + vowel - 1) * _TAILS)).when(bare & (tail > 0), _syllable(n + tail))

    zero = F.lit("Ā")
    start = F.struct(F.lit("").alias("done"), F.substring(run, 1, 1).alias("starter"), F.lit("").alias("loose"), zero.alias("last"))

    def listed(pair: Column) -> Column:
        """The composite of a pair: its place in the list of pairs is its place in the list of composites."""
        place = F.instr(F.lit(keys), F.concat(F.lit("\u0001"), pair))
        return F.when(place > 0, F.substring(F.lit(values), ((place - 1) / 3).cast("int") + 1, F.lit(1)))

    def step(acc: Column, c: Column) -> Column:
        own = _class(c)
        free = (acc["loose"] == "") | ((acc["last"] < own) & (acc["last"] != zero))
        both = F.when(free, F.coalesce(listed(F.concat(acc["starter"], c)), jamo(acc["starter"], c)))
        restart = both.isNull() & (own == zero)
        return F.struct(
            F.when(restart, F.concat(acc["done"], acc["starter"], acc["loose"])).otherwise(acc["done"]).alias("done"),
            F.when(restart, c).otherwise(F.coalesce(both, acc["starter"])).alias("starter"),
            F.when(restart, F.lit("")).when(both.isNotNull(), acc["loose"]).otherwise(F.concat(acc["loose"], c)).alias("loose"),
            F.when(restart, zero).when(both.isNotNull(), acc["last"]).otherwise(own).alias("last"),
        )

    rest = F.split(F.substring(run, F.lit(2), F.length(run)), "")
    return F.aggregate(F.filter(rest, lambda c: c != ""), start, step, lambda acc: F.concat(acc["done"], acc["starter"], acc["loose"]))


def composed(text: Column) -> Column:
    """Unicode normalisation form C of ``text``."""
    t = _tables()
    marks, follow = _escaped(t["marks"]), _escaped(sorted({*t["marks"], *t["seconds"]}))
    # From the cheapest test to the dearest: any character from U+0300 on, then a lone one that is never stable, or a mark
    # that joins something or stands beside another.
    single = _escaped([c for c in t["unstable"] if unicodedata.category(c)[0] != "M"])
    mark = text.rlike(r"\p{M}") & text.rlike(f"[{_escaped([c for c in t['unstable'] if unicodedata.category(c)[0] == 'M'])}]|[{marks}]{{2}}")
    busy = text.rlike(r"[^\x{0}-\x{2FF}]") & (text.rlike(f"[{single}]") | mark)
    table = "".join(t["split"])
    syllable = lambda c: (c >= chr(_FIRST)) & (c <= "\ud7a3")
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: (c > "\u007f") & (syllable(c) | (F.instr(F.lit(table), c) > 0)))
    apart = _replaced(text, chars, lambda c: F.when(syllable(c), _spelled(c)).otherwise(F.concat(*[_part(c, k) for k in range(max(map(len, t["split"].values())))])))

    def ordered(apart: Column) -> Column:
        runs = F.regexp_extract_all(apart, F.lit(f"[{marks}]{{2,}}"), F.lit(0))
        return _replaced(apart, runs, lambda run: F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(_class(c).alias("k"), i.alias("i"), c.alias("c")))), lambda x: x["c"]), ""))

    def joined(in_order: Column) -> Column:
        groups = F.regexp_extract_all(in_order, F.lit(f"(?s)[^{follow}][{follow}]+|[{follow}]{{2,}}"), F.lit(0))
        return _replaced(in_order, groups, _composed_run)

    return F.when(busy, _let(apart, lambda a: _let(ordered(a), joined))).otherwise(text)


def canonical(text: Column) -> Column:
    """Composed, case-folded (through upper case, so that sharp s meets ss) and with white space folded to one blank."""
    return _let(F.coalesce(text, F.lit("")), lambda raw: _let(composed(raw), lambda c: _let(F.lower(F.upper(c)), lambda low: F.trim(F.regexp_replace(composed(low), r"[\s\p{Z}]+", " ")))))
