"""Sets of code points as sorted, disjoint, inclusive ranges, and the Unicode sets that patterns name.

Properties come from the Unicode database of the `regex` module, on the driver and at planning time
only; tasks get ranges. Case folding is str.casefold, code point by code point.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

MAX = 0x10FFFF
_SURROGATES = (0xD800, 0xDFFF)


def normal(ranges) -> tuple:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if lo > hi:
            continue
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


class CharSet:
    """An immutable set of code points; surrogates are never members."""

    __slots__ = ("ranges", "_low")

    def __init__(self, ranges=(), clean: bool = False):
        if not clean:
            ranges = normal(ranges)
            if any(a <= _SURROGATES[1] and b >= _SURROGATES[0] for a, b in ranges):
                ranges = normal(x for a, b in ranges for x in ((a, min(b, _SURROGATES[0] - 1)), (max(a, _SURROGATES[1] + 1), b)))
        self.ranges = ranges
        self._low = [a for a, _ in ranges]

    def __getstate__(self):
        return self.ranges

    def __setstate__(self, ranges):
        self.ranges = ranges
        self._low = [a for a, _ in ranges]

    def __contains__(self, cp: int) -> bool:
        i = bisect_right(self._low, cp) - 1
        return i >= 0 and cp <= self.ranges[i][1]

    def __eq__(self, other) -> bool:
        return isinstance(other, CharSet) and self.ranges == other.ranges

    def __hash__(self) -> int:
        return hash(self.ranges)

    def __or__(self, other: CharSet) -> CharSet:
        return CharSet(normal((*self.ranges, *other.ranges)), True)

    def __invert__(self) -> CharSet:
        out, at = [], 0
        for a, b in self.ranges:
            out.append((at, a - 1))
            at = b + 1
        return CharSet((*out, (at, MAX)))

    def __and__(self, other: CharSet) -> CharSet:
        out, i, j = [], 0, 0
        a, b = self.ranges, other.ranges
        while i < len(a) and j < len(b):
            lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
            if lo <= hi:
                out.append((lo, hi))
            if a[i][1] < b[j][1]:
                i += 1
            else:
                j += 1
        return CharSet(tuple(out), True)

    def __sub__(self, other: CharSet) -> CharSet:
        return self & ~other

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.ranges)

    def __bool__(self) -> bool:
        return bool(self.ranges)

    def members(self):
        for a, b in self.ranges:
            yield from range(a, b + 1)


def of(text: str) -> CharSet:
    return CharSet((ord(c), ord(c)) for c in text)


EMPTY = CharSet()
ANY = ~EMPTY
NEWLINE = of("\n")
DIGIT = CharSet([(48, 57)])
XDIGIT = CharSet([(48, 57), (65, 70), (97, 102)])
UPPER_A = CharSet([(65, 90)])
LOWER_A = CharSet([(97, 122)])
ASCII = CharSet([(0, 127)])
SPACE = CharSet([(9, 13), (32, 32)])
BLANK = of("\t ")
CNTRL = CharSet([(0, 31), (127, 127)])
PUNCT = CharSet([(33, 47), (58, 64), (91, 96), (123, 126)])
WORD_A = DIGIT | UPPER_A | LOWER_A | of("_")


@lru_cache(None)
def _everything() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, MAX + 1))))


@lru_cache(None)
def unicode_set(expression: str) -> CharSet | None:
    """The code points of a property expression of the `regex` module, such as Lu or Script=Latin."""
    import regex

    try:
        run = regex.compile(rf"\p{{{expression}}}+", regex.V0)
    except regex.error:
        return None
    return CharSet(x for m in run.finditer(_everything()) for x in _pieces(ord(m[0][0]), ord(m[0][-1])))


def _pieces(lo: int, hi: int):
    """A run over all code points but surrogates may step over them."""
    if lo < _SURROGATES[0] and hi > _SURROGATES[1]:
        return (lo, _SURROGATES[0] - 1), (_SURROGATES[1] + 1, hi)
    return ((lo, hi),)


def alphabetic() -> CharSet:
    return unicode_set("Alphabetic")


def numeric() -> CharSet:
    return unicode_set("N")


def word(ascii_only: bool = False) -> CharSet:
    return WORD_A if ascii_only else alphabetic() | numeric() | of("_")


def shorthand(letter: str, ascii_only: bool) -> CharSet:
    """The set of one of w W d D s S h H."""
    kind = letter.lower()
    base = word(ascii_only) if kind == "w" else (DIGIT if ascii_only else numeric()) if kind == "d" else SPACE if kind == "s" else XDIGIT
    return base if letter == kind else ~base


def posix(name: str, ascii_only: bool) -> CharSet | None:
    """The set of a POSIX bracket class; None for an unknown name."""
    letters = UPPER_A | LOWER_A
    wide = {
        "alnum": lambda: DIGIT | letters if ascii_only else alphabetic() | numeric(),
        "alpha": lambda: letters if ascii_only else alphabetic(),
        "lower": lambda: LOWER_A if ascii_only else unicode_set("Lowercase"),
        "upper": lambda: UPPER_A if ascii_only else unicode_set("Uppercase"),
        "graph": lambda: CharSet([(33, 126)]) if ascii_only else CharSet([(33, MAX)]) - unicode_set("Cc"),
        "print": lambda: CharSet([(32, 126)]) if ascii_only else CharSet([(32, MAX)]) - of("\x7f"),
        "word": lambda: word(ascii_only),
        "ascii": lambda: ASCII,
        "blank": lambda: BLANK,
        "cntrl": lambda: CNTRL,
        "digit": lambda: DIGIT,
        "punct": lambda: PUNCT,
        "space": lambda: SPACE,
        "xdigit": lambda: XDIGIT,
    }
    return wide[name]() if name in wide else None


#: Long names of general categories (fixed values of the Unicode standard).
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "combiningmark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "privateuse": "Co", "unassigned": "Cn", "surrogate": "Cs",
}
_SHORT = {v.lower(): v for v in CATEGORIES.values()}


def loose(name: str) -> str:
    return name.replace("_", "").replace("-", "").replace(" ", "").lower()


def unicode_property(name: str) -> CharSet | None:
    """The set of \\p{name}; None for an unknown one. Names are loose in case, '_', '-' and spaces."""
    key, _, value = name.partition("=")
    key = loose(key)
    if value:
        kind = {"script": "Script", "sc": "Script", "scriptextensions": "Script_Extensions", "scx": "Script_Extensions"}.get(key)
        return unicode_set(f"{kind}={value.strip()}") or None if kind else None
    if key == "any":
        return ANY
    if key == "assigned":
        return ~unicode_set("Cn")
    if key == "cs":
        return EMPTY
    if key in _SHORT or key in CATEGORIES:
        return unicode_set(CATEGORIES.get(key) or _SHORT[key]) or EMPTY
    fixed = {"alphabetic": "Alphabetic", "uppercase": "Uppercase", "lowercase": "Lowercase", "math": "Math", "whitespace": "White_Space"}
    if key in fixed:
        return unicode_set(fixed[key])
    if key == "numeric":
        return numeric()
    if key == "hexdigit":
        return XDIGIT
    got = posix(key, False)
    if got is not None:
        return got
    return unicode_set(f"Script={name.strip()}") or None


@lru_cache(None)
def _folds() -> tuple[dict[str, list[int]], dict[int, str]]:
    """Code points by their folded string, and the fold of each code point that isn't its own."""
    by: dict[str, list[int]] = {}
    own: dict[int, str] = {}
    for cp in range(MAX + 1):
        f = chr(cp).casefold()
        if f != chr(cp):
            by.setdefault(f, []).append(cp)
            own[cp] = f
    for f in list(by):
        if len(f) == 1:
            by[f].append(ord(f))
    return by, own


def fold(cp: int) -> str:
    return _folds()[1].get(cp) or chr(cp)


def preimages(folded: str) -> list[int]:
    """All code points that fold to a string."""
    by = _folds()[0]
    return by.get(folded) or ([ord(folded)] if len(folded) == 1 and ord(folded) not in _folds()[1] else [])


def folding_to(letters: set[str]) -> CharSet:
    """All code points whose fold is made of some letters."""
    by, own = _folds()
    return CharSet([(c, c) for f, cps in by.items() if letters.issuperset(f) for c in cps] + [(ord(f), ord(f)) for f in letters if ord(f) not in own])


def fold_closure(s: CharSet) -> CharSet:
    """With each member, all code points that fold to the same single code point."""
    by, own = _folds()
    more = []
    for f, cps in by.items():
        if len(f) == 1 and any(c in s for c in cps):
            more += [(c, c) for c in cps]
    return s | CharSet(more)
