"""Sequence patterns: a linear-time pattern language over UTF-8, written out as a Java pattern over bytes.

Lines are held as one character per byte, so a character class becomes the byte
sequences of its code points.  Whether a text matches doesn't depend on greed or on
what groups catch, so neither is carried over.  Only the JVM's engine runs the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

Ranges = list[tuple[int, int]]

LAST = 0x10FFFF
_SURROGATES = (0xD800, 0xDFFF)

# The POSIX classes, as ranges of characters.
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09", "graph": "!~", "lower": "az",
    "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}

# Escapes that stand for a character.
CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}

# The Unicode White_Space property, and what belongs to words beside letters, marks, decimal and letter numbers and connectors.
_WHITE = [(9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_MORE_WORD = [(0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)]

# Long names of general categories.
CATEGORIES = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M",
    "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "unassigned": "Cn",
    "privateuse": "Co",
}


class PatternError(ValueError):
    """A pattern that the language doesn't have."""


def merged(ranges: Iterable[tuple[int, int]]) -> Ranges:
    """The same characters in rising ranges that don't touch."""
    out: Ranges = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def others(ranges: Ranges, last: int) -> Ranges:
    """All characters up to ``last`` that aren't in the ranges."""
    out, at = [], 0
    for low, high in merged(ranges):
        if at < low:
            out.append((at, low - 1))
        at = high + 1
    return out + ([(at, last)] if at <= last else [])


def both(x: Ranges, y: Ranges) -> Ranges:
    return merged((max(a, c), min(b, d)) for a, b in x for c, d in y if max(a, c) <= min(b, d))


@cache
def _category(prefix: str) -> tuple[tuple[int, int], ...]:
    return tuple(merged((c, c) for c in range(LAST + 1) if unicodedata.category(chr(c)).startswith(prefix)))


@cache
def _word() -> tuple[tuple[int, int], ...]:
    return tuple(merged([r for p in ("L", "M", "Nd", "Nl", "Pc") for r in _category(p)] + _MORE_WORD))


@cache
def _cases() -> dict[int, frozenset[int]]:
    """Characters that differ in case alone, of those that have any."""
    group: dict[int, set[int]] = {}
    for c in range(0x1E944):
        x = chr(c)
        for y in {x.lower(), x.upper(), x.title(), x.casefold()} - {x}:
            if len(y) == 1:
                joined = group.setdefault(c, {c}) | group.setdefault(ord(y), {ord(y)})
                for member in joined:
                    group[member] = joined
    return {c: frozenset(g) for c, g in group.items()}


def any_case(ranges: Ranges, unicode: bool) -> Ranges:
    """The characters with those that differ from one in case alone."""
    out = list(ranges)
    for low, high in ranges:
        for shift, first in ((32, 65), (-32, 97)):
            a, b = max(low, first), min(high, first + 25)
            if a <= b:
                out.append((a + shift, b + shift))
    if unicode:
        out += [(x, x) for c, g in _cases().items() if any(a <= c <= b for a, b in ranges) for x in g]
    return merged(out)


def byte_sequences(low: int, high: int) -> list[list[tuple[int, int]]]:
    """The UTF-8 forms of a range of code points, as sequences of ranges of bytes."""
    for last in (0x7F, 0x7FF, 0xFFFF):
        if low <= last < high:
            return byte_sequences(low, last) + byte_sequences(last + 1, high)
    if high > 0x7F:
        for bits in (6, 12, 18):
            mask = (1 << bits) - 1
            if low & ~mask != high & ~mask:
                if low & mask:
                    return byte_sequences(low, low | mask) + byte_sequences((low | mask) + 1, high)
                if high & mask != mask:
                    return byte_sequences(low, (high & ~mask) - 1) + byte_sequences(high & ~mask, high)
    return [list(zip(chr(low).encode(), chr(high).encode()))]


def _set(ranges: Iterable[tuple[int, int]]) -> str:
    shown = [f"\\x{a:02X}" if a == b else f"\\x{a:02X}-\\x{b:02X}" for a, b in ranges]
    return shown[0] if len(shown) == 1 and "-" not in shown[0] else f"[{''.join(shown)}]"


class Characters:
    """One character of a set; ``wide``: code points, else bytes."""

    def __init__(self, ranges: Ranges, wide: bool):
        self.ranges, self.wide = merged(ranges), wide

    def parts(self) -> tuple[str, str]:
        """The one-byte forms and the longer ones, either of which may be empty."""
        if not self.wide:
            return (_set(self.ranges) if self.ranges else ""), ""
        short = both(self.ranges, [(0, 0x7F)])
        long = [r for a, b in both(self.ranges, [(0x80, _SURROGATES[0] - 1), (_SURROGATES[1] + 1, LAST)]) for r in byte_sequences(a, b)]
        return (_set(short) if short else ""), "|".join("".join(_set([r]) for r in sequence) for sequence in long)

    def java(self) -> str:
        short, long = self.parts()
        if not short and not long:
            return "(?!)"
        return short if not long else f"(?:{'|'.join(filter(None, (short, long)))})"


class Raw:
    """An assertion, or nothing."""

    def __init__(self, text: str):
        self.text = text

    def java(self) -> str:
        return self.text


class Row:
    def __init__(self, parts: list):
        self.parts = parts

    def java(self) -> str:
        return "".join(p.java() for p in self.parts)


class Either:
    def __init__(self, ways: list):
        self.ways = ways

    def java(self) -> str:
        return f"(?:{'|'.join(w.java() for w in self.ways)})"


class Repeated:
    def __init__(self, part, least: int, most: int | None):
        self.part, self.least, self.most = part, least, most

    def java(self) -> str:
        if isinstance(self.part, Characters) and self.most is None and self.least < 2:
            short, long = self.part.parts()
            if short and long:  # unrolled: one-byte characters, the many, run without a step of the engine's stack
                rest = f"{short}*(?:(?:{long}){short}*)*"
                return rest if not self.least else f"{self.part.java()}{rest}"
        times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((self.least, self.most))
        if times is None:
            times = f"{{{self.least}{',' if self.most != self.least else ''}{'' if self.most in (None, self.least) else self.most}}}"
        return f"(?:{self.part.java()}){times}"


_ASCII_WORD = "[0-9A-Za-z_]"


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.flags = dict.fromkeys("imsRUx", False) | {"u": True}

    def fail(self, why: str) -> PatternError:
        return PatternError(f"invalid pattern: {why}: {self.text}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise self.fail("it ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def eat(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def blank(self) -> None:
        """Passes white space and comments, where they mean nothing."""
        while self.flags["x"] and self.peek() and (self.peek() == "#" or any(a <= ord(self.peek()) <= b for a, b in _WHITE)):
            if self.take() == "#":
                while self.peek() not in ("", "\n"):
                    self.at += 1

    def whole(self):
        found = self.either()
        if self.peek():
            raise self.fail("an unopened group")
        return found

    def either(self):
        before = dict(self.flags)
        ways = [self.row()]
        while self.eat("|"):
            ways.append(self.row())
        self.flags = before
        if len(ways) == 1:
            return ways[0]
        kinds = {w.wide for w in ways if isinstance(w, Characters)}
        if len(kinds) == 1 and all(isinstance(w, Characters) for w in ways):
            return Characters([r for w in ways for r in w.ranges], kinds.pop())
        return Either(ways)

    def row(self):
        parts: list = []
        while True:
            self.blank()
            if self.peek() in ("", "|", ")"):
                return parts[0] if len(parts) == 1 else Row(parts)
            if self.peek() in tuple("*+?{"):
                if not parts:
                    raise self.fail("nothing to repeat")
                parts.append(self.repeat(parts.pop()))
                continue
            found = self.atom()
            if found is None:  # flags: they hold to the group's end
                self.blank()
                if self.peek() in tuple("*+?{") and self.peek():
                    raise self.fail("nothing to repeat")
                continue
            parts.append(found)

    def repeat(self, part):
        sign = self.take()
        least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(sign, (0, 0))
        if sign == "{":
            told = re.compile(r"\s*([0-9]+)\s*(,\s*([0-9]*)\s*)?\}").match(self.text, self.at)
            if not told:
                raise self.fail("a bad count")
            self.at = told.end()
            least = int(told[1])
            most = least if told[2] is None else int(told[3]) if told[3] else None
            if most is not None and most < least:
                raise self.fail("a count that falls")
        self.blank()
        self.eat("?")  # greed doesn't matter
        return Repeated(part, least, most)

    def atom(self):
        sign = self.take()
        if sign == "(":
            return self.group()
        if sign == "[":
            return Characters(self.bracket(), self.flags["u"])
        if sign == "\\":
            return self.escape()
        if sign == ".":
            without = [] if self.flags["s"] else [(10, 10), (13, 13)] if self.flags["R"] else [(10, 10)]
            return Characters(others(without, LAST if self.flags["u"] else 0xFF), self.flags["u"])
        if sign == "^":
            if not self.flags["m"]:
                return Raw(r"\A")
            return Raw(r"(?:\A|(?<=\x0A)|(?<=\x0D)(?!\x0A))" if self.flags["R"] else r"(?:\A|(?<=\x0A))")
        if sign == "$":
            if not self.flags["m"]:
                return Raw(r"\z")
            return Raw(r"(?:\z|(?=\x0D)|(?<!\x0D)(?=\x0A))" if self.flags["R"] else r"(?:\z|(?=\x0A))")
        return self.literal(ord(sign))

    def literal(self, code: int):
        if not self.flags["u"] and code > 0x7F:
            return Row([Characters([(b, b)], False) for b in chr(code).encode()])
        return Characters(self.cased([(code, code)]), self.flags["u"])

    def cased(self, ranges: Ranges) -> Ranges:
        return any_case(ranges, self.flags["u"]) if self.flags["i"] else ranges

    def group(self):
        before = dict(self.flags)
        if self.eat("?"):
            if self.peek() in ("=", "!") or self.peek(2) in ("<=", "<!"):
                raise self.fail("look-around isn't supported")
            named = re.compile(r"P?<([A-Za-z_][\w.\[\]]*)>").match(self.text, self.at)
            if named:
                self.at = named.end()
            else:
                self.read_flags()
                if self.text[self.at - 1] == ")":
                    return None
        found = self.either()
        if not self.eat(")"):
            raise self.fail("an unclosed group")
        self.flags = before
        return found

    def read_flags(self) -> None:
        on, seen = True, 0
        while (sign := self.take()) not in ":)":
            if sign == "-" and on:
                on, seen = False, 0
            elif sign in self.flags:
                self.flags[sign] = on
                seen += 1
            else:
                raise self.fail("an unknown flag or group")
        if not seen and (sign == ")" or not on):
            raise self.fail("flags without a flag")

    def escape(self):
        sign = self.peek()
        if sign and sign in "AzbB<>":
            return Raw(self.assertion())
        found = self.escaped()
        return Characters(found, self.flags["u"]) if isinstance(found, list) else self.number(found)

    def number(self, code: tuple[int, bool]):
        value, of_byte = code
        if of_byte and not self.flags["u"]:
            return Characters(self.cased([(value, value)]), False)
        return self.literal(value)

    def assertion(self) -> str:
        sign = self.take()
        if sign in "Az":
            return "\\" + sign
        w = _ASCII_WORD
        start, end = f"(?<!{w})(?={w})", f"(?<={w})(?!{w})"
        if sign == "b":
            for name, text in (("{start}", start), ("{end}", end), ("{start-half}", f"(?<!{w})"), ("{end-half}", f"(?!{w})")):
                if self.eat(name):
                    return text
        return {"<": start, ">": end, "b": f"(?:{start}|{end})", "B": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"}[sign]

    def escaped(self) -> Ranges | tuple[int, bool]:
        """What stands after a backslash: a class, or a character and whether it was told by two hexadecimal digits."""
        sign = self.take()
        if sign in "dDsSwW":
            return self.perl(sign)
        if sign in "pP":
            name = self.take()
            if name == "{":
                end = self.text.find("}", self.at)
                if end < 0:
                    raise self.fail("an unclosed class name")
                name, self.at = self.text[self.at : end], end + 1
            if not self.flags["u"]:
                raise self.fail("a Unicode class where Unicode is off")
            return self.cased(self.property(name, sign == "P"))
        if sign in CONTROLS:
            return CONTROLS[sign], False
        if sign in "xuU":
            digits = {"x": 2, "u": 4, "U": 8}[sign]
            told = re.compile(r"\{([0-9A-Fa-f]+)\}" if self.peek() == "{" else f"([0-9A-Fa-f]{{{digits}}})").match(self.text, self.at)
            code = int(told[1], 16) if told else LAST + 1
            if code > LAST or _SURROGATES[0] <= code <= _SURROGATES[1]:
                raise self.fail("a bad character number")
            self.at = told.end()
            return code, True
        if sign.isdigit():
            raise self.fail("back-references aren't supported")
        if sign.isalpha() or not sign.isascii():
            raise self.fail(f"an unknown escape \\{sign}")
        return ord(sign), False

    def perl(self, sign: str) -> Ranges:
        wide = self.flags["u"]
        found = {"d": _category("Nd"), "s": _WHITE, "w": _word()}[sign.lower()] if wide else self.posix({"d": "digit", "s": "space", "w": "word"}[sign.lower()])
        return list(found) if sign.islower() else others(list(found), LAST if wide else 0xFF)

    @staticmethod
    def posix(name: str) -> Ranges:
        return [(ord(a), ord(b)) for a, b in zip(POSIX[name][::2], POSIX[name][1::2])]

    def property(self, name: str, negated: bool) -> Ranges:
        if name.startswith("^"):
            name, negated = name[1:], not negated
        plain = re.sub(r"[\s_-]", "", re.sub(r"^(gc|generalcategory|General_Category)\s*[=:]", "", name)).lower()
        short = CATEGORIES.get(plain) or next((x for x in {*CATEGORIES.values(), "Cs"} if x.lower() == plain), None)
        if plain == "any":
            found: Ranges = [(0, LAST)]
        elif plain == "ascii":
            found = [(0, 0x7F)]
        elif plain == "assigned":
            found = others(list(_category("Cn")), LAST)
        elif plain in ("whitespace", "space", "wspace"):
            found = list(_WHITE)
        elif short:
            found = list(_category(short))
        else:
            raise self.fail(f"an unknown class {name}")
        return others(found, LAST) if negated else found

    def bracket(self) -> Ranges:
        """The inside of a bracketed class, up to its end."""
        last = LAST if self.flags["u"] else 0xFF
        negated = self.eat("^")
        items: Ranges = []
        self.blank()
        first = True
        left: Ranges | None = None
        operation = ""

        def combined() -> Ranges:
            own = self.cased(items)
            if not operation:
                return own
            return both(left, own) if operation == "&&" else both(left, others(own, last)) if operation == "--" else merged(both(left, others(own, last)) + both(others(left, last), own))

        while True:
            self.blank()
            if not self.peek():
                raise self.fail("an unclosed class")
            if self.peek() == "]" and not first:
                self.at += 1
                found = merged(combined())
                return others(found, last) if negated else found
            first = False
            if self.peek(2) in ("&&", "--", "~~"):
                left, items, operation = combined(), [], self.peek(2)
                self.at += 2
                continue
            items = items + self.item()

    def item(self) -> Ranges:
        named = re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at)
        if named and named[2] in POSIX:
            self.at = named.end()
            found = self.posix(named[2])
            return others(found, LAST if self.flags["u"] else 0xFF) if named[1] else found
        if self.eat("["):
            return self.bracket()
        low = self.one()
        if isinstance(low, list):
            return low
        self.blank()
        if self.peek() == "-" and self.peek(2) not in ("-]", "--"):
            self.at += 1
            self.blank()
            high = self.one()
            if isinstance(high, list) or high < low:
                raise self.fail("a bad range of characters")
            return [(low, high)]
        return [(low, low)]

    def one(self) -> Ranges | int:
        sign = self.take()
        if sign != "\\":
            code = ord(sign)
        else:
            found = self.escaped()
            if isinstance(found, list):
                return found
            code, of_byte = found
            if of_byte and not self.flags["u"] and code <= 0xFF:
                return code
        if not self.flags["u"] and code > 0x7F:
            raise self.fail("a wide character in a class of bytes")
        return code


def java_pattern(pattern: str) -> str:
    """The Java pattern over bytes that finds what ``pattern`` finds; a malformed one is a PatternError.

    Unicode is on at first, lines end at LF, ``$`` alone is the text's end, and stacked
    quantifiers repeat each other.  Look-around and back-references don't exist.  Word
    boundaries know ASCII words only, and classes of scripts aren't known; both are the
    only parts of the language left out.
    """
    return _Parser(pattern).whole().java()
