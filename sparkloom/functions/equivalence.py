"""Whether two written answers are one: structures part by part, expressions by their values to 40 digits.

An answer is a set, a list (both in any order), a tuple or an interval with its brackets, a union of such, a choice of signs, or an expression
over numbers, letters, roots, powers, fractions and the functions below. Expressions in letters are compared at several points.
"""

from __future__ import annotations

import re
from decimal import Context, Decimal, DecimalException, localcontext
from functools import lru_cache

#: Digits that are worked out, and the relative difference up to which values count as equal.
DIGITS, CLOSE = 60, Decimal("1e-40")
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534")
TOKEN = re.compile(r"\s*(?:(?P<number>\d[\d,]*(?:\.\d+)?|\.\d+)|\\?(?P<word>sqrt|frac|pi|sin|cos|tan|exp|ln|log|abs|cdot|times|div)(?![A-Za-z])|(?P<letter>[A-Za-z])|(?P<sign>\*\*|[-+*/^(){}\[\]|]))")
#: Commands that only set spaces or signs, units of a degree, and signs under another form.
PLAIN = ((r"\\(?:left|right|displaystyle|,|;|!|:| |quad|qquad)", ""), (r"\\(?:text|mathrm|mbox)\s*\{[^{}]*\}", ""), (r"\\[dt]frac", r"\\frac"), ("[\u2212\u2013]", "-"), ("\u03c0", r"\\pi"), ("\u221a", r"\\sqrt"), ("\u221e", r"\\infty"), ("\u222a", r"\\cup"), (r"\^\s*\{?\s*\\circ\s*\}?|\u00b0", ""), (r"[$]|\\[()\[\]]", ""))
#: Values of letters at which expressions are compared.
POINTS = tuple(Decimal(p) for p in ("0.7310585786300049", "1.6180339887498949", "2.2360679774997897", "3.3166247903553998"))
SAME_SIGN = {"cdot": "*", "times": "*", "div": "/", "**": "^"}
DEEPEST, LARGEST_POWER = 60, 400
#: What any of the PLAIN patterns needs.
MARKED = re.compile("[\\\\$\u2212\u2013\u03c0\u221a\u221e\u222a\u00b0]")


class Unread(ValueError):
    """Text that is no expression, or one without a real value."""


@lru_cache(1024)  # the points are few, and so are what most answers take functions of
def turned(x: Decimal) -> tuple[Decimal, Decimal]:
    """(sin x, cos x) by their series, after taking off whole turns."""
    x = x - (x / (2 * PI)).to_integral_value() * 2 * PI
    sine, cosine, term, k = Decimal(0), Decimal(0), Decimal(1), 0
    while abs(term) > Decimal(10) ** -DIGITS or k < 4:
        part = term if k % 4 < 2 else -term
        cosine, sine = (cosine + part, sine) if k % 2 == 0 else (cosine, sine + part)
        k += 1
        term = term * x / k
    return sine, cosine


FUNCTIONS = {
    "sqrt": lambda x: x.sqrt(), "exp": lambda x: x.exp(), "ln": lambda x: x.ln(), "log": lambda x: x.log10(), "abs": abs,
    "sin": lambda x: turned(x)[0], "cos": lambda x: turned(x)[1], "tan": lambda x: turned(x)[0] / turned(x)[1],
}


class Value:
    """The value of tokens at a point; reads from the left, by how tightly signs bind."""

    def __init__(self, tokens: list[tuple[str, str]], point: dict[str, Decimal]):
        self.tokens, self.at, self.depth, self.point = tokens, 0, 0, point

    def whole(self) -> Decimal:
        value = self.sum()
        if self.at < len(self.tokens):
            raise Unread("rest")
        return value

    def next(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str | None:
        if self.next() and (not wanted or self.next() in wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def sum(self) -> Decimal:
        value = self.product()
        while sign := self.take("+", "-"):
            other = self.product()
            value = value + other if sign == "+" else value - other
        return value

    def product(self) -> Decimal:
        value = self.signed()
        while True:
            if sign := self.take("*", "/"):
                other = self.signed()
                value = value * other if sign == "*" else value / other
            elif self.next() and self.next() not in ("+", "-", "^", ")", "}", "]", "|"):
                value = value * self.power()  # a sign left out
            else:
                return value

    def signed(self) -> Decimal:
        sign = self.take("+", "-")
        return self.power() if sign is None else -self.signed() if sign == "-" else self.signed()

    def power(self) -> Decimal:
        value = self.atom()
        if not self.take("^"):
            return value
        power = self.grouped() if self.next() == "{" else self.signed()
        if abs(power) > LARGEST_POWER:
            raise Unread("power")
        if value < 0 and power == power.to_integral_value():
            return value ** int(power)
        return value**power

    def grouped(self) -> Decimal:
        close = {"(": ")", "{": "}", "[": "]", "|": "|"}.get(self.take() or "")
        self.depth += 1
        if close is None or self.depth > DEEPEST:
            raise Unread("bracket")
        value = self.sum()
        if self.take() != close:
            raise Unread("bracket")
        self.depth -= 1
        return abs(value) if close == "|" else value

    def atom(self) -> Decimal:
        kind, shown = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "number":
            self.at += 1
            return Decimal(shown.replace(",", ""))
        if kind == "letter":
            self.at += 1
            if shown not in self.point:
                raise Unread(shown)
            return self.point[shown]
        if kind == "word":
            self.at += 1
            if shown == "pi":
                return PI
            if shown == "frac":
                above = self.grouped()
                return above / self.grouped()
            root = self.grouped() if shown == "sqrt" and self.next() == "[" else None
            value = self.grouped() if self.next() in ("(", "{", "[") else self.power()
            return FUNCTIONS[shown](value) if root is None else -((-value) ** (1 / root)) if value < 0 and root % 2 == 1 else value ** (1 / root)
        return self.grouped()


def tokens_of(text: str) -> list[tuple[str, str]]:
    """(kind, token) in order; Unread for anything else."""
    out, end, text = [], 0, text.rstrip()
    while end < len(text):
        found = TOKEN.match(text, end)
        if not found:
            raise Unread(text)
        end = found.end()
        out.append((found.lastgroup, SAME_SIGN.get(found[found.lastgroup], found[found.lastgroup])))
    return out


def values(text: str, letters: list[str]) -> list[Decimal | None]:
    """The values at all points, None where there is none; Unread if there is none anywhere."""
    out: list[Decimal | None] = []
    tokens = tokens_of(text)
    with localcontext(Context(prec=DIGITS)):
        for k in range(len(POINTS) if letters else 1):
            try:
                out.append(Value(tokens, {n: POINTS[(k + i) % len(POINTS)] + i for i, n in enumerate(letters)}).whole())
            except (DecimalException, ZeroDivisionError, OverflowError):
                out.append(None)
    if all(x is None for x in out):
        raise Unread(text)
    return out


def parts_of(text: str, at: str) -> list[str]:
    """The text cut at characters outside all brackets; commas within digit groups don't cut."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c in at and depth <= 0 and not (c == "," and re.match(r"\d,\d{3}(?!\d)", text[max(i - 1, 0) : i + 5])):
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def structure(text: str) -> tuple:
    """(kind, parts): a set of answers in any order, an ordered pair or tuple with its brackets, or an expression."""
    for pattern, plain in PLAIN if MARKED.search(text) else ():
        text = re.sub(pattern, plain, text)
    text = text.strip().rstrip(".").strip()
    text = re.sub(r"^[A-Za-z]\s*(?:=|\\in\b)", "", text).strip()
    unions = re.split(r"\\cup\b", text)
    if len(unions) > 1:
        return "set", [structure(u) for u in unions]
    if "\\pm" in text:
        return "set", [structure(text.replace("\\pm", sign)) for sign in "+-"]
    if text.startswith("\\{") and text.endswith("\\}"):
        return "set", [structure(p) for p in parts_of(text[2:-2], ",;") if p.strip()]
    if text[:1] in "([" and text[-1:] in ")]" and len(found := parts_of(text[1:-1], ",;")) > 1 and len(parts_of(text, ",;")) == 1:
        return text[0] + text[-1], [structure(p) for p in found]
    if len(found := parts_of(text.replace(" and ", ","), ",;")) > 1:
        return "set", [structure(p) for p in found if p.strip()]
    return "value", text


def same(a: tuple, b: tuple) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == "value":
        if "infty" in a[1] + b[1]:
            return re.sub(r"[\s+]", "", a[1]) == re.sub(r"[\s+]", "", b[1])
        free = lambda t: set(re.findall(r"[A-Za-z]", re.sub(r"\\?(?:sqrt|frac|pi|sin|cos|tan|exp|ln|log|abs|cdot|times|div)(?![A-Za-z])", "", t)))
        letters = sorted(free(a[1]) | free(b[1]))
        try:
            pairs = list(zip(values(a[1], letters), values(b[1], letters), strict=True))
        except (Unread, RecursionError):
            return False
        return all((x is None) == (y is None) and (x is None or abs(x - y) <= CLOSE * max(1, abs(x), abs(y))) for x, y in pairs)
    if len(a[1]) != len(b[1]):
        return False
    if a[0] != "set":
        return all(same(x, y) for x, y in zip(a[1], b[1], strict=True))
    rest = list(b[1])
    for x in a[1]:
        hit = next((i for i, y in enumerate(rest) if same(x, y)), None)
        if hit is None:
            return False
        del rest[hit]
    return True


def same_answer(x: str, y: str) -> bool:
    """Whether two answers are one. Neither an empty nor an unreadable one is any answer's equal, unless both are the same text."""
    return x.strip() == y.strip() or same(structure(x), structure(y))
