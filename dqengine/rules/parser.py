"""Lexer and recursive-descent parser of the rule language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ParsingError(ValueError):
    """The text isn't a ruleset."""


TOKEN = re.compile(r"""\s+|\#[^\n]*|"(?:[^"\\]|\\.)*"|\d{4}-\d\d-\d\d|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|!=|>=|<=|[=<>()\[\],*/+-]|[A-Za-z_][A-Za-z0-9_]*""")
WORDS = {"NULL", "EMPTY", "WHITESPACES_ONLY"}
TESTS = ("!=", ">=", "<=", "=", ">", "<")


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, number, date, sign
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Operand:
    """A literal: number, string, keyword, date, duration, or the moment now less a duration; text is how it was written."""

    kind: str
    value: Any
    text: str = field(compare=False, default="")


@dataclass(frozen=True)
class Condition:
    """test: one of = != > >= < <=, between, in, matches; negated only for the last three."""

    test: str
    operands: tuple[Operand, ...]
    negated: bool = False

    @property
    def kinds(self) -> set[str]:
        return {o.kind for o in self.operands}


@dataclass(frozen=True)
class Rule:
    kind: str
    parameters: tuple[str, ...] = ()
    condition: Condition | None = None
    where: str | None = None
    threshold: Condition | None = None
    tags: tuple[tuple[str, Any], ...] = ()
    operator: str | None = None  # and, or: of a composite
    nested: tuple[Rule, ...] = ()
    text: str = field(default="", compare=False)

    def tag(self, name: str) -> Any:
        return dict(self.tags).get(name)

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...]


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParsingError(f"Parsing Error: unexpected {text[at]!r} at {at}")
        s = m.group()
        if not s[0].isspace() and s[0] != "#":
            kind = "string" if s[0] == '"' else "date" if re.fullmatch(r"\d{4}-\d\d-\d\d", s) else "number" if s[0].isdigit() else "word" if s[0].isalpha() or s[0] == "_" else "sign"
            found.append(Token(kind, s, at, m.end()))
        at = m.end()
    return found


def unescape(text: str) -> str:
    """A quoted string's content; only quotes and backslashes before quotes are escapes, so patterns stay as written."""
    return text[1:-1].replace('\\"', '"')


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    def peek(self, ahead: int = 0) -> Token | None:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else None

    def next(self) -> Token:
        t = self.peek()
        if t is None:
            raise ParsingError("Parsing Error: unexpected end of the ruleset")
        self.at += 1
        return t

    def sees(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.kind in ("word", "sign") and t.text.lower() in texts

    def take(self, text: str) -> Token:
        t = self.next()
        if t.kind not in ("word", "sign") or t.text.lower() != text.lower():
            raise ParsingError(f"Parsing Error: expected {text!r} but found {t.text!r} at {t.start}")
        return t

    def ruleset(self) -> Ruleset:
        self.take("rules")
        self.take("=")
        self.take("[")
        rules = []
        while not self.sees("]"):
            rules.append(self.rule())
            if self.sees(","):
                self.take(",")
            elif not self.sees("]"):
                raise ParsingError(f"Parsing Error: expected ',' or ']' but found {self.next().text!r}")
        self.take("]")
        if self.peek() is not None:
            raise ParsingError(f"Parsing Error: unexpected {self.peek().text!r} after the rules")
        if not rules:
            raise ParsingError("Parsing Error: a ruleset needs a rule")
        return Ruleset(tuple(rules))

    def rule(self) -> Rule:
        start = self.peek().start if self.peek() else 0
        if self.sees("("):
            return self.composite(start)
        kind = self.next()
        if kind.kind != "word":
            raise ParsingError(f"Parsing Error: expected a rule but found {kind.text!r} at {kind.start}")
        parameters = []
        while self.peek() is not None and (self.peek().kind == "string" or self._bare()):
            t = self.next()
            parameters.append(unescape(t.text) if t.kind == "string" else t.text)
        condition = self.condition() if self._condition_ahead() else None
        where = threshold = None
        tags: list[tuple[str, Any]] = []
        while self.sees("where", "with"):
            if self.next().text.lower() == "where":
                t = self.next()
                if t.kind != "string":
                    raise ParsingError(f"Parsing Error: expected a quoted condition but found {t.text!r}")
                where = unescape(t.text)
            elif self.sees("threshold"):
                self.next()
                threshold = self.condition()
            else:
                name = self.next().text
                self.take("=")
                if self.sees("["):
                    tags.append((name, tuple(o.value for o in self.listed())))
                else:
                    t = self.next()
                    tags.append((name, unescape(t.text) if t.kind == "string" else t.text))
        return Rule(kind.text, tuple(parameters), condition, where, threshold, tuple(tags), text=self.text[start : self.tokens[self.at - 1].end])

    def _bare(self) -> bool:
        """A column name without quotes."""
        t = self.peek()
        return t.kind == "word" and t.text.lower() not in ("not", "in", "between", "matches", "where", "with", "and", "or") and t.text not in WORDS

    def composite(self, start: int) -> Rule:
        parts, operator = [self.parenthesised()], None
        while self.sees("and", "or"):
            word = self.next().text.lower()
            if operator not in (None, word):
                raise ParsingError("Parsing Error: and/or can't be mixed without parentheses")
            operator = word
            parts.append(self.parenthesised())
        if operator is None:
            return parts[0]
        return Rule("Composite", operator=operator, nested=tuple(parts), text=self.text[start : self.tokens[self.at - 1].end])

    def parenthesised(self) -> Rule:
        self.take("(")
        rule = self.rule()
        self.take(")")
        return rule

    def _condition_ahead(self) -> bool:
        return self.sees(*TESTS, "between", "in", "matches", "not")

    def condition(self) -> Condition:
        negated = False
        if self.sees("not"):
            self.next()
            negated = True
        t = self.next()
        word = t.text.lower()
        if word in TESTS and not negated:
            return Condition(word, (self.operand(),))
        if word == "between":
            a = self.operand()
            self.take("and")
            return Condition("between", (a, self.operand()), negated)
        if word == "in":
            return Condition("in", tuple(self.listed()), negated)
        if word == "matches":
            return Condition("matches", (self.operand(),), negated)
        raise ParsingError(f"Parsing Error: expected a condition but found {t.text!r} at {t.start}")

    def listed(self) -> list[Operand]:
        self.take("[")
        found = []
        while not self.sees("]"):
            found.append(self.operand())
            if not self.sees("]"):
                self.take(",")
        self.take("]")
        return found

    def operand(self) -> Operand:
        start = self.peek().start if self.peek() else 0
        value = self.sum()
        return Operand(value.kind, value.value, self.text[start : self.tokens[self.at - 1].end])

    def sum(self) -> Operand:
        left = self.product()
        while self.sees("+", "-"):
            sign = self.next().text
            left = self.combine(left, sign, self.product())
        return left

    def product(self) -> Operand:
        left = self.atom()
        while self.sees("*", "/"):
            sign = self.next().text
            left = self.combine(left, sign, self.atom())
        return left

    def combine(self, a: Operand, sign: str, b: Operand) -> Operand:
        if a.kind == "number" and b.kind == "number":
            if sign == "/" and b.value == 0:
                raise ParsingError("Parsing Error: division by zero")
            return Operand("number", {"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[sign] if sign != "/" else a.value / b.value)
        if a.kind == "now" and b.kind == "duration" and sign in "+-":
            return Operand("now", a.value + (b.value if sign == "+" else -b.value))
        raise ParsingError(f"Parsing Error: {a.kind} {sign} {b.kind} has no value")

    def atom(self) -> Operand:
        t = self.next()
        if t.kind == "string":
            return Operand("string", unescape(t.text))
        if t.kind == "date":
            return Operand("date", t.text)
        if t.kind == "sign" and t.text == "-":
            inner = self.atom()
            if inner.kind not in ("number", "duration"):
                raise ParsingError(f"Parsing Error: -{inner.kind} has no value")
            return Operand(inner.kind, -inner.value)
        if t.kind == "sign" and t.text == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if t.kind == "number":
            hours = {"minute": 1 / 60, "hour": 1.0, "day": 24.0}
            if self.peek() is not None and self.peek().kind == "word" and (unit := self.peek().text.lower().removesuffix("s")) in hours:
                self.next()
                return Operand("duration", float(t.text) * hours[unit])
            return Operand("number", float(t.text))
        if t.kind == "word" and t.text in WORDS:
            return Operand("keyword", t.text)
        if t.kind == "word" and t.text.lower() == "now":
            self.take("(")
            self.take(")")
            return Operand("now", 0.0)
        if t.kind == "word" and t.text.lower() in ("true", "false"):
            return Operand("string", t.text)
        raise ParsingError(f"Parsing Error: expected a value but found {t.text!r} at {t.start}")


def parse(text: str) -> Ruleset:
    """The rules of a text; raises a ParsingError, which is a ValueError."""
    return _Parser(text).ruleset()
