"""A sandboxed template language: parsed into a syntax tree, constants folded, compiled into Python closures.

Language: text, {{ expression }}, {% if %} {% elif %} {% else %} {% endif %}, {% for x in list %} {% endfor %} (with
loop.first, loop.last, loop.index, loop.index0), {% set x = expression %}, {% generation %} {% endgeneration %}, and
{# comments #}. A mark that opens must close; dashes beside marks aren't in the language. Blocks, parentheses and nots
nest up to MOST_DEPTH, and an expression has MOST_TOKENS at most. Expressions: strings, integers, true, false, none, names, .field and ['field'] of mappings, filters,
+, ==, !=, <, <=, >, >=, in, and, or, not, and parentheses. There are no calls and no way to Python attributes: .field
only ever looks a key up, and filters are those that the caller names. Unknown names and fields are none, and print as
nothing; null texts are none too, and very long ones are values like any other. What the language doesn't have, and
values that an operator doesn't take (such as 'a' < 1), raise TemplateError.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that the language doesn't have."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass
class Rendered:
    """Pieces of the result, and where generation is marked, in code points."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.()\[\]=]))")
QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""  # a closing mark inside a string closes nothing
SPLIT = re.compile(r"(\{\{(?:" + QUOTED + r"|.)*?\}\}|\{%(?:" + QUOTED + r"|.)*?%\}|\{#.*?#\})", re.S)
MOST_DEPTH, MOST_TOKENS = 40, 300
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
COMPARE: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: b is not None and a in b}


class Expression:
    """Precedence, from the loosest: or, and, not, comparison, +, filter, field."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not an expression: {source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0
        if len(self.tokens) > MOST_TOKENS:
            raise TemplateError(f"more than {MOST_TOKENS} words and marks: {self.source[:40]!r}")

    def deeper(self, parse: Callable) -> Any:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError(f"nested more than {MOST_DEPTH} deep: {self.source[:40]!r}")
        out = parse()
        self.depth -= 1
        return out

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError(f"ends early: {self.source!r}")
        k, v = self.tokens[self.at]
        if kind and k != kind or value and v != value:
            raise TemplateError(f"{v!r} isn't expected in {self.source!r}")
        self.at += 1
        return v

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} isn't expected in {self.source!r}")
        return out

    def chain(self, names: tuple[str, ...], below: Callable) -> Any:
        out = below()
        while self.peek(*names):
            out = Binary(self.take(), out, below())
        return out

    def either(self) -> Any:
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self) -> Any:
        if self.peek("not"):
            self.take()
            return Unary(self.deeper(self.negated))
        return self.chain(tuple(COMPARE), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> Any:
        out = self.primary()
        while self.peek("|"):
            self.take()
            out = Filter(out, self.take("name"))
        return out

    def primary(self) -> Any:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if value == "(":
            self.take()
            out = self.deeper(self.either)
            self.take("op", ")")
        elif kind == "string":
            self.take()
            out = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "number":
            out = Const(int(self.take()))
        else:
            name = self.take("name")
            out = Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)
        while self.peek(".", "["):
            if self.take() == ".":
                out = Item(out, Const(self.take("name")))
            else:
                out = Item(out, self.deeper(self.either))
                self.take("op", "]")
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [(k % 2 == 1, p) for k, p in enumerate(SPLIT.split(source)) if p and not (k % 2 and p.startswith("{#"))]
    at = depth = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at, depth
        out: list[Any] = []
        depth += 1
        if depth > MOST_DEPTH:
            raise TemplateError(f"blocks nest more than {MOST_DEPTH} deep")
        while at < len(parts):
            (is_tag, part), at = parts[at], at + 1
            if not is_tag:
                if unclosed := re.search(r"\{[{%#]", part):
                    raise TemplateError(f"never closed: {part[unclosed.start() : unclosed.start() + 40]!r}")
                out.append(Text(part))
            elif part.startswith("{{"):
                out.append(Output(Expression(part[2:-2]).whole()))
            else:
                word, _, rest = part[2:-2].strip(" \t\n").partition(" ")
                if word in ends:
                    depth -= 1
                    return tuple(out), word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        depth -= 1
        return tuple(out), "", ""

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            return condition(rest)
        if word == "for":
            name, _, of = rest.partition(" in ")
            body, _, _ = block("endfor")
            return For(plain_name(name), Expression(of).whole(), body)
        if word == "set":
            name, _, of = rest.partition("=")
            return Assign(plain_name(name), Expression(of).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no such statement: {word!r}")

    def condition(rest: str) -> If:
        cases, word = [], "elif"
        while word == "elif":
            test = Expression(rest).whole()
            then, word, rest = block("elif", "else", "endif")
            cases.append((test, then))
        if len(cases) > MOST_DEPTH:
            raise TemplateError(f"more than {MOST_DEPTH} cases of one if")
        other = block("endif")[0] if word == "else" else ()
        for test, then in reversed(cases):
            other = (If(test, then, other),)
        return other[0]

    return block()[0]


def plain_name(name: str) -> str:
    if not re.fullmatch(r"\s*[A-Za-z]\w*\s*", name):
        raise TemplateError(f"not a name: {name!r}")
    return name.strip()


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b)


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree without what is known beforehand: constant expressions, decided conditions, texts side by side."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.of, Const):
                    y = Text(shown(y.of.value))
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not isinstance(y, Text) or y.text:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.of, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.of, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, For):
        of = fold(node.of, filters)
        return () if isinstance(of, Const) and not of.value else For(node.name, of, fold(node.body, filters))
    if isinstance(node, If):
        test, then, other = fold(node.test, filters), fold(node.then, filters), fold(node.other, filters)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    parts = [fold(x, filters) for x in (getattr(node, k) for k in ("of", "key", "left", "right") if hasattr(node, k))]
    if isinstance(node, Item):
        return Item(*parts)
    if isinstance(node, Filter):
        node = Filter(parts[0], node.name)
    elif isinstance(node, Unary):
        node = Unary(parts[0])
    elif isinstance(node, Binary):
        node = Binary(node.op, *parts)
    if parts and all(isinstance(p, Const) for p in parts):
        return Const(evaluator(node, filters)({}))
    return node


def evaluator(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that evaluates an expression in an environment."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Item):
        of, key = evaluator(node.of, filters), evaluator(node.key, filters)
        return lambda env: x.get(key(env)) if isinstance(x := of(env), Mapping) else None
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no such filter: {node.name!r}")
        of, f = evaluator(node.of, filters), filters[node.name]

        def filtered(env: dict) -> Any:
            x = of(env)
            try:
                return f(x)
            except TypeError as e:
                raise TemplateError(f"{node.name} doesn't take {x!r}") from e

        return filtered
    if isinstance(node, Unary):
        of = evaluator(node.of, filters)
        return lambda env: not of(env)
    left, right = evaluator(node.left, filters), evaluator(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    f = plus if node.op == "+" else COMPARE[node.op]

    def both(env: dict) -> Any:
        a, b = left(env), right(env)
        try:
            return f(a, b)
        except TypeError as e:
            raise TemplateError(f"{node.op} doesn't take {a!r} and {b!r}") from e

    return both


def writer(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Rendered], None]:
    """A closure that renders a node."""
    if isinstance(node, tuple):
        steps = [writer(x, filters) for x in node]
        if len(steps) == 1:
            return steps[0]

        def block(env: dict, out: Rendered) -> None:
            for step in steps:
                step(env, out)

        return block
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.write(t)
    if isinstance(node, Output):
        of = evaluator(node.of, filters)
        return lambda env, out: out.write(shown(of(env)))
    if isinstance(node, Assign):
        of, name = evaluator(node.of, filters), node.name
        return lambda env, out: env.__setitem__(name, of(env))
    if isinstance(node, If):
        test, then, other = evaluator(node.test, filters), writer(node.then, filters), writer(node.other, filters)
        return lambda env, out: (then if test(env) else other)(env, out)
    if isinstance(node, Generation):
        body = writer(node.body, filters)

        def marked(env: dict, out: Rendered) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return marked
    of, body, name = evaluator(node.of, filters), writer(node.body, filters), node.name

    def loop(env: dict, out: Rendered) -> None:
        value = of(env) or ()
        if not isinstance(value, list | tuple):
            raise TemplateError(f"for takes a list, not {value!r}")
        rows = list(value)
        own = dict(env)
        for i, x in enumerate(rows):
            own[name] = x
            own["loop"] = {"index": i + 1, "index0": i, "first": not i, "last": i == len(rows) - 1}
            body(own, out)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that returns its text and its generation spans."""
    filters = {"trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": lambda x: len(x or ())} | dict(filters or {})
    run = writer(fold(parse(source), filters), filters)

    def render(**variables: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Rendered()
        run(dict(variables), out)
        return "".join(out.pieces), out.spans

    return render
