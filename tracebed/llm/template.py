"""A small template language: parsed to a syntax tree, constants folded, compiled to Python closures.

    {{ expr }}   {% for x in expr %} {% endfor %}   {% if %} {% elif %} {% else %} {% endif %}   {% set x = expr %}
    {% generation %} {% endgeneration %}   {# comment #}   a dash inside a delimiter strips white space on its side

Expressions have literals, names, fields of mappings (a.b, a['b']), ==, !=, in, not, and, or, +, `x if c else y` and
filters. There is no call, no attribute of a Python object and no filter but those handed in, so a template reaches
nothing but its variables. Rendering is a stream of events: text, or True and False where a generation begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Event = str | bool


class TemplateError(ValueError):
    pass


# --- syntax tree ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """op: ==, !=, in, +, and, or, not, if."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing ----------------------------------------------------------------------------------------------------------

PARTS = re.compile(r"(\s*\{%-|\{%|\s*\{\{-|\{\{|\s*\{#-|\{#)(.*?)(-%\}\s*|%\}|-\}\}\s*|\}\}|-#\}\s*|#\})", re.S)
TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+\[\]()]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CLOSE = {"%": "%}", "{": "}}", "#": "#}"}


def lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in PARTS.finditer(source):
        kind = m[1].strip()[1]
        if CLOSE[kind] not in m[3]:
            raise TemplateError(f"{m[1].strip()} is closed by {m[3].strip()}")
        if m.start() > at:
            out.append(("text", source[at : m.start()]))
        if kind != "#":
            out.append(("block" if kind == "%" else "output", m[2].strip()))
        at = m.end()
    if at < len(source):
        out.append(("text", source[at:]))
    return out


class Expression:
    """Recursive descent over the tokens of an expression."""

    KEYWORDS = {"and", "or", "not", "in", "if", "else"}

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"{source!r} can't be read from {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return out

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("op", "name") else None

    def take(self, *values: str) -> str | None:
        if (v := self.peek()) in values and v is not None:
            self.at += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("if", (test, value, self.choice()))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Op("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        value = self.added()
        while op := self.take("==", "!=", "in", "not"):
            if op == "not":
                self.need("in")
                value = Op("not", (Op("in", (value, self.added())),))
            else:
                value = Op(op, (value, self.added()))
        return value

    def added(self) -> Any:
        value = self.filtered()
        while self.take("+"):
            value = Op("+", (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.single()
        while op := self.take("|", ".", "["):
            if op == "[":
                value = Field(value, self.choice())
                self.need("]")
            else:
                name = self.identifier()
                value = Filter(name, value) if op == "|" else Field(value, Const(name))
        return value

    def identifier(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def single(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(value))
        if kind == "name" and value not in self.KEYWORDS:
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        raise TemplateError(f"{value!r} is out of place")


def parse(source: str) -> tuple:
    items, at = lex(source), 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(items):
            kind, value = items[at]
            at += 1
            word, _, rest = value.partition(" ")
            if kind == "text":
                out.append(Text(value))
            elif kind == "output":
                out.append(Output(Expression(value).whole()))
            elif word in ends:
                return tuple(out), value
            elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                out.append(For(m[1], Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.+)", rest, re.S)):
                out.append(Set(m[1], Expression(m[2]).whole()))
            elif value == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"{value!r} is not a statement here")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return tuple(out), ""

    def branch(test: str) -> If:
        yes, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(Expression(test).whole(), yes, (branch(end[4:]),))
        return If(Expression(test).whole(), yes, body("endif")[0] if end == "else" else ())

    return body()[0]


# --- folding --------------------------------------------------------------------------------------------------------

OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: b is not None and a in b, "+": lambda a, b: a + b, "not": lambda a: not a}


def show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """What does not depend on a variable is evaluated; choices between constants are made; texts that meet are joined."""
    go = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list = []
        for x in map(go, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"there is no filter {node.name!r}")
        of = go(node.of)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Field):
        return Field(go(node.of), go(node.key))
    if isinstance(node, Op):
        args = tuple(map(go, node.args))
        if node.op == "if":
            return (args[1] if args[0].value else args[2]) if isinstance(args[0], Const) else Op("if", args)
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
            return Op(node.op, args)
        return Const(OPS[node.op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Output):
        expr = go(node.expr)
        return Text(show(expr.value)) if isinstance(expr, Const) else Output(expr)
    if isinstance(node, If):
        test = go(node.test)
        return go(node.yes if test.value else node.no) if isinstance(test, Const) else If(test, go(node.yes), go(node.no))
    if isinstance(node, For):
        return For(node.name, go(node.over), go(node.body))
    if isinstance(node, Set):
        return Set(node.name, go(node.expr))
    if isinstance(node, Generation):
        return Generation(go(node.body))
    return node


# --- closures ---------------------------------------------------------------------------------------------------------


def evaluator(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Field):
        of, key = evaluator(node.of, filters), evaluator(node.key, filters)

        def field(env: dict) -> Any:
            value = of(env)
            return value.get(key(env)) if isinstance(value, Mapping) else None

        return field
    if isinstance(node, Filter):
        inner, f = evaluator(node.of, filters), filters[node.name]
        return lambda env: f(inner(env))
    args = [evaluator(a, filters) for a in node.args]
    if node.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = OPS[node.op]
    return lambda env: f(*[a(env) for a in args])


def renderer(nodes: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[Event]]:
    steps = [statement(n, filters) for n in nodes]

    def render(env: dict) -> Iterator[Event]:
        for step in steps:
            yield from step(env)

    return steps[0] if len(steps) == 1 else render


def statement(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[Event]]:
    if isinstance(node, Text):
        return lambda env, v=node.value: iter((v,))
    if isinstance(node, Output):
        value = evaluator(node.expr, filters)
        return lambda env: iter((show(value(env)),))
    if isinstance(node, If):
        test, yes, no = evaluator(node.test, filters), renderer(node.yes, filters), renderer(node.no, filters)
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, For):
        over, body = evaluator(node.over, filters), renderer(node.body, filters)

        def loop(env: dict) -> Iterator[Event]:
            for value in over(env) or ():
                yield from body(env | {node.name: value})

        return loop
    if isinstance(node, Set):
        given = evaluator(node.expr, filters)

        def put(env: dict) -> Iterator[Event]:
            env[node.name] = given(env)
            return iter(())

        return put
    inner = renderer(node.body, filters)

    def generation(env: dict) -> Iterator[Event]:
        yield True
        yield from inner(env)
        yield False

    return generation


def compiled(source: str, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[Event]]:
    return renderer(fold(parse(source), filters), filters)
