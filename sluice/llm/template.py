"""A small sandboxed template language, compiled to Python closures.

Text stands for itself. Tags:

    {{ expression }}                      writes a value
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% for name in messages %} ... {% endfor %}     at the top level, over the turns
    {% generation %} ... {% endgeneration %}        marks what a model should learn to write

Expressions have string literals, names, name.field, loop.index0, loop.first, ==, !=, not, and, or, +, parentheses,
and filters (value | filter) from a fixed set. There are no calls, subscripts or other attributes, so a template
reaches nothing but the turns' own fields. Operations on constants are done when compiling, and neighbouring
constant texts are joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TAGS = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|().+]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template is not in the language."""


# Syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None


@dataclass(frozen=True)
class Op:
    sign: str  # ==, !=, and, or, +, not, or a filter's name
    parts: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """A recursive-descent reader of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]]):
        self.tokens: list[tuple[str, str]] = []
        self.at, self.filters = 0, filters
        place = 0
        while source[place:].strip():
            found = _TOKENS.match(source, place)
            if not found:
                raise TemplateError(f"unreadable expression: {source[place:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def _take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def read(self) -> object:
        made = self._either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return made

    def _either(self) -> object:
        made = self._both()
        while self._take("or"):
            made = fold(Op("or", (made, self._both())))
        return made

    def _both(self) -> object:
        made = self._negated()
        while self._take("and"):
            made = fold(Op("and", (made, self._negated())))
        return made

    def _negated(self) -> object:
        return fold(Op("not", (self._negated(),))) if self._take("not") else self._compared()

    def _compared(self) -> object:
        made = self._joined()
        while sign := self._take("==", "!="):
            made = fold(Op(sign, (made, self._joined())))
        return made

    def _joined(self) -> object:
        made = self._filtered()
        while self._take("+"):
            made = fold(Op("+", (made, self._filtered())))
        return made

    def _filtered(self) -> object:
        made = self._atom()
        while self._take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            made = Const(self.filters[name](_text(made.value))) if isinstance(made, Const) else Op(f"|{name}", (made,))
        return made

    def _atom(self) -> object:
        if self._take("("):
            made = self._either()
            if not self._take(")"):
                raise TemplateError("missing )")
            return made
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        if self._take("."):
            kind, field = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or field.startswith("_"):
                raise TemplateError(f"unusable field {field!r}")
            self.at += 1
            return Name(value, field)
        return Name(value, None)


def _text(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
}


def fold(node: Op) -> object:
    """The operation, or its value where its parts are constant."""
    if node.sign in ("and", "or") and isinstance(node.parts[0], Const):
        return node.parts[1] if bool(node.parts[0].value) == (node.sign == "and") else node.parts[0]
    if node.sign in _OPERATIONS and all(isinstance(p, Const) for p in node.parts):
        return Const(_OPERATIONS[node.sign](*(p.value for p in node.parts)))
    return node


def parse(source: str, filters: dict[str, Callable[[str], str]]) -> tuple:
    """The template's syntax tree, with constants folded."""
    pieces: list[tuple[str, str]] = []
    place = 0
    for tag in _TAGS.finditer(source):
        pieces.append(("text", source[place : tag.start()]))
        pieces.append(("tag", tag[1]) if tag[1] is not None else ("write", tag[2]))
        place = tag.end()
    pieces.append(("text", source[place:]))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        made: list = []

        def add(node: object) -> None:
            if isinstance(node, Write) and isinstance(node.value, Const):
                text = _text(node.value.value)
                if made and isinstance(made[-1], Write) and isinstance(made[-1].value, Const):
                    text = _text(made.pop().value.value) + text
                if text:
                    made.append(Write(Const(text)))
            else:
                made.append(node)

        while at < len(pieces):
            kind, value = pieces[at]
            at += 1
            if kind == "text":
                add(Write(Const(value)))
            elif kind == "write":
                add(Write(_Expression(value, filters).read()))
            elif value.split(" ", 1)[0] in ends:
                return tuple(made), value
            elif value.startswith("if "):
                for node in branch(value[3:]):
                    add(node)
            elif found := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", value):
                if ends:
                    raise TemplateError("for stands at the top level only")
                add(For(found[1], block("endfor")[0]))
            elif value == "generation":
                add(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(made), ""

    def branch(condition: str) -> tuple:
        test = _Expression(condition, filters).read()
        then, end = block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif "):
            other = branch(end[5:])
        elif end == "else":
            other = block("endif")[0]
        if isinstance(test, Const):
            return then if test.value else other
        return (If(test, then, other),)

    return block()[0]


# Closures --------------------------------------------------------------------------------------------------------


class Output:
    """The rendered text and the spans (start, end) that generation tags mark, in characters."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(node: object, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name, field = node.name, node.field
        if field is None:
            return lambda names: names.get(name)
        return lambda names: names.get(name, {}).get(field)
    parts = [_value(p, filters) for p in node.parts]
    if node.sign == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if node.sign == "or":
        return lambda names: parts[0](names) or parts[1](names)
    if node.sign.startswith("|"):
        filtered = filters[node.sign[1:]]
        return lambda names: filtered(_text(parts[0](names)))
    operation = _OPERATIONS[node.sign]
    return lambda names: operation(*(p(names) for p in parts))


def _render(nodes: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[Output, dict], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(out: Output, names: dict) -> None:
        for step in steps:
            step(out, names)

    return run


def _step(node: object, filters: dict[str, Callable[[str], str]]) -> Callable[[Output, dict], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            constant = _text(node.value.value)
            return lambda out, names: out.write(constant)
        value = _value(node.value, filters)
        return lambda out, names: out.write(_text(value(names)))
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _render(node.then, filters), _render(node.other, filters)
        return lambda out, names: then(out, names) if test(names) else other(out, names)
    if isinstance(node, Generation):
        body = _render(node.body, filters)

        def marked(out: Output, names: dict) -> None:
            start = out.size
            body(out, names)
            out.spans.append((start, out.size))

        return marked
    raise TemplateError("for stands at the top level only")


class Template:
    """A compiled template. A long conversation can be rendered in parts: head, turns by number, tail."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]]):
        tree = parse(source, filters)
        loops = [k for k, node in enumerate(tree) if isinstance(node, For)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        loop = tree[loops[0]]
        self.tree, self.name = tree, loop.name
        self.head, self.body, self.tail = (_render(n, filters) for n in (tree[: loops[0]], loop.body, tree[loops[0] + 1 :]))

    def turns(self, out: Output, messages: list[dict], first: int = 0) -> None:
        """Write the messages, the first of which has the number `first`."""
        for k, message in enumerate(messages, first):
            self.body(out, {self.name: message, "loop": {"index0": k, "first": k == 0}})

    def render(self, messages: list[dict]) -> Output:
        out = Output()
        self.head(out, {})
        self.turns(out, messages)
        self.tail(out, {})
        return out
