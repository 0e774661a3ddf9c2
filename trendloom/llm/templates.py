"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                      output
    {% for name in expression %} … {% endfor %}
    {% if expression %} … {% elif expression %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}  output of the model, which training learns
    {% turn %} … {% endturn %}              a turn, whose end the output marks

Expressions: strings in quotes, whole numbers, ``true``, ``false``, ``none``, names, fields
(``message.role``), ``~`` (joins as text), ``==``, ``!=``, ``and``, ``or``, ``not``, brackets and
filters (``value|escape``). Names come from the context and fields from mappings alone: no
attributes, calls, indexes or imports, so a template reaches nothing but what it is given. In a
loop ``loop.index0``, ``loop.first`` and ``loop.last`` are known.

A template is parsed into a tree, constants are folded (joined texts, comparisons, filters of
constants, branches that are never taken, neighbouring texts), and each node becomes a closure.
Rendering yields (text, learnt) pieces one after the other and reads ``for`` sources as streams,
so memory does not grow with a conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple

TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
TOKENS = re.compile(
    r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[~.|()]))"""
)
CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template cannot be parsed."""


class Node(NamedTuple):
    """``kind`` with its parts; constants are ``Node("constant", (value,))``."""

    kind: str
    parts: tuple = ()


def constant(value: Any) -> Node:
    return Node("constant", (value,))


def as_text(value: Any) -> str:
    return "" if value is None else str(value)


class _Expressions:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            found = TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.tokens.append(("end", ""))

    def take(self, *values: str) -> str | None:
        if self.tokens[0][0] in ("mark", "name") and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def whole(self) -> Node:
        node = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"cannot read {self.source!r} from {self.tokens[0][1]!r} on")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        if mark := self.take("==", "!="):
            node = Node(mark, (node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.take("~"):
            node = Node("~", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.field()
        while self.take("|"):
            node = Node("filter", (self.name(), node))
        return node

    def field(self) -> Node:
        node = self.single()
        while self.take("."):
            node = Node("field", (node, self.name()))
        return node

    def name(self) -> str:
        kind, value = self.tokens.pop(0)
        if kind != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        return value

    def single(self) -> Node:
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return constant(value[1:-1])
        if kind == "number":
            return constant(int(value))
        if kind == "name":
            return constant(CONSTANTS[value]) if value in CONSTANTS else Node("name", (value,))
        if value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError(f"a bracket is open in {self.source!r}")
            return node
        raise TemplateError(f"cannot read {self.source!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = [p for p in TAGS.split(source) if p]

    def block(*ends: str) -> tuple[Node, str]:
        nodes: list[Node] = []
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                nodes.append(Node("output", (_Expressions(piece[2:-2]).whole(),)))
            elif not piece.startswith("{%"):
                nodes.append(Node("output", (constant(piece),)))
            else:
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return Node("block", tuple(nodes)), f"{word} {rest}"
                nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return Node("block", tuple(nodes)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "for" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return Node("for", (found[1], _Expressions(found[2]).whole(), block("endfor")[0]))
        if word in ("generation", "turn"):
            return Node(word, (block(f"end{word}")[0],))
        if word == "if":
            test = _Expressions(rest).whole()
            then, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                other = Node("block", (statement("if", end.partition(" ")[2].strip()),))
            else:
                other = block("endif")[0] if end.startswith("else") else Node("block")
            return Node("if", (test, then, other))
        raise TemplateError(f"cannot read the statement {word} {rest}")

    return block()[0]


def fold(node: Node, filters: Mapping[str, Callable[[str], str]]) -> Node:
    """The tree with everything worked out that does not depend on the context."""
    parts = tuple(fold(p, filters) if isinstance(p, Node) else p for p in node.parts)
    known = [p.parts[0] for p in parts if isinstance(p, Node) and p.kind == "constant"]
    nodes = sum(isinstance(p, Node) for p in parts)
    node = Node(node.kind, parts)
    if node.kind in ("~", "==", "!=", "not", "filter", "and", "or") and len(known) == nodes:
        return constant(_expression(node, filters)({}))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if parts[0].parts[0] else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for part in (x for p in parts for x in (p.parts if p.kind == "block" else (p,))):
            fixed = part.kind == "output" and part.parts[0].kind == "constant"
            if fixed and flat and flat[-1].kind == "output" and flat[-1].parts[0].kind == "constant":
                text = as_text(flat[-1].parts[0].parts[0]) + as_text(part.parts[0].parts[0])
                flat[-1] = Node("output", (constant(text),))
            else:
                flat.append(part)
        return Node("block", tuple(flat))
    return node


def _expression(node: Node, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Mapping], Any]:
    kind = node.kind
    if kind == "constant":
        value = node.parts[0]
        return lambda context: value
    if kind == "name":
        name = node.parts[0]
        return lambda context: context.get(name)
    if kind == "filter":
        if node.parts[0] not in filters:
            raise TemplateError(f"there is no filter {node.parts[0]}")
        change, inner = filters[node.parts[0]], _expression(node.parts[1], filters)
        return lambda context: change(as_text(inner(context)))
    if kind == "field":
        inner, name = _expression(node.parts[0], filters), node.parts[1]

        def field(context: Mapping) -> Any:
            value = inner(context)
            return value.get(name) if isinstance(value, Mapping) else None

        return field
    given = [_expression(p, filters) for p in node.parts]
    if kind == "not":
        return lambda context: not given[0](context)
    left, right = given
    if kind == "and":
        return lambda context: left(context) and right(context)
    if kind == "or":
        return lambda context: left(context) or right(context)
    if kind == "==":
        return lambda context: left(context) == right(context)
    if kind == "!=":
        return lambda context: left(context) != right(context)
    return lambda context: as_text(left(context)) + as_text(right(context))


Pieces = Iterator[tuple[str, bool | None]]


def _statement(node: Node, learnt: bool, filters: Mapping) -> Callable[[dict], Pieces]:
    if node.kind == "output":
        value = _expression(node.parts[0], filters)

        def output(context: dict) -> Pieces:
            yield as_text(value(context)), learnt

        return output
    if node.kind == "generation":
        return _statement(node.parts[0], True, filters)
    if node.kind == "turn":
        inside = _statement(node.parts[0], learnt, filters)

        def turn(context: dict) -> Pieces:
            yield from inside(context)
            yield "", None

        return turn
    if node.kind == "if":
        test = _expression(node.parts[0], filters)
        then, other = (_statement(p, learnt, filters) for p in node.parts[1:])
        return lambda context: (then if test(context) else other)(context)
    if node.kind == "for":
        name, source = node.parts[0], _expression(node.parts[1], filters)
        body = _statement(node.parts[2], learnt, filters)

        def loop(context: dict) -> Pieces:
            rows, index = iter(source(context) or ()), 0
            row = next(rows, loop)
            while row is not loop:
                after = next(rows, loop)
                place = {"index0": index, "first": index == 0, "last": after is loop}
                yield from body({**context, name: row, "loop": place})
                row, index = after, index + 1

        return loop
    steps = [_statement(p, learnt, filters) for p in node.parts]

    def block(context: dict) -> Pieces:
        for step in steps:
            yield from step(context)

    return block


def compile_template(
    source: str, filters: Mapping[str, Callable[[str], str]] | None = None
) -> Callable[[dict], Pieces]:
    """A function from a context to the rendered pieces, each with whether it is learnt; an empty
    piece with None is the end of a turn."""
    filters = filters or {}
    return _statement(fold(parse(source), filters), False, filters)
