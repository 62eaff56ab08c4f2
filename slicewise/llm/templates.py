"""A small sandboxed template language, compiled to Python closures.

Statements: ``{% for x in e %}``, ``{% if e %}``/``elif``/``else``,
``{% set x = e %}``, ``{% generation %}`` (marks what a model is trained on), each
closed by ``{% end... %}``; ``{{ e }}`` prints, ``{# #}`` is a comment. Expressions:
strings, numbers, true/false/none, names, ``a.b`` and ``a["b"]`` (mapping keys and
list items only: no Python attribute is ever read), ``+ - * %``, ``~`` (joins texts), comparisons, ``in``,
``and or not``, ``a if c else b``, and filters ``e | name(args)``.

Nothing else exists: no calls, no attributes, no imports. A syntax tree is
parsed, constants are folded (including filters of constants, branches of
constant conditions and runs of text), and closures are generated.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~|()\[\].,<>=]))"""
)
TAG = re.compile(r"\{%-?\s*(?P<block>.*?)\s*-?%\}|\{\{-?\s*(?P<show>.*?)\s*-?\}\}|\{#.*?#\}", re.S)
CONSTANTS = {"true": True, "false": False, "none": None}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod}


class TemplateError(ValueError):
    """The template can't be compiled or met a value it can't use."""


# ---- values


def as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value)


def escape(text: Any, specials: str) -> str:
    """A backslash before each backslash and each character of ``specials``."""
    return re.sub("[" + re.escape("\\" + specials) + "]", r"\\\g<0>", as_text(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": lambda x: as_text(x).strip(),
    "upper": lambda x: as_text(x).upper(),
    "lower": lambda x: as_text(x).lower(),
    "capitalize": lambda x: as_text(x).capitalize(),
    "length": lambda x: len(x or ()),
    "default": lambda x, y: y if x is None else x,
    "replace": lambda x, a, b: as_text(x).replace(as_text(a), as_text(b)),
    "join": lambda x, sep="": as_text(sep).join(as_text(y) for y in x or ()),
}


def item(value: Any, key: Any) -> Any:
    """A mapping's key or a list's item; anything absent is none."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


# ---- the syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Call:
    """A pure function of other expressions."""

    run: Callable
    args: list


@dataclass
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass
class Logic:
    op: str
    left: Any
    right: Any


@dataclass
class Show:
    value: Any


@dataclass
class Loop:
    name: str
    over: Any
    body: list


@dataclass
class Branch:
    test: Any
    body: list
    other: list = field(default_factory=list)


@dataclass
class Assign:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


# ---- parsing


class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def peek(self, *values: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] in ("op", "name") and self.tokens[0][1] in values

    def take(self, *values: str) -> str | None:
        return self.tokens.pop(0)[1] if self.peek(*values) else None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def word(self) -> str:
        if not self.tokens or self.tokens[0][0] != "name":
            raise TemplateError("expected a name")
        return self.tokens.pop(0)[1]

    def whole(self):
        out = self.choice()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, value, self.choice())
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Logic("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Logic("and", left, self.negated())
        return left

    def negated(self):
        return Call(operator.not_, [self.negated()]) if self.take("not") else self.compared()

    def compared(self):
        left = self.summed()
        while True:
            if op := self.take(*COMPARE):
                left = Call(COMPARE[op], [left, self.summed()])
            elif self.take("in"):
                left = Call(lambda x, y: x in (y or ()), [left, self.summed()])
            else:
                return left

    def summed(self):
        left = self.times()
        while op := self.take("+", "-", "~"):
            left = Call(ARITHMETIC.get(op, lambda x, y: as_text(x) + as_text(y)), [left, self.times()])
        return left

    def times(self):
        left = self.filtered()
        while op := self.take("*", "%"):
            left = Call(ARITHMETIC[op], [left, self.filtered()])
        return left

    def filtered(self):
        value = self.reached()
        while self.take("|"):
            name, args = self.word(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter named {name!r}")
            if self.take("(") and not self.take(")"):
                args.append(self.choice())
                while self.take(","):
                    args.append(self.choice())
                self.need(")")
            value = Call(FILTERS[name], [value, *args])
        return value

    def reached(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = Call(item, [value, Const(self.word())])
            elif self.take("["):
                value = Call(item, [value, self.choice()])
                self.need("]")
            else:
                return value

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("-"):
            return Call(operator.neg, [self.reached()])
        if not self.tokens:
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens.pop(0)
        if kind == "number":
            return Const(float(text) if "." in text else int(text))
        if kind == "string":
            escapes = {"n": "\n", "t": "\t", "r": "\r"}
            return Const(re.sub(r"\\(.)", lambda m: escapes.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name" and text not in ("if", "else", "and", "or", "not", "in"):
            return Const(CONSTANTS[text]) if text in CONSTANTS else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The template's syntax tree. A dash inside a tag strips the white space on its side."""
    pieces: list = []
    at = 0
    strip = False
    for tag in TAG.finditer(source):
        text = source[at : tag.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if tag[0][2] == "-" else text))
        strip = tag[0][-3] == "-"
        at = tag.end()
        for kind in ("block", "show"):
            if tag[kind] is not None:
                pieces.append((kind, tag[kind]))
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    body, closer = _body(pieces, ())
    assert closer is None
    return body


def _body(pieces: list, closers: tuple[str, ...]) -> tuple[list, str | None]:
    out: list = []
    while pieces:
        kind, text = pieces.pop(0)
        if kind == "text":
            out.append(Show(Const(text)))
        elif kind == "show":
            out.append(Show(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in closers:
                return out, text
            out.append(_statement(word, rest, pieces))
    if closers:
        raise TemplateError(f"expected {' or '.join(closers)}")
    return out, None


def _statement(word: str, rest: str, pieces: list):
    expression = _Expression(rest)
    if word == "for":
        name = expression.word()
        expression.need("in")
        return Loop(name, expression.whole(), _body(pieces, ("endfor",))[0])
    if word == "if":
        test = expression.whole()
        body, closer = _body(pieces, ("elif", "else", "endif"))
        if closer.startswith("elif"):
            return Branch(test, body, [_statement("if", closer[4:], pieces)])
        return Branch(test, body, _body(pieces, ("endif",))[0] if closer == "else" else [])
    if word == "set":
        name = expression.word()
        expression.need("=")
        return Assign(name, expression.whole())
    if word == "generation":
        return Generation(_body(pieces, ("endgeneration",))[0])
    raise TemplateError(f"unknown statement {word!r}")


# ---- constant folding


def fold(node):
    """The same expression or list of statements with constants computed."""
    if isinstance(node, list):
        return _fold_body(node)
    if isinstance(node, Call):
        args = [fold(x) for x in node.args]
        if all(isinstance(x, Const) for x in args):
            try:
                return Const(node.run(*(x.value for x in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Call(node.run, args)
    if isinstance(node, Logic):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        return Logic(node.op, left, right)
    if isinstance(node, Choice):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return Choice(test, fold(node.yes), fold(node.no))
    return node


def _fold_body(body: list) -> list:
    out: list = []
    for node in body:
        if isinstance(node, Show):
            new = [Show(fold(node.value))]
        elif isinstance(node, Loop):
            over = fold(node.over)
            new = [] if isinstance(over, Const) and not over.value else [Loop(node.name, over, fold(node.body))]
        elif isinstance(node, Branch):
            test = fold(node.test)
            new = fold(node.body if test.value else node.other) if isinstance(test, Const) else [Branch(test, fold(node.body), fold(node.other))]
        elif isinstance(node, Assign):
            new = [Assign(node.name, fold(node.value))]
        else:
            new = [Generation(fold(node.body))]
        for x in new:
            if isinstance(x, Show) and isinstance(x.value, Const):
                text = as_text(x.value.value)
                if not text:
                    continue
                if out and isinstance(out[-1], Show) and isinstance(out[-1].value, Const):
                    out[-1] = Show(Const(out[-1].value.value + text))
                    continue
                x = Show(Const(text))
            out.append(x)
    return out


# ---- closures


class Output:
    """Text so far, and the spans (in code points) that generation blocks wrote."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Choice):
        test, yes, no = _value(node.test), _value(node.yes), _value(node.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if isinstance(node, Logic):
        left, right = _value(node.left), _value(node.right)
        if node.op == "and":
            return lambda scope: left(scope) and right(scope)
        return lambda scope: left(scope) or right(scope)
    run, args = node.run, [_value(x) for x in node.args]
    if len(args) == 1:
        only = args[0]
        return lambda scope: run(only(scope))
    return lambda scope: run(*[x(scope) for x in args])


def _action(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Show):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda scope, out: out.add(text)
        value = _value(node.value)
        return lambda scope, out: out.add(as_text(value(scope)))
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value)

        def assign(scope: dict, out: Output) -> None:
            scope[name] = value(scope)

        return assign
    if isinstance(node, Branch):
        test, yes, no = _value(node.test), _actions(node.body), _actions(node.other)
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    body = _actions(node.body)
    if isinstance(node, Generation):

        def generate(scope: dict, out: Output) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return generate
    name, over = node.name, _value(node.over)

    def loop(scope: dict, out: Output) -> None:
        values = list(over(scope) or ())
        inner = dict(scope)
        for i, value in enumerate(values):
            inner[name] = value
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1}
            body(inner, out)

    return loop


def _actions(nodes: list) -> Callable[[dict, Output], None]:
    actions = [_action(x) for x in nodes]

    def run(scope: dict, out: Output) -> None:
        for action in actions:
            action(scope, out)

    return run


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of named values that gives the text and its generation spans."""
    run = _actions(fold(parse(source)))

    def render(**values: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        try:
            run(dict(values), out)
        except TypeError as e:
            raise TemplateError(str(e)) from e
        return "".join(out.parts), out.spans

    return render
