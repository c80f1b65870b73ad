"""A sandboxed template language for chats, compiled to Python closures.

``{{ expression }}`` writes a value; ``{% for x in list %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% set x = expression %}`` and ``{% generation %}`` end with
``{% endfor %}`` and so on (``set`` has no end); ``{# #}`` is a comment; a dash inside a
tag strips the white space beside it. Expressions have strings, whole numbers, true,
false, none, lists, names, ``a.b`` and ``a['b']`` (keys of mappings and places of lists
only), ``a | filter``, ``~ + - * // %``, comparisons, ``in``, ``not``, ``and``, ``or``,
``is defined`` and ``a if b else c``. In a loop, ``loop`` has index, index0, first and last.

Sandbox: a value is text, a number, a truth value, none, a list or a mapping; no
attribute of a Python object can be named, nothing can be called but the filters of
``FILTERS``, and what is repeated or looped over is a list of the input. An unknown name
is none.

A template is read into a syntax tree, constants are folded (values, neighbouring
texts, branches that are never or always taken), and every node becomes a closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template isn't in the language."""


# A run of backslashes in "<\\\|" gets one more; so no text holds "<|", and it can be undone.
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text without ``<|``; ``unescape`` gives it back."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """The same without line feeds, for roles."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.DOTALL)


def _text(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if not isinstance(x, (list, dict)) else _refuse("a list or mapping has no text")


def _refuse(why: str):
    raise TemplateError(why)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "escape_line": lambda x: escape_line(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, other: other if x is None else x,
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
    "join": lambda x, by="": by.join(map(_text, x)),
    "replace": lambda x, old, new: _text(x).replace(old, new),
}


# Expressions
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
class Call:
    """An operator or a filter."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Lazy:
    """``and`` or ``or``: the second value only if the first doesn't decide."""

    name: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


# Statements
@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _plus(a, b):
    if isinstance(a, (str, list)) and type(a) is type(b) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts, two numbers or two lists")


def _number(f):
    return lambda a, b: f(a, b) if isinstance(a, int) and isinstance(b, int) else _refuse("arithmetic takes whole numbers")


def _lookup(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": _plus,
    "-": _number(lambda a, b: a - b),
    "*": _number(lambda a, b: a * b),
    "//": _number(lambda a, b: a // b),
    "%": _number(lambda a, b: a % b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b if b is not None else False,
    "not": lambda a: not a,
    "defined": lambda a: a is not None,
    "list": lambda *a: list(a),
}

_TAG = re.compile(r"\{(?:\{(?P<w>-?)(?P<write>(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)(?P<w2>-?)\}\}|%(?P<s>-?)(?P<stmt>(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)(?P<s2>-?)%\}|#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<op>//|==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"in", "not", "and", "or", "if", "else", "is"}
_ENDS = {"for": {"endfor"}, "if": {"elif", "else", "endif"}, "generation": {"endgeneration"}}


class _Reader:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind in ("op", "name") and text in texts:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} expected, found {self.peek()[1]!r}")

    def word(self) -> str:
        kind, text = self.peek()
        if kind != "name" or text in _KEYWORDS or text in _WORDS:
            raise TemplateError(f"a name expected, found {text!r}")
        self.at += 1
        return text

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def expression(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, value, self.expression())
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Lazy("or", value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Lazy("and", value, self.negated())
        return value

    def negated(self):
        return Call("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.sum()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = Call(op, (value, self.sum()))
            elif self.take("not"):
                self.need("in")
                value = Call("not", (Call("in", (value, self.sum())),))
            elif self.take("is"):
                negated = self.take("not")
                self.need("defined")
                value = Call("defined", (value,))
                value = Call("not", (value,)) if negated else value
            else:
                return value

    def sum(self):
        value = self.product()
        while op := self.take("+", "-", "~"):
            value = Call(op, (value, self.product()))
        return value

    def product(self):
        value = self.filtered()
        while op := self.take("*", "//", "%"):
            value = Call(op, (value, self.filtered()))
        return value

    def filtered(self):
        value = self.postfix()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Call(f"|{name}", (value, *(self.arguments(")") if self.take("(") else ())))
        return value

    def arguments(self, end: str) -> tuple:
        found = []
        while not self.take(end):
            found.append(self.expression())
            if not self.take(","):
                self.need(end)
                break
        return tuple(found)

    def postfix(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = Item(value, Const(self.word()))
            elif self.take("["):
                value = Item(value, self.expression())
                self.need("]")
            else:
                return value

    def atom(self):
        kind, text = self.peek()
        if kind == "int":
            self.at += 1
            return Const(int(text))
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            return Call("list", self.arguments("]"))
        if text in _WORDS:
            self.at += 1
            return Const(_WORDS[text])
        return Name(self.word())


def _pieces(source: str):
    """("text", …), ("write", …) and ("stmt", …) in order, dashes applied."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left = (m["w"] or m["s"]) == "-"
        out.append(("text", (text.lstrip() if strip else text).rstrip() if left else text.lstrip() if strip else text))
        kind = "write" if m["write"] is not None else "stmt" if m["stmt"] is not None else None
        if kind:
            out.append((kind, m[kind]))
        strip, at = (m["w2"] or m["s2"]) == "-", m.end()
    tail = source[at:].lstrip() if strip else source[at:]
    if re.search(r"\{[{%#]", tail):
        raise TemplateError("a tag has no end")
    return [*out, ("text", tail)]


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = _pieces(source), 0

    def block(until: set[str]) -> tuple[tuple, str, _Reader | None]:
        nonlocal at
        body = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                if text:
                    body.append(Text(text))
                continue
            tag = _Reader(text)
            if kind == "write":
                body.append(Write(tag.expression()))
                tag.done()
                continue
            word = tag.peek()[1]
            if word in until:
                tag.at += 1
                return tuple(body), word, tag
            if tag.take("set"):
                name = tag.word()
                tag.need("=")
                body.append(Set(name, tag.expression()))
                tag.done()
            elif tag.take("for"):
                name = tag.word()
                tag.need("in")
                over = tag.expression()
                tag.done()
                inner, _, end = block(_ENDS["for"])
                end.done()
                body.append(For(name, over, inner))
            elif tag.take("if"):
                body.append(branch(tag))
            elif tag.take("generation"):
                tag.done()
                inner, _, end = block(_ENDS["generation"])
                end.done()
                body.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {text.strip()!r}")
        if until:
            raise TemplateError(f"one of {sorted(until)} is missing")
        return tuple(body), "", None

    def branch(tag: _Reader) -> If:
        test = tag.expression()
        tag.done()
        then, word, end = block(_ENDS["if"])
        if word == "elif":
            return If(test, then, (branch(end),))
        end.done()
        other = ()
        if word == "else":
            other, _, end = block({"endif"})
            end.done()
        return If(test, then, other)

    return block(set())[0]


def fold(node):
    """The same tree with its constants worked out; what would fail is left to fail when rendered."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            for y in fold_statement(x):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Item):
        node = Item(fold(node.of), fold(node.key))
        return Const(_lookup(node.of.value, node.key.value)) if isinstance(node.of, Const) and isinstance(node.key, Const) else node
    if isinstance(node, Lazy):
        a, b = fold(node.a), fold(node.b)
        return (a if bool(a.value) == (node.name == "or") else b) if isinstance(a, Const) else Lazy(node.name, a, b)
    if isinstance(node, Choice):
        test = fold(node.test)
        return fold(node.then if test.value else node.other) if isinstance(test, Const) else Choice(test, fold(node.then), fold(node.other))
    if isinstance(node, Call):
        node = Call(node.name, tuple(fold(a) for a in node.args))
        if node.name != "list" and all(isinstance(a, Const) for a in node.args):
            try:
                return Const(_function(node.name)(*(a.value for a in node.args)))
            except Exception:  # an error belongs to the rendering that reaches it
                return node
    return node


def fold_statement(node) -> list:
    if isinstance(node, Write):
        value = fold(node.value)
        return [Text(_text(value.value))] if isinstance(value, Const) and not isinstance(value.value, (list, dict)) else [Write(value)]
    if isinstance(node, Set):
        return [Set(node.name, fold(node.value))]
    if isinstance(node, For):
        over, body = fold(node.over), fold(node.body)
        return [] if isinstance(over, Const) and not over.value else [For(node.name, over, body)]
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return list(fold(node.then if test.value else node.other))
        return [If(test, fold(node.then), fold(node.other))]
    if isinstance(node, Generation):
        return [Generation(fold(node.body))]
    return [node]


def _function(name: str) -> Callable:
    return FILTERS[name[1:]] if name[0] == "|" else OPERATORS[name]


@dataclass
class Output:
    """What is written, and the spans (code points) inside ``generation`` blocks."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    depth: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _lookup(of(env), key(env))
    if isinstance(node, Lazy):
        a, b, decides = _value(node.a), _value(node.b), node.name == "or"
        return lambda env: x if bool(x := a(env)) == decides else b(env)
    if isinstance(node, Choice):
        test, then, other = _value(node.test), _value(node.then), _value(node.other)
        return lambda env: then(env) if test(env) else other(env)
    f, args = _function(node.name), [_value(a) for a in node.args]
    if len(args) == 1:
        (a,) = args
        return lambda env: f(a(env))
    if len(args) == 2:
        a, b = args
        return lambda env: f(a(env), b(env))
    return lambda env: f(*(a(env) for a in args))


def _body(nodes: tuple) -> Callable[[dict, Output], None]:
    steps = [_statement(x) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


def _statement(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda env, out: out.write(text)
    if isinstance(node, Write):
        value = _value(node.value)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Set):
        name, value = node.name, _value(node.value)

        def put(env, out):
            env[name] = value(env)

        return put
    if isinstance(node, If):
        test, then, other = _value(node.test), _body(node.then), _body(node.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Generation):
        inner = _body(node.body)

        def mark(env, out):
            start, out.depth = out.size, out.depth + 1
            inner(env, out)
            out.depth -= 1
            if not out.depth and out.size > start:
                out.spans.append((start, out.size))

        return mark
    name, over, inner = node.name, _value(node.over), _body(node.body)

    def loop(env, out):
        rows = over(env)
        if rows is None:
            return
        if not isinstance(rows, list):
            raise TemplateError("for takes a list")
        own = dict(env)
        for i, row in enumerate(rows):
            own[name] = row
            own["loop"] = {"index0": i, "index": i + 1, "first": not i, "last": i == len(rows) - 1}
            inner(own, out)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that gives the text and its generation spans."""
    run = _body(fold(parse(source)))

    def render(**variables):
        out = Output()
        run(dict(variables), out)
        return "".join(out.parts), out.spans

    return render
