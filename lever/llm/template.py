"""A small sandboxed template language, compiled to Python closures.

    text {{ expression }} {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for name in expression %}..{% endfor %} {% generation %}..{% endgeneration %}

Expressions: 'strings', integers, true, false, none, names, ``a.b`` and
``a['b']`` (items of mappings, never attributes), ``==  !=  not  and  or  +  ( )``
and filters ``| name``.  There are no calls and no way to other Python objects.
In a loop ``loop.index0``, ``loop.first`` and ``loop.last`` are known.

Compilation parses to a syntax tree, folds constants (expressions, branches and
neighbouring texts) and returns a closure that streams ``(text, generated)``
segments, so a loop over any number of items holds one item at a time.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any


class TemplateError(ValueError):
    """The template cannot be parsed or asks for what is not there."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|
                        (?P<op>==|!=|[.\[\]()|+]))""", re.X)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

# nodes: ("const", value) ("name", n) ("item", node, node) ("not", a) ("and"|"or"|"=="|"!="|"+", a, b)
#        ("filter", name, a) ("out", e) ("if", [(e, body)], body) ("for", name, e, body) ("gen", body)
Node = tuple
_INFIX = {"==": operator.eq, "!=": operator.ne}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing")

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> Node:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while op := self.take("==", "!="):
            node = (op, node, self.sum())
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while True:
            if self.take("|"):
                node = ("filter", self.word("name"), node)
            elif self.take("."):
                node = ("item", node, ("const", self.word("name")))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            else:
                return node

    def word(self, kind: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a {kind} is missing")

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name" and text not in ("and", "or", "not", "in"):
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[text]) if text in fixed else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at = 0
    for m in _TAG.finditer(source):
        stack[-1][2].append(("const", source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "if":
            stack.append(("if", [_Expression(rest).whole(), []], []))
        elif word in ("elif", "else") and stack[-1][0] == "if" and stack[-1][1][0] is not None:
            _, (test, done), body = stack.pop()
            stack.append(("if", [_Expression(rest).whole() if word == "elif" else None, done + [(test, body)]], []))
        elif word == "for":
            name, inside, over = rest.partition(" in ")
            if not inside or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read for {rest!r}")
            stack.append(("for", (name.strip(), _Expression(over).whole()), []))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == "end" + stack[-1][0] and stack[-1][0] and not rest.strip():
            kind, info, body = stack.pop()
            if kind == "if":
                test, done = info
                node = ("if", done, body) if test is None else ("if", done + [(test, body)], [])
            else:
                node = ("for", *info, body) if kind == "for" else ("gen", body)
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unexpected {{% {m[2].strip()} %}}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][2] + [("const", source[at:])]


class Compiler:
    """Folds a tree and turns it into closures; ``filters`` are pure functions of one string."""

    def __init__(self, filters: Mapping[str, Callable[[str], str]] = {}):
        self.filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **filters}

    def template(self, source: str) -> Callable[[Mapping[str, Any]], Iterator[tuple[str, bool]]]:
        run = self._body(self.folded(parse(source)), False)
        return lambda env: run(dict(env))

    def folded(self, body: list[Node]) -> list[Node]:
        """The same output with constant expressions, tests and texts worked out."""
        out: list[Node] = []
        for node in body:
            for new in self._fold(node):
                if new[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", out[-1][1] + new[1])
                elif new != ("const", ""):
                    out.append(new)
        return out

    def _fold(self, node: Node) -> list[Node]:
        kind = node[0]
        if kind == "out":
            e = self._value(node[1])
            return [("const", _shown(e[1]))] if e[0] == "const" else [("out", e)]
        if kind == "if":
            arms, rest = [], node[2]
            for test, body in node[1]:
                test = self._value(test)
                if test[0] != "const":
                    arms.append((test, self.folded(body)))
                elif test[1]:
                    rest = body
                    break
            return [("if", arms, self.folded(rest))] if arms else self.folded(rest)
        if kind == "for":
            return [("for", node[1], self._value(node[2]), self.folded(node[3]))]
        if kind == "gen":
            return [("gen", self.folded(node[1]))]
        return [node]

    def _value(self, e: Node) -> Node:
        """The expression with constant parts worked out."""
        if e[0] in ("const", "name"):
            return e
        if e[0] == "filter":
            if e[1] not in self.filters:
                raise TemplateError(f"no filter {e[1]!r}")
            new: Node = ("filter", e[1], self._value(e[2]))
            fixed = new[2][0] == "const"
        else:
            new = (e[0], *map(self._value, e[1:]))
            fixed = all(x[0] == "const" for x in new[1:])
        return ("const", self._expression(new)({})) if fixed else new

    def _expression(self, e: Node) -> Callable[[dict], Any]:
        kind = e[0]
        if kind == "const":
            value = e[1]
            return lambda env: value
        if kind == "name":
            name = e[1]

            def look(env):
                if name not in env:
                    raise TemplateError(f"{name!r} is not known")
                return env[name]
            return look
        if kind == "filter":
            change, inner = self.filters[e[1]], self._expression(e[2])
            return lambda env: change(_shown(inner(env)))
        parts = [self._expression(x) for x in e[1:]]
        if kind == "not":
            return lambda env: not parts[0](env)
        a, b = parts
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        if kind == "+":
            def add(env):
                x, y = a(env), b(env)
                return x + y if isinstance(x, int) and isinstance(y, int) else _shown(x) + _shown(y)
            return add
        if kind == "item":
            def item(env):
                of, key = a(env), b(env)
                if not isinstance(of, Mapping):
                    raise TemplateError(f"no items in {type(of).__name__}")
                return of.get(key)
            return item
        compare = _INFIX[kind]
        return lambda env: compare(a(env), b(env))

    def _body(self, body: list[Node], generated: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        parts = [self._statement(n, generated) for n in body]

        def run(env):
            for part in parts:
                yield from part(env)
        return run

    def _statement(self, node: Node, generated: bool):
        kind = node[0]
        if kind == "const":
            segment = [(node[1], generated)]
            return lambda env: segment
        if kind == "out":
            value = self._expression(node[1])
            return lambda env: [(_shown(value(env)), generated)]
        if kind == "gen":
            return self._body(node[1], True)
        if kind == "if":
            arms = [(self._expression(t), self._body(b, generated)) for t, b in node[1]]
            rest = self._body(node[2], generated)

            def branch(env):
                for test, body in arms:
                    if test(env):
                        return body(env)
                return rest(env)
            return branch
        name, over, body = node[1], self._expression(node[2]), self._body(node[3], generated)

        def loop(env):
            items = iter(over(env) or ())
            inner, index, item = dict(env), 0, next(items, loop)
            while item is not loop:
                ahead = next(items, loop)
                inner[name] = item
                inner["loop"] = {"index0": index, "first": index == 0, "last": ahead is loop}
                yield from body(inner)
                item, index = ahead, index + 1
        return loop


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)
