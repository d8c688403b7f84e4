"""A subset of the Common Expression Language: conditions and reject rules are evaluated, row filters are lowered.

Grammar: ternary, ``|| && ! == != < <= > >= in + -``, literals, lists, field and index selection, the functions
``size has`` and the methods ``startsWith endsWith contains matches size exists all``.  Anything else is an error when
the expression is compiled.  ``||`` and ``&&`` absorb an error on one side if the other decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from palisade.model import GovernError, invalid

TOKENS = re.compile(
    r"\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)(?P<u>[uU])?|(?P<str>[rR]?(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}]))"
)
METHODS = {"startsWith": 1, "endsWith": 1, "contains": 1, "matches": 1, "size": 0}
ROOTS = ("subject", "request", "query", "row")
LIMIT = 10_000


class CelError(GovernError):
    def __init__(self, message: str):
        super().__init__("ACL_DENIED", message)


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    args: tuple = ()


def _tokens(text: str) -> list[tuple[str, Any]]:
    if len(text) > LIMIT:
        raise invalid("expression too long")
    out, i, end = [], 0, len(text.rstrip())
    while i < end:
        m = TOKENS.match(text, i)
        if not m or m.end() == i:
            raise invalid(f"cannot read expression at {text[i : i + 20]!r}")
        i = m.end()
        if m["num"]:
            out.append(("lit", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"]:
            raw = m["str"]
            body = raw[2:-1] if raw[0] in "rR" else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), raw[1:-1])
            out.append(("lit", body))
        elif m["name"]:
            out.append({"true": ("lit", True), "false": ("lit", False), "null": ("lit", None), "in": ("op", "in")}.get(m["name"], ("name", m["name"])))
        else:
            out.append(("op", m["op"]))
    return [*out, ("end", None)]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i, self.depth, self.bound = text, _tokens(text), 0, 0, []

    def peek(self, *ops: str) -> str | None:
        kind, v = self.tokens[self.i]
        return v if kind == "op" and v in ops else None

    def take(self, *ops: str) -> str | None:
        if (v := self.peek(*ops)) is not None:
            self.i += 1
        return v

    def need(self, op: str) -> None:
        if self.take(op) is None:
            raise invalid(f"expected {op!r} in {self.text!r}")

    def all(self) -> Node:
        n = self.ternary()
        if self.tokens[self.i][0] != "end":
            raise invalid(f"trailing input in {self.text!r}")
        return n

    def ternary(self) -> Node:
        self.depth += 1
        if self.depth > 60:
            raise invalid("expression nested too deeply")
        c = self.chain(0)
        if self.take("?"):
            a = self.ternary()
            self.need(":")
            c = Node("if", args=(c, a, self.ternary()))
        self.depth -= 1
        return c

    LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"))

    def chain(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.chain(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = Node(op, args=(left, self.chain(level + 1)))
        return left

    def unary(self) -> Node:
        if self.take("!"):
            return Node("!", args=(self.unary(),))
        if self.take("-"):
            return Node("neg", args=(self.unary(),))
        return self.postfix()

    def postfix(self) -> Node:
        n = self.primary()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.i]
                if kind != "name":
                    raise invalid(f"expected a name after '.' in {self.text!r}")
                self.i += 1
                n = self.method(n, name) if self.take("(") else Node("get", name, (n,))
            elif self.take("["):
                n = Node("at", args=(n, self.ternary()))
                self.need("]")
            else:
                return n

    def method(self, of: Node, name: str) -> Node:
        if name in ("exists", "all"):
            kind, var = self.tokens[self.i]
            if kind != "name":
                raise invalid(f"{name} needs a variable")
            self.i += 1
            self.need(",")
            self.bound.append(var)
            body = self.ternary()
            self.bound.pop()
            self.need(")")
            return Node(name, var, (of, body))
        args = self.arguments()
        if METHODS.get(name) != len(args):
            raise invalid(f"unknown method {name}/{len(args)}")
        if name == "matches" and args[0].kind == "lit":
            safe_regex(args[0].value)
        return Node("call", name, (of, *args))

    def arguments(self) -> list[Node]:
        args = []
        if not self.take(")"):
            args.append(self.ternary())
            while self.take(","):
                args.append(self.ternary())
            self.need(")")
        return args

    def primary(self) -> Node:
        kind, v = self.tokens[self.i]
        self.i += 1
        if kind == "lit":
            return Node("lit", v)
        if kind == "name":
            if self.take("("):
                args = self.arguments()
                if v == "size" and len(args) == 1:
                    return Node("call", "size", tuple(args))
                if v == "has" and len(args) == 1 and args[0].kind == "get":
                    return Node("has", args=tuple(args))
                raise invalid(f"unknown function {v}/{len(args)}")
            if v not in ROOTS and v not in self.bound:
                raise invalid(f"unknown variable {v}")
            return Node("var", v)
        if kind == "op" and v == "(":
            n = self.ternary()
            self.need(")")
            return n
        if kind == "op" and v == "[":
            items = []
            if not self.take("]"):
                items.append(self.ternary())
                while self.take(","):
                    items.append(self.ternary())
                self.need("]")
            return Node("list", args=tuple(items))
        raise invalid(f"cannot read expression {self.text!r}")


def parse(text: str) -> Node:
    if not isinstance(text, str) or not text.strip():
        raise invalid("empty expression")
    return _Parser(text).all()


def safe_regex(pattern: Any) -> re.Pattern[str]:
    """A pattern of the common subset of regular-expression dialects: no look-around, back-references or possessives."""
    if not isinstance(pattern, str) or not 0 < len(pattern) <= 512:
        raise invalid("a regular expression has 1 to 512 characters")
    if re.search(r"\(\?(?:[=!<>#(]|P=)|\\[1-9kGZzA]|[*+?}]\+", re.sub(r"\\\\", "", pattern)):
        raise invalid(f"unsupported regular expression: {pattern}")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise invalid(f"bad regular expression {pattern}: {e}") from None


def same(a: Any, b: Any) -> bool:
    """Equality by type: numbers by value, booleans and strings apart from numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def evaluate(n: Node, env: dict[str, Any]) -> Any:
    k, a = n.kind, n.args
    if k == "lit":
        return n.value
    if k == "var":
        if n.value not in env:
            raise CelError(f"{n.value} is not available here")
        return env[n.value]
    if k == "list":
        return [evaluate(x, env) for x in a]
    if k in ("&&", "||"):
        stop = k == "||"
        try:
            left = _bool(evaluate(a[0], env))
        except CelError:
            if _bool(evaluate(a[1], env)) is stop:
                return stop
            raise
        return left if left is stop else _bool(evaluate(a[1], env))
    if k == "if":
        return evaluate(a[1] if _bool(evaluate(a[0], env)) else a[2], env)
    if k == "!":
        return not _bool(evaluate(a[0], env))
    if k in ("get", "has"):
        g = a[0] if k == "has" else n
        of = evaluate(g.args[0], env)
        if not isinstance(of, dict):
            raise CelError(f"no field {g.value}")
        if k == "has":
            return g.value in of
        if g.value not in of:
            raise CelError(f"no such key: {g.value}")
        return of[g.value]
    if k in ("exists", "all"):
        hits = [_bool(evaluate(a[1], env | {n.value: x})) for x in evaluate(a[0], env)]
        return any(hits) if k == "exists" else all(hits)
    v = [evaluate(x, env) for x in a]
    if k == "at":
        try:
            return v[0][v[1]]
        except (KeyError, IndexError, TypeError):
            raise CelError("no such element") from None
    if k == "call":
        if n.value == "size" and isinstance(v[0], (str, list, dict)):
            return len(v[0])
        if not all(isinstance(x, str) for x in v):
            raise CelError(f"{n.value} needs strings")
        return {"startsWith": str.startswith, "endsWith": str.endswith, "contains": str.__contains__, "matches": lambda s, p: safe_regex(p).search(s) is not None}[n.value](*v)
    if k == "in":
        if isinstance(v[1], dict):
            return v[0] in v[1]
        if not isinstance(v[1], (list, tuple)):
            raise CelError("in needs a list")
        return any(same(v[0], x) for x in v[1])
    if k in ("==", "!="):
        return same(*v) is (k == "==")
    number = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)
    if k == "neg" and number:
        return -v[0]
    if not number and not (all(isinstance(x, str) for x in v) and k in ("<", "<=", ">", ">=", "+")) and not (k == "+" and all(isinstance(x, list) for x in v)):
        raise CelError(f"no such overload: {k}")
    return {"<": lambda: v[0] < v[1], "<=": lambda: v[0] <= v[1], ">": lambda: v[0] > v[1], ">=": lambda: v[0] >= v[1], "+": lambda: v[0] + v[1], "-": lambda: v[0] - v[1]}[k]()


def _bool(v: Any) -> bool:
    if not isinstance(v, bool):
        raise CelError("not a boolean")
    return v


def condition(n: Node, env: dict[str, Any]) -> bool:
    return _bool(evaluate(n, env))


# Row filters.

FLIP = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
OPS = {"==": "Equals", "!=": "NotEquals", "<": "LessThan", "<=": "LessThanOrEqual", ">": "GreaterThan", ">=": "GreaterThanOrEqual"}
TEXT = {"startsWith": "StartsWith", "endsWith": "EndsWith", "contains": "Contains"}


def lower(n: Node) -> dict[str, Any]:
    """The predicate tree of a row expression."""
    k, a = n.kind, n.args
    if k in ("&&", "||"):
        return {"all" if k == "&&" else "any": [lower(a[0]), lower(a[1])]}
    if k == "!":
        return {"not": lower(a[0])}
    if k in FLIP:
        left, right, op = (a[0], a[1], k) if _column(a[0]) else (a[1], a[0], FLIP[k])
        if not _column(left) or _column(right):
            raise invalid("a comparison has a row column on one side only")
        value = _value(right)
        if value is None:
            if op not in ("==", "!="):
                raise invalid("null has no order")
            return {"column": _column(left), "op": "IsNull" if op == "==" else "IsNotNull"}
        return {"column": _column(left), "op": OPS[op], "value": value}
    if k == "in" and _column(a[0]) and a[1].kind == "list" and a[1].args and all(x.kind in ("lit", "neg") for x in a[1].args):
        return {"column": _column(a[0]), "op": "In", "values": [_value(x) for x in a[1].args]}
    if k == "call" and n.value in TEXT and _column(a[0]) and a[1].kind == "lit" and isinstance(a[1].value, str):
        return {"column": _column(a[0]), "op": TEXT[n.value], "value": a[1].value, "literal": True}
    raise invalid("not a row filter expression")


def _column(n: Node) -> str | None:
    return n.value if n.kind == "get" and n.args[0].kind == "var" and n.args[0].value == "row" else None


def _value(n: Node) -> Any:
    if n.kind == "lit":
        return n.value
    if n.kind == "neg" and n.args[0].kind == "lit" and isinstance(n.args[0].value, (int, float)):
        return -n.args[0].value
    path: list[str] = []
    while n.kind == "get":
        path.append(n.value)
        n = n.args[0]
    if n.kind != "var" or n.value not in ("subject", "request") or not path:
        raise invalid("a value is a literal or a subject or request field")
    path.append(n.value)
    path.reverse()
    if path == ["subject", "id"]:
        path = ["subject", "sub"]
    return "{{ " + ".".join(path) + " }}"
