"""A sandboxed template language, compiled to closures.

Text with `{{ expression }}`, `{% for x in list %}`, `{% if %} {% elif %} {% else %}`,
`{% set x = expression %}` and `{% generation %}`; a minus inside a tag trims the white space
on that side, `{# ... #}` is a comment.  Expressions are literals, names, `a.b` and `a['b']` on
the given values, `+ - * % ~`-free arithmetic, comparisons, `and or not`, `in`, `x if c else y`
and filters, `x | trim`.  Nothing reaches Python attributes, calls or builtins.

`compile_template` parses to a syntax tree, folds what is constant (literal arithmetic, filters
of literals, branches with a literal condition, neighbouring text) and returns one closure.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: operator.mod}
COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b,
    ast.NotIn: lambda a, b: a not in b,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
    "first": lambda v: v[0] if v else "",
    "last": lambda v: v[-1] if v else "",
    "string": str,
}


class TemplateError(ValueError):
    """The template uses something outside the language."""


# ------------------------------------------------------------------ syntax tree


@dataclass
class Node:
    """`kind` says what the node is, `value` and `parts` what it holds."""

    kind: str
    value: object = None
    parts: list = field(default_factory=list)


def expression(source: str, filters: dict[str, Callable]) -> Node:
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"bad expression {source!r}") from e
    return _expr(tree, filters)


def _expr(t: ast.expr, filters: dict[str, Callable]) -> Node:
    go = lambda x: _expr(x, filters)
    if isinstance(t, ast.Constant) and isinstance(t.value, (str, int, float, bool, type(None))):
        return Node("const", t.value)
    if isinstance(t, ast.Name):
        return Node("const", {"true": True, "false": False, "none": None}[t.id]) if t.id in ("true", "false", "none") else Node("name", t.id)
    if isinstance(t, ast.Attribute):
        return Node("item", None, [go(t.value), Node("const", t.attr)])
    if isinstance(t, ast.Subscript) and not isinstance(t.slice, ast.Slice):
        return Node("item", None, [go(t.value), go(t.slice)])
    if isinstance(t, ast.BinOp) and isinstance(t.op, ast.BitOr) and isinstance(t.right, ast.Name):
        if t.right.id not in filters:
            raise TemplateError(f"unknown filter {t.right.id!r}")
        return Node("filter", t.right.id, [go(t.left)])
    if isinstance(t, ast.BinOp) and type(t.op) in BINARY:
        return Node("binary", type(t.op), [go(t.left), go(t.right)])
    if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not):
        return Node("not", None, [go(t.operand)])
    if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.USub):
        return Node("binary", ast.Sub, [Node("const", 0), go(t.operand)])
    if isinstance(t, ast.BoolOp):
        return Node("and" if isinstance(t.op, ast.And) else "or", None, [go(v) for v in t.values])
    if isinstance(t, ast.Compare) and len(t.ops) == 1 and type(t.ops[0]) in COMPARE:
        return Node("compare", type(t.ops[0]), [go(t.left), go(t.comparators[0])])
    if isinstance(t, ast.IfExp):
        return Node("choose", None, [go(t.test), go(t.body), go(t.orelse)])
    raise TemplateError(f"not allowed in a template: {ast.unparse(t)!r}")


def parse(source: str, filters: dict[str, Callable]) -> list[Node]:
    pieces, tokens = TAG.split(source), []
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            if k and pieces[k - 1][-3:-2] == "-":
                piece = piece.lstrip()
            if k + 1 < len(pieces) and pieces[k + 1][2:3] == "-":
                piece = piece.rstrip()
            if piece:
                tokens.append(("text", piece))
        elif piece[1] != "#":
            tokens.append(("emit" if piece[1] == "{" else "tag", piece[2:-2].strip("-").strip()))
    body, end, rest = _block(tokens, (), filters)
    if rest or end:
        raise TemplateError(f"unexpected {end or rest[0][1]!r}")
    return body


def _block(tokens: list, until: tuple, filters: dict) -> tuple[list[Node], str, list]:
    body: list[Node] = []
    while tokens:
        (kind, text), tokens = tokens[0], tokens[1:]
        word = text.split(None, 1)[0] if kind == "tag" and text else ""
        if kind == "text":
            body.append(Node("text", text))
        elif kind == "emit":
            body.append(Node("emit", None, [expression(text, filters)]))
        elif word in until:
            return body, text, tokens
        elif word == "for" and (m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.S)):
            inner, _, tokens = _block(tokens, ("endfor",), filters)
            body.append(Node("for", m[1], [expression(m[2], filters), inner]))
        elif word == "if":
            arms, end = [], text
            while not end.startswith("endif"):
                test = Node("const", True) if end == "else" else expression(end.split(None, 1)[1], filters)
                inner, end, tokens = _block(tokens, ("elif", "else", "endif"), filters)
                arms.append((test, inner))
                if not end:
                    raise TemplateError("if without endif")
            body.append(Node("if", None, arms))
        elif word == "set" and (m := re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", text, re.S)):
            body.append(Node("set", m[1], [expression(m[2], filters)]))
        elif word == "generation":
            inner, _, tokens = _block(tokens, ("endgeneration",), filters)
            body.append(Node("generation", None, [inner]))
        else:
            raise TemplateError(f"unknown tag {text!r}")
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return body, "", []


# ------------------------------------------------------------------ constant folding


def fold(n: Node, filters: dict[str, Callable]) -> Node:
    n = Node(n.kind, n.value, [fold(p, filters) for p in n.parts])
    if n.kind in ("binary", "compare", "not", "filter") and all(p.kind == "const" for p in n.parts):
        return Node("const", close(n, filters)({}))
    if n.kind == "choose" and n.parts[0].kind == "const":
        return n.parts[1] if n.parts[0].value else n.parts[2]
    if n.kind in ("and", "or"):
        stop = n.kind == "or"
        kept: list[Node] = []
        for k, p in enumerate(n.parts):
            if p.kind == "const" and bool(p.value) == stop:
                return Node(n.kind, None, [*kept, p]) if kept else p
            if p.kind != "const" or k == len(n.parts) - 1:
                kept.append(p)
        return kept[0] if len(kept) == 1 else Node(n.kind, None, kept)
    return n


def fold_block(block: list[Node], filters: dict[str, Callable]) -> list[Node]:
    out: list[Node] = []

    def add(n: Node) -> None:
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", out[-1].value + n.value)
        elif n.kind != "text" or n.value:
            out.append(n)

    for n in block:
        if n.kind == "emit":
            e = fold(n.parts[0], filters)
            add(Node("text", shown(e.value)) if e.kind == "const" else Node("emit", None, [e]))
        elif n.kind == "if":
            arms = []
            for test, inner in n.parts:
                test = fold(test, filters)
                if test.kind == "const" and not test.value:
                    continue
                arms.append((test, fold_block(inner, filters)))
                if test.kind == "const":
                    break
            if arms and arms[0][0].kind == "const":
                for m in arms[0][1]:
                    add(m)
            elif arms:
                add(Node("if", None, arms))
        elif n.kind == "for":
            add(Node("for", n.value, [fold(n.parts[0], filters), fold_block(n.parts[1], filters)]))
        elif n.kind == "set":
            add(Node("set", n.value, [fold(n.parts[0], filters)]))
        elif n.kind == "generation":
            add(Node("generation", None, [fold_block(n.parts[0], filters)]))
        else:
            add(n)
    return out


# ------------------------------------------------------------------ closures


class Sink:
    """Rendered text and the code-point spans of its generated parts."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.at += len(text)


def shown(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def close(n: Node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    parts = [close(p, filters) for p in n.parts]
    if n.kind == "const":
        return lambda env, v=n.value: v
    if n.kind == "name":
        return lambda env, k=n.value: env.get(k)
    if n.kind == "item":
        return lambda env, a=parts[0], b=parts[1]: _item(a(env), b(env))
    if n.kind == "filter":
        return lambda env, f=filters[n.value], a=parts[0]: f(a(env))
    if n.kind in ("binary", "compare"):
        op = (BINARY | COMPARE)[n.value]
        return lambda env, a=parts[0], b=parts[1]: op(a(env), b(env))
    if n.kind == "not":
        return lambda env, a=parts[0]: not a(env)
    if n.kind == "choose":
        return lambda env, c=parts[0], a=parts[1], b=parts[2]: a(env) if c(env) else b(env)
    if n.kind == "and":
        return lambda env: next((v for p in parts[:-1] if not (v := p(env))), None) if not all(p(env) for p in parts[:-1]) else parts[-1](env)
    return lambda env: next((v for p in parts[:-1] if (v := p(env))), None) or parts[-1](env)


def _item(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def close_block(block: list[Node], filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    steps = [_step(n, filters) for n in block]

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _step(n: Node, filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    if n.kind == "text":
        return lambda env, sink, text=n.value: sink.write(text)
    if n.kind == "emit":
        return lambda env, sink, e=close(n.parts[0], filters): sink.write(shown(e(env)))
    if n.kind == "set":
        return lambda env, sink, e=close(n.parts[0], filters): env.__setitem__(n.value, e(env))
    if n.kind == "if":
        arms = [(close(t, filters), close_block(b, filters)) for t, b in n.parts]

        def choose(env: dict, sink: Sink) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, sink)

        return choose
    if n.kind == "for":
        items, body = close(n.parts[0], filters), close_block(n.parts[1], filters)

        def loop(env: dict, sink: Sink) -> None:
            values = list(items(env) or ())
            for k, v in enumerate(values):
                inner = env | {n.value: v, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(values) - 1}}
                body(inner, sink)

        return loop
    body = close_block(n.parts[0], filters)

    def generation(env: dict, sink: Sink) -> None:
        start = sink.at
        body(env, sink)
        sink.spans.append((start, sink.at))

    return generation


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """`render(**values) -> (text, spans)` for a template."""
    known = FILTERS | (filters or {})
    run = close_block(fold_block(parse(source, known), known), known)

    def render(**values: object) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        run(dict(values), sink)
        return "".join(sink.pieces), sink.spans

    return render
