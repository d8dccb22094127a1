"""Factor expressions: a logical plan as nested tuples, with its text form.

A node is a terminal's name or (operator, children..., parameter). Expressions that are written
as text use the searchable operators; factors may use the further ones (constants, comparisons,
where, sqrt, max/min), which have no text form.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

Node = str | tuple

TERMINALS = ("open", "high", "low", "close", "volume", "returns", "vwap")
# Fixed values of the search grammar: lags, windows, powers, operators, families with their words, and seeds.
LAGS = (1, 2, 3, 5, 10)
WINDOWS = (5, 10, 20, 40, 60)
POWERS = (0.5, 2.0)
UNARY = ("neg", "abs", "sign", "log")
BINARY = ("add", "sub", "mul", "div")
LAGGED = ("delay", "delta")
TRAILING = ("sma", "ts_sum", "ts_min", "ts_max", "ts_argmax", "ts_rank", "ts_scale", "stddev")
PAIRED = ("correlation",)
OPS = (*UNARY, "signedpower", *BINARY, *LAGGED, *TRAILING, *PAIRED)
SYMBOL = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
FAMILIES = ("reversal", "volume_price", "volatility", "range")
GRAMMAR = {
    "reversal": {"terminals": ("close", "returns", "vwap"), "ops": ("neg", "delta", "delay", "sma", "ts_min", "ts_max", "ts_rank", "ts_scale", "sub", "div")},
    "volume_price": {"terminals": ("open", "close", "volume", "returns"), "ops": ("neg", "correlation", "ts_rank", "sma", "delta", "div", "mul", "log")},
    "volatility": {"terminals": ("returns", "close", "high", "low"), "ops": ("stddev", "abs", "ts_max", "ts_min", "neg", "div", "sub", "sma", "signedpower")},
    "range": {"terminals": ("open", "high", "low", "close"), "ops": ("sub", "div", "neg", "ts_rank", "sma", "delta", "abs")},
}
SEEDS = (
    ("-1 * delta(close, 1)", "reversal"), ("-1 * (close - sma(close, 10))", "reversal"), ("-1 * correlation(open, volume, 10)", "volume_price"), ("ts_rank(volume / sma(volume, 20), 20)", "volume_price"),
    ("stddev(returns, 20)", "volatility"), ("(close - open) / (high - low)", "range"), ("(high - low) / close", "range"),
)


def arity(op: str) -> int:
    return 2 if op in BINARY or op in PAIRED else 1


def has_param(op: str) -> bool:
    return op == "signedpower" or op in LAGGED or op in TRAILING or op in PAIRED


def children(node: Node) -> tuple[Node, ...]:
    return () if isinstance(node, str) else node[1 : 1 + arity(node[0])]


def param(node: Node):  # noqa: ANN201
    return node[-1] if not isinstance(node, str) and has_param(node[0]) else None


def make(op: str, *args) -> tuple:  # noqa: ANN002
    """A node, after checking its operator, children and parameter."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    if len(args) != arity(op) + has_param(op):
        raise ValueError(f"{op} takes {arity(op)} operands" + " and a parameter" * has_param(op))
    if has_param(op):
        p = args[-1]
        if isinstance(p, bool) or not isinstance(p, (int, float)) or p <= 0 or (op != "signedpower" and p != int(p)):
            raise ValueError(f"{op} can't take {p!r}")
        args = (*args[:-1], float(p) if op == "signedpower" else int(p))
    return (op, *args)


def walk(node: Node) -> Iterator[Node]:
    """The node and everything below it, parents first."""
    yield node
    for child in children(node):
        yield from walk(child)


def size(node: Node) -> int:
    return sum(1 for _ in walk(node))


def depth(node: Node) -> int:
    return 1 + max(map(depth, children(node)), default=0)


def nesting(node: Node) -> int:
    """The longest chain of windows inside windows."""
    inner = max(map(nesting, children(node)), default=0)
    return inner + (not isinstance(node, str) and (node[0] in TRAILING or node[0] in PAIRED))


def warmup(node: Node) -> int:
    """Bars before the first value."""
    if isinstance(node, str):
        return 1 if node == "returns" else 0
    inner = max(map(warmup, children(node)))
    return inner + (param(node) if node[0] in LAGGED else param(node) - 1 if has_param(node[0]) and node[0] != "signedpower" else 0)


def terminals(node: Node) -> set[str]:
    return {x for x in walk(node) if isinstance(x, str)}


def replace_at(node: Node, index: int, new: Node) -> Node:
    """The tree with its index-th node, counted as walk() does, replaced."""
    if index == 0:
        return new
    index -= 1
    out = list(node)
    for i, child in enumerate(children(node), 1):
        n = size(child)
        if index < n:
            out[i] = replace_at(child, index, new)
            return tuple(out)
        index -= n
    raise IndexError("no such node")


def validate(node: Node, *, max_depth: int = 5, max_size: int = 12, max_nesting: int = 2, max_warmup: int = 120) -> str | None:
    """Why a search may not use the expression, or null."""
    if isinstance(node, str):
        return "bare_terminal"
    over = {"too_deep": depth(node) > max_depth, "too_big": size(node) > max_size, "too_nested": nesting(node) > max_nesting, "warmup": warmup(node) > max_warmup}
    return next((why for why, is_so in over.items() if is_so), None)


def _number(op: str, p: float) -> str:
    """Powers are written with a point, lags and windows without."""
    return str(float(p)) if op == "signedpower" else str(int(p))


def to_text(node: Node) -> str:
    """The canonical text; parse() gives the node again."""

    def level(x: Node) -> int:
        op = x if isinstance(x, str) else x[0]
        return 1 if op in ("add", "sub") else 2 if op in ("mul", "div", "neg") and not isinstance(x, str) else 3

    def put(x: Node, least: int) -> str:
        text = show(x)
        return f"({text})" if level(x) < least else text

    def show(x: Node) -> str:
        if isinstance(x, str):
            return x
        op = x[0]
        if op == "neg":
            return f"-1 * {put(x[1], 3)}"
        if op in SYMBOL:
            own = level(x)
            return f"{put(x[1], own)} {SYMBOL[op]} {put(x[2], own + 1)}"
        return f"{op}({', '.join([*map(show, children(x)), *([_number(op, param(x))] if has_param(op) else [])])})"

    return show(node)


def expr_id(node: Node) -> str:
    """Twelve hexadecimal digits that stand for the canonical text."""
    return hashlib.sha256(to_text(node).encode()).hexdigest()[:12]


_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|([-+*/(),]))")


def parse(text: str) -> Node:
    """Text to a node; raises ValueError with the place of what it can't read."""
    tokens: list[str] = []
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        tokens.append(m[0].strip())
        at = m.end()
    pos = 0

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal pos
        got = peek()
        if not got or want and got != want:
            raise ValueError(f"expected {want or 'more'}, found {got or 'the end'}")
        pos += 1
        return got

    def sums() -> Node:
        left = products()
        while peek() in ("+", "-"):
            op = "add" if take() == "+" else "sub"
            left = make(op, left, products())
        return left

    def products() -> Node:
        left = factor()
        while peek() in ("*", "/"):
            op = "mul" if take() == "*" else "div"
            left = make(op, left, factor())
        return left

    def factor() -> Node:
        if peek() == "-":
            take()
            take("1")
            take("*")
            return make("neg", factor())
        if peek() == "(":
            take()
            inner = sums()
            take(")")
            return inner
        name = take()
        if name in TERMINALS:
            return name
        if name not in OPS or name in SYMBOL or name == "neg":
            raise ValueError(f"unknown name {name!r}")
        take("(")
        args: list = [sums()]
        for _ in range(arity(name) - 1):
            take(",")
            args.append(sums())
        if has_param(name):
            take(",")
            number = take()
            if not number[0].isdigit():
                raise ValueError(f"{name} needs a number, found {number!r}")
            args.append(float(number) if "." in number else int(number))
        take(")")
        return make(name, *args)

    out = sums()
    if pos < len(tokens):
        raise ValueError(f"unexpected {tokens[pos]!r}")
    return out


def seed_nodes() -> list[tuple[Node, str]]:
    """The seeds, parsed, each with its family."""
    return [(parse(text), family) for text, family in SEEDS]


def stable_seed(*parts: object) -> int:
    """A seed that depends on the parts alone: the first eight bytes of the digest of their texts."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def random_param(rng: random.Random, op: str):  # noqa: ANN201
    """A parameter an operator may have, or null for one without."""
    if not has_param(op):
        return None
    return rng.choice(POWERS if op == "signedpower" else LAGS if op in LAGGED else WINDOWS)


def sample(rng: random.Random, levels: int = 4, *, terminals: tuple[str, ...] = TERMINALS, ops: tuple[str, ...] = OPS, leaf: float = 0.35) -> Node:
    """A random tree of a grammar, of at most so many levels; its root is an operator."""
    if levels < 2:
        raise ValueError("a tree has two levels at least")

    def grow(level: int) -> Node:
        if level == levels or level > 1 and rng.random() < leaf:
            return rng.choice(terminals)
        op = rng.choice(ops)
        below = [grow(level + 1) for _ in range(arity(op))]
        p = random_param(rng, op)
        return make(op, *below, *([] if p is None else [p]))

    return grow(1)
