"""Expressions to plans: one named column per distinct subtree, one projection per layer.

Both targets share the layers: a Spark DataFrame, where every window has the same partition (a
stretch of a product's bars) and order, so the whole plan has one exchange and one sort; and SQL
text for checking. Beside the operators of the text form there are constants, comparisons, and
("forward", h), the log return of the next h bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import EPS, clip, finite, sdiv, sln
from .expr import TERMINALS
from .stretches import KEY, ORDER, along, frame, in_stretches


_FRAMED = ("sma", "ts_sum", "ts_min", "ts_max", "ts_argmax", "ts_rank", "ts_scale", "stddev", "correlation")


def operands(node: tuple) -> tuple:
    """The children of any node, also of the operators that have no text form."""
    if node[0] == "const":
        return ()
    return tuple(x for x in node[1:] if isinstance(x, (str, tuple)))


def layers(nodes: list) -> list[list]:
    """Distinct non-terminal nodes by the longest way down to a terminal."""
    level: dict = {}

    def visit(node) -> int:  # noqa: ANN001
        if isinstance(node, str) and node not in ("returns", "vwap"):
            return 0
        if node not in level:
            below = () if isinstance(node, str) else operands(node)
            level[node] = 1 + max(map(visit, below), default=0)
        return level[node]

    for node in nodes:
        visit(node)
    out: list[list] = [[] for _ in range(max(level.values(), default=0))]
    for node, k in level.items():
        out[k - 1].append(node)
    return out


def reaches(node) -> tuple[int, int]:  # noqa: ANN001
    """How many bars back and ahead a node's value depends on."""
    if isinstance(node, str):
        return int(node == "returns"), 0
    if node[0] == "forward":
        return 0, node[1]
    below = [reaches(x) for x in operands(node)]
    own = node[-1] if node[0] in ("delay", "delta") else node[-1] - 1 if node[0] in _FRAMED else 0
    return own + max((b for b, _ in below), default=0), max((a for _, a in below), default=0)


def full(x: Column, w: int, value: Column) -> Column:
    """value where the trailing window is complete and free of nulls."""
    return F.when(F.count(x).over(frame(w)) == w, value)


def trailing_rank(x: Column, w: int) -> Column:
    """Midrank of the current value in its trailing window, in (0, 1]: from where it stands in the sorted window, from either end."""
    seen = F.sort_array(F.collect_list(x).over(frame(w)))
    less, above = F.array_position(seen, x) - 1, F.array_position(F.reverse(seen), x) - 1
    return full(x, w, ((less + w - above) / 2 + 0.5) / w)


def trailing_correlation(x: Column, y: Column, w: int) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    vx, vy = F.var_pop(x).over(frame(w)), F.var_pop(y).over(frame(w))
    r = F.try_divide(F.covar_pop(x, y).over(frame(w)), F.sqrt(vx) * F.sqrt(vy))
    return F.when((F.count(both).over(frame(w)) == w) & (vx * w >= EPS) & (vy * w >= EPS), clip(r, -1.0, 1.0))


def column(node, ref) -> Column:  # noqa: ANN001, C901, PLR0911
    """The column of one node over its children's columns."""
    if node == "returns":
        before = F.lag("close", 1).over(along())
        return sdiv(F.col("close"), before) - 1
    if node == "vwap":
        return (F.col("high") + F.col("low") + F.col("close")) / 3
    op = node[0]
    if op == "const":
        return F.lit(float(node[1]))
    if op == "forward":
        then = F.lead("close", node[1]).over(along())
        return F.when((F.col("close") > 0) & (then > 0), F.ln(F.try_divide(then, F.col("close"))))
    x = [ref(c) for c in operands(node)]
    p = node[-1]
    if op == "neg":
        return -x[0]
    if op == "abs":
        return F.abs(x[0])
    if op == "sign":
        return F.signum(x[0])
    if op == "log":
        return sln(x[0])
    if op == "sqrt":
        return F.when(x[0] >= 0, F.sqrt(x[0]))
    if op == "signedpower":
        return finite(F.signum(x[0]) * F.pow(F.abs(x[0]), F.lit(float(p))))
    if op in ("add", "sub", "mul"):
        return finite({"add": x[0] + x[1], "sub": x[0] - x[1], "mul": x[0] * x[1]}[op])
    if op == "div":
        return finite(sdiv(x[0], x[1]))
    if op in ("lt", "le", "gt"):
        return {"lt": x[0] < x[1], "le": x[0] <= x[1], "gt": x[0] > x[1]}[op]
    if op == "or":
        return x[0] | x[1]
    if op == "where":
        return F.when(x[0].isNotNull(), F.when(x[0], x[1]).otherwise(x[2]))
    if op == "delay":
        return F.lag(x[0], p).over(along())
    if op == "delta":
        return finite(x[0] - F.lag(x[0], p).over(along()))
    if op == "correlation":
        return trailing_correlation(x[0], x[1], p)
    if op == "ts_rank":
        return trailing_rank(x[0], p)
    if op == "ts_scale":
        return sdiv(x[0], full(x[0], p, F.avg(F.abs(x[0])).over(frame(p))))
    if op == "ts_argmax":
        return full(x[0], p, F.array_position(F.collect_list(x[0]).over(frame(p)), F.max(x[0]).over(frame(p))).cast("double"))
    aggregate = {"sma": F.avg, "ts_sum": F.sum, "ts_min": F.min, "ts_max": F.max, "stddev": F.stddev_samp}[op]
    return full(x[0], p, aggregate(x[0]).over(frame(p)))


def evaluate(bars: DataFrame, exprs: dict[str, object], span: int | None = None) -> DataFrame:
    """The bars with one column per named expression; subtrees that recur are computed once, stretch by stretch."""
    name: dict = {t: t for t in TERMINALS if t not in ("returns", "vwap")}
    ref = lambda node: F.col(name[node])

    def make(df: DataFrame) -> DataFrame:
        for level, nodes in enumerate(layers(list(exprs.values()))):
            new = {f"_e{level}_{i}": node for i, node in enumerate(nodes)}
            df = df.withColumns({c: column(node, ref) for c, node in new.items()})
            name.update({node: c for c, node in new.items()})
        return df

    reach = [reaches(node) for node in exprs.values()]
    df = in_stretches(bars, max(b for b, _ in reach), make, max(a for _, a in reach), span)
    return df.select(*bars.columns, *(F.col(name[node]).alias(out) for out, node in exprs.items()))


def _sql(node, ref) -> str:  # noqa: ANN001, C901, PLR0911
    w = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER}"
    over = w + ")"
    if node == "returns":
        return f"CASE WHEN abs(lag(close, 1) {over}) >= 1e-12 THEN close / lag(close, 1) {over} - 1 END"
    if node == "vwap":
        return "(high + low + close) / 3"
    op, p = node[0], node[-1]
    if op == "forward":
        return f"CASE WHEN close > 0 AND lead(close, {p}) {over} > 0 THEN ln(lead(close, {p}) {over} / close) END"
    if op == "const":
        return f"CAST({node[1]} AS DOUBLE)"
    x = [ref(c) for c in operands(node)]
    simple = {
        "neg": "-{0}", "abs": "abs({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "log": "CASE WHEN {0} > 0 THEN ln({0}) END", "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END",
        "add": "{0} + {1}", "sub": "{0} - {1}", "mul": "{0} * {1}", "div": "CASE WHEN abs({1}) >= 1e-12 THEN {0} / {1} END", "lt": "{0} < {1}", "le": "{0} <= {1}", "gt": "{0} > {1}",
        "or": "{0} OR {1}", "where": "CASE WHEN {0} IS NULL THEN NULL WHEN {0} THEN {1} ELSE {2} END",
    }
    if op in simple:
        return simple[op].format(*x)
    if op == "signedpower":
        return f"sign({x[0]}) * pow(abs({x[0]}), {p})"
    if op == "delay":
        return f"lag({x[0]}, {p}) {over}"
    if op == "delta":
        return f"{x[0]} - lag({x[0]}, {p}) {over}"
    rows = f"{w} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    if op == "correlation":
        a, b = x
        vx, vy = f"var_pop({a}) {rows}", f"var_pop({b}) {rows}"
        return (
            f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) {rows} = {p} AND {vx} * {p} >= 1e-12 AND {vy} * {p} >= 1e-12 "
            f"THEN greatest(-1.0, least(1.0, covar_pop({a}, {b}) {rows} / (sqrt({vx}) * sqrt({vy})))) END"
        )
    a = x[0]
    seen = f"list({a}) {rows}"
    value = {
        "sma": f"avg({a}) {rows}", "ts_sum": f"sum({a}) {rows}", "ts_min": f"min({a}) {rows}", "ts_max": f"max({a}) {rows}", "stddev": f"stddev_samp({a}) {rows}",
        "ts_argmax": f"CAST(list_position({seen}, max({a}) {rows}) AS DOUBLE)",
        "ts_rank": f"(len(list_filter({seen}, lambda v: v < {a})) + (len(list_filter({seen}, lambda v: v = {a})) + 1) / 2.0) / {p}",
        "ts_scale": f"CASE WHEN avg(abs({a})) {rows} >= 1e-12 THEN {a} / avg(abs({a})) {rows} END",
    }[op]
    return f"CASE WHEN count({a}) {rows} = {p} THEN {value} END"


def to_sql(source: str, exprs: dict[str, object], prefix: str = "e") -> tuple[list[str], str]:
    """(common table expressions, name of the last): the same layers over the table `source` of bars."""
    name: dict = {t: t for t in TERMINALS if t not in ("returns", "vwap")}
    ctes, last = [], source
    for level, nodes in enumerate(layers(list(exprs.values()))):
        new = {f"{prefix}{level}_{i}": node for i, node in enumerate(nodes)}
        ctes.append(f"{prefix}_{level} AS (SELECT *, " + ", ".join(f"{_sql(node, lambda n: name[n])} AS {c}" for c, node in new.items()) + f" FROM {last})")
        name |= {node: c for c, node in new.items()}
        last = f"{prefix}_{level}"
    ctes.append(f"{prefix}_out AS (SELECT {KEY}, {ORDER}, open, high, low, close, volume, " + ", ".join(f"{name[n]} AS {out}" for out, n in exprs.items()) + f" FROM {last})")
    return ctes, f"{prefix}_out"
