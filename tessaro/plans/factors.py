"""The nineteen composed factors, declared over the expression operators."""

from __future__ import annotations

from typing import NamedTuple

O, H, L, C, V, R, VW = "open", "high", "low", "close", "volume", "returns", "vwap"  # noqa: E741


class Factor(NamedTuple):
    number: int
    lookback: int
    node: object


def _b(op: str):  # noqa: ANN202
    return lambda *args: (op, *args)


neg, absolute, sign, log, root = map(_b, ("neg", "abs", "sign", "log", "sqrt"))
add, sub, mul, div = map(_b, ("add", "sub", "mul", "div"))
delay, delta, sma, low_of, top_of, argmax, rank, scale, sd = map(_b, ("delay", "delta", "sma", "ts_min", "ts_max", "ts_argmax", "ts_rank", "ts_scale", "stddev"))
corr, power, where, lt, le, gt, either = map(_b, ("correlation", "signedpower", "where", "lt", "le", "gt", "or"))


def num(x: float) -> tuple:
    return ("const", x)


_d1 = delta(C, 1)
#: How much faster the price fell in the earlier ten bars than in the later, per close.
_bend = div(sub(div(sub(delay(C, 20), delay(C, 10)), num(10)), div(sub(delay(C, 10), C), num(10))), C)
_spread = sub(C, L)

FACTORS: dict[str, Factor] = {
    "a001": Factor(1, 85, sub(rank(argmax(power(where(lt(R, num(0)), sd(R, 20), C), 2), 5), 60), num(0.5))),
    "a002": Factor(2, 68, neg(corr(rank(delta(log(V), 2), 60), rank(div(sub(C, O), O), 60), 6))),
    "a003": Factor(3, 70, neg(corr(rank(O, 60), rank(V, 60), 10))),
    "a004": Factor(4, 69, neg(rank(rank(L, 60), 9))),
    "a005": Factor(5, 70, mul(rank(sub(O, sma(VW, 10)), 60), neg(absolute(rank(sub(C, VW), 60))))),
    "a006": Factor(6, 10, neg(corr(O, V, 10))),
    "a009": Factor(9, 6, where(either(gt(low_of(_d1, 5), num(0)), lt(top_of(_d1, 5), num(0))), _d1, neg(_d1))),
    "a012": Factor(12, 2, mul(sign(delta(V, 1)), neg(_d1))),
    "a023": Factor(23, 20, where(lt(sma(H, 20), H), neg(delta(H, 2)), num(0))),
    "a024": Factor(24, 200, where(le(div(delta(sma(C, 100), 100), delay(C, 100)), num(0.05)), neg(sub(C, low_of(C, 100))), neg(delta(C, 3)))),
    "a028": Factor(28, 85, scale(sub(add(corr(sma(V, 20), L, 5), div(add(H, L), num(2))), C), 60)),
    "a032": Factor(32, 295, add(scale(sub(sma(C, 7), C), 60), mul(num(20), scale(corr(VW, delay(C, 5), 230), 60)))),
    "a041": Factor(41, 1, sub(root(mul(H, L)), VW)),
    "a043": Factor(43, 40, mul(rank(div(V, sma(V, 20)), 20), rank(neg(delta(C, 7)), 8))),
    "a046": Factor(46, 21, where(gt(_bend, num(0.25)), num(-1), where(lt(_bend, num(0)), num(1), neg(_d1)))),
    "a051": Factor(51, 21, where(lt(_bend, num(-0.05)), num(1), neg(_d1))),
    "a053": Factor(53, 10, neg(delta(div(sub(_spread, sub(H, C)), _spread), 9))),
    "a054": Factor(54, 1, div(mul(neg(sub(L, C)), power(O, 5)), mul(sub(L, H), power(C, 5)))),
    "a101": Factor(101, 1, div(sub(C, O), add(sub(H, L), num(0.001)))),
}
