"""python -m tessaro backtest | search | query: the engine over a lake, or a query over test tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import volatility
from .operators import policy, search, signals, simulate
from .operators.resample import number_bars
from .session import local_session, ship
from .sources import lake


def _bars(spark: SparkSession, args: argparse.Namespace, symbols: list[str]) -> DataFrame:
    minutes = lake.candles(spark, args.lake_root, None, args.granularity, args.start, args.end)
    return number_bars(minutes.filter(F.col("product_id").isin(*symbols)))


def backtest(spark: SparkSession, args: argparse.Namespace) -> int:
    """One portfolio of the symbols, by trend weights or by actions; 2 if there is nothing to trade."""
    symbols = [s.strip() for s in args.symbols.split(",") if s.strip()]
    bars = _bars(spark, args, symbols).persist()
    counts = {r["product_id"]: r["count"] for r in bars.groupBy("product_id").count().collect()}  # as many as there are symbols
    for s in symbols:
        if counts.get(s, 0) < 2:
            print(f"{s}: {counts.get(s, 0)} bars under {args.lake_root}", file=sys.stderr)
    usable = [s for s in symbols if counts.get(s, 0) >= 2]
    if not usable:
        print("no usable price data", file=sys.stderr)
        return 2
    weight = args.mode == "weight"
    every = args.rebalance_every or (7 if weight else 1)
    bars = bars.filter(F.col("product_id").isin(*usable)).withColumn("run_id", F.lit("all"))
    # Only times that all symbols have count; bars are numbered by them.
    shared = simulate.aligned(bars.drop("bar_idx").withColumnRenamed("ts", "bar_idx"), ["run_id"]).withColumnRenamed("bar_idx", "ts").drop("run_id")
    bars = number_bars(shared).persist()
    if weight:
        seen = volatility.trend(bars).select("product_id", "bar_idx", volatility.target_weight(F.col("score"), F.col("sigma"), args.sigma_target).alias("weight"))
    else:
        log = lake.decisions(spark, args.replay_path) if args.replay_path else None
        said = signals.states(bars, args.signal or "buy_and_hold", every=every, log=log)
        seen = said.withColumn("action", policy.action(F.col("regime"), F.col("confidence"))).persist()
    rows = bars.select("product_id", "bar_idx", "open", "close").join(seen, ["product_id", "bar_idx"], "left")
    order = F.array_position(F.array(*map(F.lit, usable)), F.col("product_id")).cast("string")
    rows = rows.withColumns({"run_id": F.lit("all"), "symbol_ord": order, "cost_bps": F.lit(args.cost_bps + args.slippage_bps)})
    engine = simulate.weight_engine if weight else simulate.action_engine
    more = {"band": args.no_trade_band} if weight else {}
    curve = engine(rows, every=every, capital=args.initial_capital, **more).persist()
    m = simulate.metrics(curve, args.granularity).first()
    if m is None or m["n_bars"] < 2:
        print("no usable price data", file=sys.stderr)
        return 2
    stamps = bars.select("bar_idx", "ts").distinct()
    first, last = stamps.agg(F.min("ts"), F.max("ts")).first()
    label = f"weight (band={args.no_trade_band:.2f}, sigma={args.sigma_target:.2f})" if weight else args.signal or "buy_and_hold"
    print(f"signal {label}; symbols {', '.join(usable)}; {first} to {last}, {m['n_bars']} bars of {args.granularity}")
    print(f"capital {args.initial_capital:,.2f} -> {args.initial_capital if m['total_return'] is None else curve.agg(F.max_by('equity', 'bar_idx')).first()[0]:,.2f}")
    for name in ("total_return", "cagr", "ann_vol", "max_drawdown"):
        print(f"  {name:<13} {100 * m[name]:+.2f}%")
    print(f"  sharpe {m['sharpe']:+.3f}  sortino {m['sortino']:+.3f}  calmar {m['calmar']:+.3f}  trades {m['n_trades']}  turnover {m['turnover']:.2f}x")
    if args.out:
        timed = curve.join(stamps, "bar_idx")
        timed.select("ts", "equity").write.mode("overwrite").json(f"{args.out}/equity_curve")
        timed.select("ts", F.inline("fills")).write.mode("overwrite").json(f"{args.out}/trades")
        simulate.metrics(curve, args.granularity).write.mode("overwrite").json(f"{args.out}/metrics")
        if not weight:
            seen.join(bars.select("product_id", "bar_idx", "ts"), ["product_id", "bar_idx"]).write.mode("overwrite").json(f"{args.out}/decisions")
    return 0


def run_search(spark: SparkSession, args: argparse.Namespace) -> int:
    """2 without bars, or with an archive that isn't to be resumed; 3 if its holdout was looked at."""
    bars = _bars(spark, args, [args.symbol])
    if bars.isEmpty():
        print(f"no {args.granularity} bars of {args.symbol} under {args.lake_root}", file=sys.stderr)
        return 2
    records, meta = lake.read_archive(spark, args.archive) if args.archive else ([], {})
    if records and not args.resume:
        print(f"{args.archive} exists; resume it with --resume", file=sys.stderr)
        return 2
    null_doc = json.loads("".join(r[0] for r in spark.read.text(args.null_doc, wholetext=True).collect())) if args.null_doc else None
    archive = search.Archive(records, meta)
    try:
        found = search.run_search(
            bars, symbol=args.symbol, seed=args.seed, gates=search.calibrate(null_doc), generations=args.generations, per_generation=args.per_generation, holdout_frac=args.holdout_frac,
            purge=args.purge, embargo=args.embargo, top_k=args.top_k, archive=archive, resume=args.resume, kind=f"lake:{args.granularity}",
        )
    except search.HoldoutSpent as spent:
        print(f"refused: {spent}", file=sys.stderr)
        return 3
    if args.archive:
        lake.write_archive(spark, args.archive, archive.meta, archive.records)
    if args.out:
        lake.write_text(spark, args.out, json.dumps(found, indent=1, sort_keys=True))
    counts = found["ledger"]
    print(f"{args.symbol}: {found['n_bars']} bars, {counts['n_trials']} trials ({counts['n_duplicates']} duplicates, {counts['n_refused']} refused, {counts['n_rejected']} rejected), gates {found['gates']['version']}")
    for best in found["best_so_far"][-1:]:
        print(f"best correlation {best['abs_ic']} against {best['threshold']} after {best['n_trials']} trials")
    if not found["holdout"]["touched"]:
        print("holdout: not looked at")
    for r in found["holdout"]["results"]:
        fees = r["fee_after"] or {}
        print(f"holdout {r['expr_id']} {r['text']}: ic {r['ic']} n {r['n']} p_adj {r['p_adj']} passed {r['passed']}; dies at {fees.get('dies_at_bps')} bps -> {fees.get('label')}")
        print("  lineage: " + " <- ".join(f"{c['op']}:{c['text']}" for c in archive.lineage(r["expr_id"])))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tessaro")
    sub = out.add_subparsers(dest="command", required=True)
    b, s = sub.add_parser("backtest"), sub.add_parser("search")
    for p in (b, s):
        p.add_argument("--lake-root", default=lake.default_root())
        p.add_argument("--granularity", default="1h")
        p.add_argument("--start")
        p.add_argument("--end")
        p.add_argument("--out")
    b.add_argument("--symbols", required=True)
    b.add_argument("--mode", choices=("discrete", "weight"), default="discrete")
    b.add_argument("--signal", choices=signals.NAMES)
    b.add_argument("--replay-path")
    for name, value in (("initial-capital", 10_000.0), ("cost-bps", 10.0), ("slippage-bps", 5.0), ("no-trade-band", 0.10), ("sigma-target", 0.10)):
        b.add_argument(f"--{name}", type=float, default=value)
    b.add_argument("--rebalance-every", type=int)
    s.add_argument("--symbol", required=True)
    for name, value in (("seed", 7), ("generations", 8), ("per-generation", 6), ("purge", 24), ("embargo", 24), ("top-k", 3)):
        s.add_argument(f"--{name}", type=int, default=value)
    s.add_argument("--holdout-frac", type=float, default=0.2)
    s.add_argument("--archive")
    s.add_argument("--resume", action="store_true")
    s.add_argument("--null-doc")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("folder")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "backtest":
        if args.mode == "weight" and (args.signal or args.replay_path):
            raise SystemExit("--signal and --replay-path belong to --mode discrete")
        if args.mode == "discrete" and (args.no_trade_band, args.sigma_target) != (0.10, 0.10):
            raise SystemExit("--no-trade-band and --sigma-target belong to --mode weight")
        if args.signal == "replay" and not args.replay_path:
            raise SystemExit("--signal replay needs --replay-path")
    spark = SparkSession.getActiveSession() or local_session(4)
    ship(spark)
    if args.command == "query":
        from .plans import catalog

        catalog.queries()[args.name](spark, args.folder).show(50, truncate=False)
        return 0
    return backtest(spark, args) if args.command == "backtest" else run_search(spark, args)


if __name__ == "__main__":
    sys.exit(main())
