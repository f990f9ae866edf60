"""Command line: python -m quantloom STAGE --raw DIR --out DIR; tables are Parquet, reports CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators import panel, subperiods
from quantloom.operators.cleaning import clean_monthly
from quantloom.plans import runs
from quantloom.sources import readers, sinks

RAW = ("raw_monthly", "raw_names", "raw_delistings", "raw_security", "raw_annual", "raw_quarterly", "raw_daily", "raw_market", "raw_factors")
STAGES = ("panel", "train", "evaluate", "periods", "costs", "parsimony")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--raw", required=True, help="folder of the raw tables")
    p.add_argument("--out", required=True, help="folder of panels, predictions and reports")
    p.add_argument("--models", nargs="+", default=["all"])
    p.add_argument("--append", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--hold-out-from", type=int, default=1975)
    p.add_argument("--test-from", type=int, default=1987)
    p.add_argument("--test-to", type=int, default=2016)
    p.add_argument("--period", nargs=3, action="append", metavar=("NAME", "FROM", "TO"), default=[])
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("quantloom").getOrCreate()
    raw = {n: readers.parquet(spark, f"{a.raw}/{n}") for n in RAW}
    features, preds = f"{a.out}/features_panel", f"{a.out}/predictions"
    models = list(subperiods.MODEL_ORDER) if a.models == ["all"] else a.models
    if a.stage == "panel":
        sinks.parquet(panel.feature_panel(raw), features)
        return {}
    p = readers.parquet(spark, features)
    years = (a.hold_out_from, a.test_from, a.test_to)
    if a.stage == "train":
        runs.train(p, preds, models, *years, append=a.append, resume=a.resume)
        return {}
    clean = clean_monthly(raw["raw_monthly"], raw["raw_names"], raw["raw_delistings"])
    bench = runs.pretest_mean(p, a.test_from).first()["bench"]
    if a.stage == "parsimony":
        small, _ = runs.small_panel(p, a.hold_out_from, a.test_from, a.out)
        runs.train(small, f"{preds}_parsimony", models, *years, append=a.append, resume=a.resume)
        both = [runs.evaluate(readers.parquet(spark, f"{preds}{s}"), p, clean, raw["raw_factors"], bench, f"{a.out}/eval{s}", audited=bool(s)) for s in ("", "_parsimony")]
        delta = runs.compare(both[0]["eval_oos_r2"], both[1]["eval_oos_r2"])
        sinks.csv(delta, f"{a.out}/parsimony_delta")
        return {"parsimony_delta": delta} | both[1]
    scored = readers.parquet(spark, preds)
    if a.stage == "evaluate":
        return runs.evaluate(scored, p, clean, raw["raw_factors"], bench, f"{a.out}/eval")
    if a.stage == "periods":
        return runs.evaluate_periods(scored, p, clean, raw["raw_factors"], [tuple(x) for x in a.period], bench, f"{a.out}/periods")
    return runs.evaluate_costs(scored, p, clean, raw["raw_factors"], f"{a.out}/costs")


if __name__ == "__main__":
    main()
