"""Command line: python -m kinweave STEP --data DIR --work DIR --output DIR, with STEP a step of ``engine``, finish, report, diagnose or all."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinweave import engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinweave")
    p.add_argument("step", choices=[*engine.STEPS, "finish", "report", "diagnose", "all"])
    for folder in ("data", "work", "output"):
        p.add_argument(f"--{folder}", required=True, help="a folder that all executors share")
    p.add_argument("--split", choices=[engine.TRAIN, engine.TEST], default=engine.TRAIN)
    p.add_argument("--rule", choices=["threshold", "expected_f"], default="expected_f")
    p.add_argument("--gate", choices=["full", "narrow", "open"], default="full")
    p.add_argument("--no-generator", action="store_true", help="decide by scores alone, without the word and number rules")
    p.add_argument("--prior", action="store_true", help="decide by a learned prior over counts")
    p.add_argument("--rounds", type=int, default=40)
    p.add_argument("--depth", type=int, default=5)
    a = p.parse_args(argv)
    s = engine.Settings(a.data, a.work, a.output, rounds=a.rounds, depth=a.depth, rule=a.rule, gate=a.gate, generator=not a.no_generator, prior=a.prior)
    spark = SparkSession.builder.getOrCreate()
    if a.step in engine.STEPS:
        engine.STEPS[a.step](spark, s, a.split)
        return 0
    if a.step in ("report", "diagnose"):
        (engine.block_report if a.step == "report" else engine.diagnose)(spark, s).orderBy("country").show(1000, truncate=False)
        return 0
    wrong = engine.run(spark, s) if a.step == "all" else engine.finish(spark, s)
    print("\n".join(wrong))
    return 1 if wrong else 0


if __name__ == "__main__":
    raise SystemExit(main())
