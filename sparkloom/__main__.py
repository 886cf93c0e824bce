"""Command lines: `python -m sparkloom gitstats ROOT`, `scan ROOT`, `diff FILE`, `evaluate CASES PREDICTIONS`."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom")
    sub = parser.add_subparsers(dest="what", required=True)
    for name, args in (("gitstats", ["root"]), ("scan", ["root"]), ("diff", ["file"]), ("evaluate", ["cases", "predictions"])):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    args = parser.parse_args(argv)
    if args.what == "diff":
        from sparkloom.sources.diff import parse

        with open(args.file, encoding="utf-8") as f:
            print(json.dumps([{"status": x.status, "old": x.old, "new": x.new, "changed": sum(k in "+-" for k, *_ in x.lines)} for x in parse(f.read())]))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    if args.what == "gitstats":
        from sparkloom.operators.churn import churn
        from sparkloom.sources.gitlog import history

        tracked, commits = history(spark, args.root)
        out = churn(tracked, commits, F.current_timestamp()).orderBy("path")
    elif args.what == "scan":
        from sparkloom.sources.scan import scan

        out = scan(spark, args.root).drop("content").orderBy("path")
    else:
        from sparkloom.operators.assess import evaluation_report

        read = lambda p: spark.read.option("multiLine", True).json(p)
        cases = read(args.cases).select(F.explode("cases").alias("c")).select("c.*")
        predictions = read(args.predictions).select(F.explode("predictions").alias("p")).select("p.*")
        out = evaluation_report(cases, predictions).orderBy("case_id")
    for row in out.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
