"""Command line: analyze, visualize, config, validate, compare, report, version."""

from __future__ import annotations

import argparse
import json
import sys

from .config import ALGORITHMS, FORMATS, METHODS, Config, load_config

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillscope")
    sub = p.add_subparsers(dest="command", required=True)

    def settings(q: argparse.ArgumentParser) -> None:
        q.add_argument("path")
        q.add_argument("--format", choices=("csv", "json", "influx"))
        q.add_argument("--config")
        q.add_argument("--per-file", action="store_true", help="each file of the path is a series")
        q.add_argument("--algorithm", choices=ALGORITHMS)
        q.add_argument("--method", choices=METHODS)
        q.add_argument("--threshold", type=float)

    a = sub.add_parser("analyze")
    settings(a)
    a.add_argument("--output")
    a.add_argument("--output-format", choices=FORMATS)
    a.add_argument("--wide", action="store_true")
    r = sub.add_parser("report")
    settings(r)
    r.add_argument("--output", required=True)
    r.add_argument("--title", default="Congestion")
    z = sub.add_parser("visualize")
    settings(z)
    z.add_argument("--output", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--format", choices=("csv", "json", "influx"))
    c = sub.add_parser("compare")
    settings(c)
    c.add_argument("--algorithms", nargs="+", default=["rbeast", "adtk"])
    c.add_argument("--output")
    t = sub.add_parser("config")
    t.add_argument("--template", required=True)
    sub.add_parser("version")
    return p


def _config(args: argparse.Namespace) -> Config:
    """What is given on the command line wins over the file, the file over the defaults."""
    detection = {k: v for k, v in (("algorithm", args.algorithm), ("threshold", args.threshold)) if v is not None}
    explicit: dict = {"change_point_detection": detection}
    if args.method is not None:
        explicit["jitter_analysis"] = {"method": args.method}
    if getattr(args, "output_format", None):
        explicit["output_format"] = args.output_format
    return load_config(args.config, explicit)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config":
        Config().save(args.template)
        return 0
    from .operators.summary import first_congested, time_summary
    from .operators.windows import min_intervals, validation_metrics
    from .plans.pipeline import Pipeline, compare
    from .session import get_session
    from .sinks import save
    from .sources import read_path

    spark = get_session()
    if args.command == "validate":
        for row in validation_metrics(read_path(spark, args.path, args.format)).toLocalIterator():
            print(json.dumps(row.asDict()))
        return 0
    config = _config(args)
    samples = read_path(spark, args.path, args.format, per_file=args.per_file)
    if args.command == "compare":
        found = compare(min_intervals(samples, config.data_processing.minimum_interval_minutes), config.change_point_detection, args.algorithms)
        if args.output:
            from .sinks.report import write_comparison

            write_comparison(spark, found, args.output)
        else:
            found.groupBy("series_id", "detector").count().show()
        return 0
    result = Pipeline(spark, config).run(samples)
    if args.command == "visualize":
        from .sinks.report import plot_relations

        for name, df in plot_relations(result).items():
            df.write.mode("overwrite").parquet(f"{args.output}/{name}")
        return 0
    if args.command == "report":
        from .sinks.report import write_report

        write_report(spark, result, args.output, args.title)
        return 0
    if args.output:
        save(result.inferences, args.output, config.output_format, args.wide, metadata=result.metadata)
    time_summary(result.inferences).show()
    first_congested(result.inferences, 5).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
