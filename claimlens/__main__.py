"""Command line: validate text|text-file|data, repair text|data, cache, lookup.

References come from a folder of cached files or a Parquet store, named by --refs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import ids
from claimlens.operators.repair import repair
from claimlens.operators.report import format_report, report_lines
from claimlens.operators.validate import validate
from claimlens.plans import lifecycle
from claimlens.plans.config import load_config
from claimlens.sources import cache, schema

ONE = "claim_id long, supporting_text string, reference_id string, expected_title string, path string"


def _refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else cache.read_cache(spark, path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimlens", description=__doc__)
    parser.add_argument("--refs", required=True)
    parser.add_argument("--config")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-text", "repair-text"):
        p = sub.add_parser(name)
        p.add_argument("text")
        p.add_argument("reference_id")
        p.add_argument("--title")
    for name in ("validate-text-file", "validate-data", "repair-data"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--apply", action="store_true")
        p.add_argument("--verbose", action="store_true")
        if name == "validate-data":
            p.add_argument("--schema", help="a schema file; claims are found by it instead of by names")
            p.add_argument("--target-class", help="the class of the files' instances; if missing, the only one with the schema's tree_root")
    p = sub.add_parser("lookup")
    p.add_argument("reference_ids", nargs="+")
    p.add_argument("--format", default="md", choices=("md", "json", "yaml", "text"))
    p = sub.add_parser("cache")
    p.add_argument("reference_id")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("claimlens").getOrCreate()
    refs, (config, fixing) = _refs(spark, args.refs), load_config(args.config)
    if args.command == "cache":
        print(spark.range(1).select(ids.cache_name(ids.normalize_reference_id(F.lit(args.reference_id)))).first()[0])
        return 0
    if args.command == "lookup":
        wanted = [spark.range(1).select(ids.normalize_reference_id(F.lit(i), config.reference_prefix_map)).first()[0] for i in args.reference_ids]
        rows = cache.lookup(refs, wanted, args.format).collect()
        for r in rows:
            print(r["value"])
        return 0 if rows else 1
    if args.command in ("validate-text", "repair-text"):
        claim = spark.createDataFrame([(1, args.text, args.reference_id, args.title, None)], ONE)
        if args.command == "validate-text":
            r = validate(claim, refs, config).first()
            print(f"{'valid' if r.is_valid else 'invalid'} [{r.severity}] {r.message}")
            if r.match and r.match.suggested_fix:
                print(r.match.suggested_fix)
            return 0 if r.is_valid else 1
        results = repair(claim, refs, fixing, config)
        print(format_report(results, verbose=True))
        r = results.first()
        return 0 if r.was_valid or r.is_repaired else 1
    if args.command == "validate-text-file":
        rows = lifecycle.validate_text_file(spark, args.path, refs, config).where("not is_valid").select("severity", "message", "path").toLocalIterator()
        errors = 0
        for r in rows:
            print(f"[{r.severity}] {r.path}: {r.message}")
            errors += r.severity == "ERROR"
        return 1 if errors else 0
    if args.command == "validate-data":
        classes, target = None, args.target_class
        if args.schema:
            classes, target = schema.resolved(spark, args.schema), target or schema.root_class(args.schema)
        if target and (classes is None or target not in classes):
            parser.error(f"the schema has no class {target}" if classes is not None else "--target-class needs --schema")
        if classes is not None and target is None:
            parser.error("the schema names no tree_root; give --target-class")
        made = lifecycle.validate_data(spark, args.path, refs, config, target, classes)
        n = 0
        for r in made["findings"].toLocalIterator():
            print(f"[{r.severity}] {r.path}: {r.message}")
            n += 1
        return 1 if n or made["unreadable"].count() else 0
    made = lifecycle.repair_data(spark, args.path, refs, fixing, config)
    for r in report_lines(made["results"], verbose=args.verbose).toLocalIterator():
        print(r["line"])
    if args.apply:
        print(f"{lifecycle.write_back(made['changed'], fixing.create_backup)} files changed")
    report = made["report"].first()
    return 1 if report.removal_count or report.unverifiable_count else 0


if __name__ == "__main__":
    sys.exit(main())
