"""Command line: spans2puml, spans2pv and pv2puml."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftspan import config as cfg
from weftspan import pipeline
from weftspan.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftspan", description="Workflow diagrams and causal sequences from traces")
    top.add_argument("-o", "--output-dir", default=".", help="folder of the results")
    sub = top.add_subparsers(dest="command", required=True)
    both, model, traces = argparse.ArgumentParser(add_help=False), argparse.ArgumentParser(add_help=False), argparse.ArgumentParser(add_help=False)
    both.add_argument("-d", "--debug", action="store_true", help="show the whole error")
    model.add_argument("-im", "--input-puml-models", action="append", default=[], help="a model to go on from; may be repeated")
    model.add_argument("-om", "--output-puml-models", action="store_true", help="save the models")
    traces.add_argument("-c", "--config", required=True, help="configuration file (.yaml)")
    traces.add_argument("-ni", "--no-ingest", action="store_true", help="use the spans in the store")
    traces.add_argument("-ug", "--unique-graphs", action="store_true", help="one job per structure and workflow")
    sub.add_parser("spans2puml", parents=[both, model, traces], help="span documents to diagrams")
    pv = sub.add_parser("spans2pv", parents=[both, traces], help="span documents to causal sequences")
    pv.add_argument("-se", "--save-events", action="store_true", help="write the sequences")
    pv.add_argument("-mc", "--mapping-config", help="names of the keys to write (.yaml)")
    puml = sub.add_parser("pv2puml", parents=[both, model], help="causal sequences to a diagram")
    puml.add_argument("file_paths", nargs="*", metavar="FILE_PATHS")
    puml.add_argument("-fp", "--folder-path", help="folder of sequence files")
    puml.add_argument("-jn", "--job-name", default="default_name")
    puml.add_argument("-group-by-job", action="store_true", dest="group_by_job", help="files hold one event each")
    puml.add_argument("-mc", "--mapping-config", help="names of the keys in the files (.yaml)")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    Path(args.output_dir).mkdir(exist_ok=True)
    if args.command == "pv2puml":
        if bool(args.folder_path) == bool(args.file_paths):
            raise ValueError("give either a folder or files")
        paths = args.folder_path or args.file_paths
        pv = files.read_pv(spark, paths, cfg.pv_mapping(args.mapping_config), args.group_by_job)
        known = files.read_models(spark, args.input_puml_models) if args.input_puml_models else None
        return pipeline.pv_to_diagrams(pv, args.output_dir, known, args.output_puml_models, args.job_name)
    out = pipeline.traces_to_pv(spark, cfg.load(args.config), not args.no_ingest, args.unique_graphs)
    for r in out.rejected.groupBy("reason").count().orderBy("reason").collect():
        print(f"{args.command}: {r['count']} records rejected: {r.reason}", file=sys.stderr)
    if args.command == "spans2pv":
        return [f"{files.save_sequences(out.pv, args.output_dir, cfg.pv_mapping(args.mapping_config))} sequences"] if args.save_events else [f"{out.pv.count()} events"]
    known = files.read_models(spark, args.input_puml_models) if args.input_puml_models else None
    return pipeline.pv_to_diagrams(out.pv, args.output_dir, known, args.output_puml_models)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftspan").getOrCreate()
    try:
        out = run(spark, args)
        print(*out, sep="\n")
        failed = getattr(out, "failed", [])
        for name, error in failed:
            print(f"{args.command}: no diagram of {name or 'unnamed'}: {error}", file=sys.stderr)
        return 1 if failed else 0
    except (OSError, TypeError, ValueError) as e:
        if args.debug:
            raise
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
