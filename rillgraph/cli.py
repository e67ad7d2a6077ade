"""prepare, infer and evaluate from the command line, with tables between them."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from rillgraph.plans import pipeline
from rillgraph.sources import readers


def parser() -> argparse.ArgumentParser:
    """The arguments of the three steps."""
    main = argparse.ArgumentParser(prog="rillgraph", description=__doc__)
    steps = main.add_subparsers(dest="step", required=True)
    prepare = steps.add_parser("prepare", help="number a corpus and its questions")
    prepare.add_argument("corpus")
    prepare.add_argument("queries")
    prepare.add_argument("folder")
    prepare.add_argument("--sample", type=int)
    prepare.add_argument("--seed", type=int, default=pipeline.Config.seed)
    infer = steps.add_parser("infer", help="rank the clauses for every question")
    infer.add_argument("folder")
    infer.add_argument("--methods", nargs="+", choices=sorted(pipeline.METHODS))
    infer.add_argument("--graph", help="table of extractions; made by rules without it")
    infer.add_argument("--top-k", type=int)
    infer.add_argument("--config", help="JSON or YAML file of settings")
    evaluate = steps.add_parser("evaluate", help="measure rankings and answers")
    evaluate.add_argument("folder")
    for step in (prepare, infer):
        step.add_argument("--limit", type=int, help="only the first questions, to try things out")
    return main


def run(spark: SparkSession, arguments: list[str]) -> None:
    """One step; results are written below the folder."""
    args = parser().parse_args(arguments)
    if args.step == "prepare":
        corpus, queries = readers.local_benchmark(spark, args.corpus, args.queries)
        queries = readers.sample(queries, args.sample, args.seed)
        if args.limit is not None:
            queries = queries.orderBy("qid").limit(args.limit)
        readers.write_prepared(args.folder, corpus, queries, source=args.corpus, seed=str(args.seed))
    elif args.step == "infer":
        corpus, queries = readers.read_prepared(spark, args.folder)
        if args.limit is not None:
            queries = queries.orderBy("qid").limit(args.limit)
        extracted = spark.read.parquet(args.graph) if args.graph else None
        config = pipeline.load_config(args.config) if args.config else pipeline.Config(methods=("bm25",))
        config = replace(config, methods=tuple(args.methods or config.methods), top_k=args.top_k or config.top_k)
        readers.write_rows(pipeline.infer(corpus, queries, extracted, None, config), f"{args.folder}/predictions")
        settings = {"step": "infer", "methods": ",".join(config.methods), "top_k": str(config.top_k), "preset": config.preset, "graph": args.graph or "rules", "limit": str(args.limit), "code": readers.code_version()}
        readers.write_report(spark.createDataFrame([settings]), f"{args.folder}/run")
    else:
        report = pipeline.evaluate(spark.read.parquet(f"{args.folder}/predictions"), pipeline.Config(group_by=("group",)))
        readers.write_report(report, f"{args.folder}/report")
        report.show(100, truncate=False)


def main() -> None:
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
