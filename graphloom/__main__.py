"""python -m graphloom: evaluate a question set over a graph, or convert a collected one. Options may also come from the environment, as GRAPHLOOM_KG_FILE and so on."""

from __future__ import annotations

import argparse
import os
import sys


def arguments(given: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    own = lambda name, default=None: os.environ.get(f"GRAPHLOOM_{name}", default)
    p.add_argument("--kg-file", default=own("KG_FILE"))
    p.add_argument("--questions-file", default=own("QUESTIONS_FILE"))
    p.add_argument("--num-mc", type=int, default=int(own("NUM_MC", "0")), help="multiple-choice questions; 0 for all")
    p.add_argument("--num-tf", type=int, default=int(own("NUM_TF", "0")), help="true-or-false questions; 0 for all")
    p.add_argument("--output", default=own("OUTPUT", "report"), help="folder of the HTML report, or of the converted set")
    p.add_argument("--convert", help="a collected question set to convert instead")
    return p.parse_known_args(given)[0]


def main(given: list[str] | None = None) -> int:
    """Prints the figures and how long they took; returns the exit code."""
    import time

    from pyspark.sql import SparkSession

    from graphloom.operators import evaluate, ingest
    from graphloom.sources import files, sinks

    args = arguments(sys.argv[1:] if given is None else given)
    spark = SparkSession.builder.getOrCreate()
    if args.convert:
        mc, tf = files.raw_questions(spark, args.convert)
        sinks.questions_json(ingest.multiple_choice(mc), ingest.true_false(tf), args.output)
        return 0
    if not (args.kg_file and args.questions_file):
        print("--kg-file and --questions-file are needed", file=sys.stderr)
        return 2
    began = time.time()
    graph = files.graph_json(spark, args.kg_file)
    results, skipped = evaluate.evaluated(files.questions_json(spark, args.questions_file), graph.entities, {"multiple_choice": args.num_mc, "true_false": args.num_tf})
    results = results.cache()
    stats = evaluate.totals(results, skipped)
    print(sinks.summary(stats))
    sinks.html_report(evaluate.full_cards(results), stats, args.output)
    took, n = time.time() - began, results.count()
    print(f"{n} questions in {took:.1f} s, {n / took * 60:.1f} a minute")
    return 0


if __name__ == "__main__":
    sys.exit(main())
