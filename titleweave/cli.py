"""Title matching from the command line: python -m titleweave.cli COMMAND ...

    train-model                  --train FILE --truth FILE --model FOLDER
    generate-predictions         --test FILE --truth FILE [--model FOLDER] --output FOLDER
    closest-search-single-title  --title-to-search TEXT --truth FILE [--model FOLDER]
    get-predictions-accuracy     --actuals FILE --predictions FOLDER

Files are delimited text with a header (see sources/titles.py), or anything that Spark reads by such a path.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from titleweave import __version__
from titleweave.operators.candidates import build_index
from titleweave.operators.evaluate import accuracy_report
from titleweave.operators.training import load_model, save_model, train_model
from titleweave.plans.cascade import evaluate_model, generate_predictions, labelled_pairs, search_title
from titleweave.sources.titles import read_delimited, write_delimited
from titleweave.timing import timed

LEVELS = [logging.WARNING, logging.WARNING, logging.INFO]
#: Names of the columns of written predictions.
PREDICTIONS = {"test_index": ("test_index", "long"), "title_id": ("title_id", "long")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="titleweave", description="Match misspelt titles with reference titles.")
    out.add_argument("-v", "--verbose", action="count", default=0, help="twice: what happens; three times: everything")
    out.add_argument("--version", action="version", version=f"titleweave {__version__}")
    commands = out.add_subparsers(dest="command", required=True)
    wanted = {
        "train-model": ["train", "truth", "model"],
        "generate-predictions": ["test", "truth", "output"],
        "closest-search-single-title": ["truth"],
        "get-predictions-accuracy": ["actuals", "predictions"],
    }
    for name, options in wanted.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        if "model" not in options and "truth" in options:
            command.add_argument("--model")
    commands.choices["closest-search-single-title"].add_argument("-t", "--title-to-search", required=True)
    return out


def accuracy_of_files(spark: SparkSession, actuals: str, predictions: str) -> DataFrame:
    """The accuracy of written predictions against a labelled file; see accuracy_report."""
    found = read_delimited(spark, predictions, "actuals", PREDICTIONS)
    return accuracy_report(read_delimited(spark, actuals, "actuals"), found)


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Carry out a parsed command; the lines to print."""
    told = lambda df: [", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in df.collect()]
    with timed(args.command):
        if args.command == "get-predictions-accuracy":
            return told(accuracy_of_files(spark, args.actuals, args.predictions))
        truth = read_delimited(spark, args.truth, "truth")
        if args.command == "train-model":
            index = build_index(truth)
            pairs = labelled_pairs(read_delimited(spark, args.train, "train"), truth, index=index)
            model = train_model(pairs, truth, index.n)
            save_model(model, args.model)
            return told(evaluate_model(model, pairs, truth, index.n).orderBy("is_eval"))
        model = load_model(args.model) if args.model else None
        if args.command == "generate-predictions":
            write_delimited(generate_predictions(read_delimited(spark, args.test, "test"), truth, model), args.output)
            return [args.output]
        return told(search_title(spark, args.title_to_search, truth, model))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=LEVELS[args.verbose] if args.verbose < len(LEVELS) else logging.DEBUG)
    print("\n".join(run(SparkSession.builder.appName("titleweave").getOrCreate(), args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
