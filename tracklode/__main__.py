"""Command line: ``python -m tracklode score-answer PREDICTION GOLD...`` prints exact match and F1 as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions import sql


def main(arguments: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tracklode")
    commands = parser.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score-answer", help="exact match and token F1 of an answer against gold answers")
    score.add_argument("prediction")
    score.add_argument("gold", nargs="+")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sql.register(spark)
    s = spark.sql("SELECT score_answer(:prediction, :golds) AS s", {"prediction": given.prediction, "golds": given.gold}).first()["s"]
    made = {"em": s["em"], "f1": s["f1"]}
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
