"""python -m tidemark.cli run CONFIG | explore CONFIG | replay FOLDER"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["run", "explore", "replay"])
    p.add_argument("path")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from tidemark.plans import evaluation, exploration

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "run":
        print(evaluation.run(spark, evaluation.load(a.path)))
    elif a.command == "explore":
        print(exploration.run(spark, exploration.load(a.path)))
    else:
        evaluation.replay(spark, a.path).orderBy("task", "method").show(200, truncate=False)


if __name__ == "__main__":
    main()
