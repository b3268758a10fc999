"""python -m loomgraph {get,tree,search,suggest,validate} ROOT ... [--snapshot FOLDER]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomgraph.repository import Repository


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("command", choices=("get", "tree", "search", "suggest", "validate", "refresh"))
    parser.add_argument("root")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--snapshot")
    parser.add_argument("--degree", type=int, default=1)
    parser.add_argument("--k", type=int, default=10)
    parser.add_argument("--contents", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    repo = Repository.open(spark, args.root, args.snapshot) if args.snapshot else Repository.from_path(spark, args.root)
    if args.command == "get":
        print(repo.context(*args.words, degree=args.degree))
    elif args.command == "tree":
        print("\n".join(r.line for r in repo.tree(args.words or None, contents=args.contents).orderBy("line_no").collect()))
    elif args.command == "search":
        repo.search(*args.words, k=args.k).orderBy("qid", "rank").show(args.k * max(len(args.words), 1), truncate=False)
    elif args.command == "suggest":
        for word in args.words:
            repo.suggest(word, args.k).show(args.k, truncate=False)
    elif args.command == "validate":
        repo.validate(*args.words).show(truncate=False)
    else:
        print(repo.tables["files"].count(), "files")


if __name__ == "__main__":
    main()
