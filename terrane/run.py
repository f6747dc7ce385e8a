"""Runs queries by name over a folder of tables and writes their results; seals and checks a decision.

python -m terrane.run queries FOLDER OUT [--only NAME ...] [--first NAME] [--last NAME]
python -m terrane.run seal FILE SEAL --by NAME      python -m terrane.run check FILE SEAL
"""

from __future__ import annotations

import argparse
import sys

from terrane.operators.governance import Seal


def chosen(names: list[str], only: list[str] | None = None, first: str | None = None, last: str | None = None) -> list[str]:
    """The names asked for, in their order: some, or a stretch from the first to the last; unknown ones are an error."""
    unknown = {*(only or []), *filter(None, (first, last))} - set(names)
    if unknown:
        raise KeyError(f"no such query: {sorted(unknown)}")
    stretch = names[names.index(first) if first else 0 : names.index(last) + 1 if last else None]
    return [n for n in stretch if not only or n in only]


def run_queries(spark, queries: dict, folder: str, out: str, names: list[str]) -> list[str]:
    """Write each query's result as Parquet below ``out``; one that fails stops the run, as later ones may rest on it."""
    for n in names:
        queries[n](spark, folder).write.mode("overwrite").parquet(f"{out}/{n}.parquet")
    return names


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    q = sub.add_parser("queries")
    q.add_argument("folder"), q.add_argument("out"), q.add_argument("--only", nargs="*"), q.add_argument("--first"), q.add_argument("--last")
    for name in ("seal", "check"):
        s = sub.add_parser(name)
        s.add_argument("file"), s.add_argument("seal")
        if name == "seal":
            s.add_argument("--by", required=True)
    a = p.parse_args(argv)
    if a.what == "seal":
        Seal(a.seal, a.file).close(by=a.by)
    elif a.what == "check":
        print(Seal(a.seal, a.file).facts())
    else:
        from pyspark.sql import SparkSession

        from terrane.plans import catalogue, problems

        queries = problems.QUERIES | catalogue.QUERIES
        run_queries(SparkSession.builder.getOrCreate(), queries, a.folder, a.out, chosen(list(queries), a.only, a.first, a.last))
    return 0


if __name__ == "__main__":
    sys.exit(main())
