"""Command line: list and run registered queries, show their plans, read graphs, count and check them."""

from __future__ import annotations

import argparse


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    for name, text in (("run", "run a query and write or show its rows"), ("show", "show the physical plan of a query")):
        c = sub.add_parser(name, help=text)
        c.add_argument("query")
        c.add_argument("data", help="directory of the parquet tables")
        if name == "run":
            c.add_argument("--out", help="parquet directory; without it the first rows are shown")
            c.add_argument("--rows", type=int, default=20)
    c = sub.add_parser("count", help="count measures of RDF files")
    c.add_argument("path", nargs="+")
    c.add_argument("--style", choices=("markdown", "csv", "html", "text"), default="markdown")
    c = sub.add_parser("convert", help="RDF files to N-Triples or wide CSV")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--to", choices=("nt", "csv"), default="nt")
    return p


def main(argv: list[str] | None = None, queries=None, spark=None) -> int:
    """`queries` (name -> function) defaults to those of the core; `spark` to a local session."""
    args = build().parse_args(argv)
    if queries is None:
        from .plans.queries import queries as registered

        queries = registered()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if spark is None:
        from .session import get_spark

        spark = get_spark("loomgraph-cli")
    if args.command in ("run", "show"):
        if args.query not in queries:
            print(f"no query {args.query}")
            return 2
        df = queries[args.query](spark, args.data)
        if args.command == "show":
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.rows, truncate=80)
        return 0
    from .sources import rdf

    graph = rdf.read_graph(spark, args.path)
    if args.command == "count":
        from .operators.statistics import count_measures
        from .plans.report import to_text

        print(to_text(count_measures(graph).orderBy("measurement"), args.style))
    elif args.to == "nt":
        rdf.write_ntriples(graph, args.out)
    else:
        rdf.write_wide_csv(graph, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
