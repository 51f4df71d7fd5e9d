"""``python -m spanloom analyze PATH``: reports on the traces of a file, folder or glob."""

from __future__ import annotations

import argparse
import sys

from spanloom.functions.vectors import HashEmbedder, TableEmbedder
from spanloom.operators.detect import detect
from spanloom.operators.validate import validated
from spanloom.schema import MODEL, REVISION
from spanloom.session import session, ship
from spanloom.sinks import json_reports, markdown_reports
from spanloom.sources.files import load
from spanloom.storage import store


def main(argv: list[str] | None = None) -> int:
    """0 whether or not there is waste, 1 where nothing could be analysed."""
    parser = argparse.ArgumentParser(prog="spanloom")
    analyze = parser.add_subparsers(dest="command", required=True).add_parser("analyze")
    analyze.add_argument("path")
    analyze.add_argument("--out", help="folder for Markdown reports; else they are printed")
    analyze.add_argument("--json", help="folder for JSON reports")
    analyze.add_argument("--no-snippets", action="store_true")
    analyze.add_argument("--vectors", help="Parquet table of text vectors (key, vector); else only repetition word for word is recognised")
    analyze.add_argument("--otlp", action="store_true", help="accept OTLP documents")
    args = parser.parse_args(argv)
    spark = session()
    ship(spark)
    try:
        spans, refused = load(spark, args.path, otlp=args.otlp)
        spans = store(spans, "loaded").df  # files are parsed once
        good, bad = validated(spans)
        good = store(good, "valid").df
        for r in refused.toLocalIterator():
            print(f"Error: {r.file}: {r.reason}", file=sys.stderr)
        for r in bad.toLocalIterator():
            print(f"Error: trace {r.trace_id}: {r.error}", file=sys.stderr)
        embedder = TableEmbedder(spark.read.parquet(args.vectors), MODEL, REVISION) if args.vectors else HashEmbedder()
        verdicts, details = detect(good, embedder)
        if verdicts.isEmpty():
            print("Error: no trace could be analysed", file=sys.stderr)
            return 1
        shown = {"snippets": not args.no_snippets}
        if args.json:
            json_reports(verdicts, details, **shown).select("report").write.mode("overwrite").text(args.json)
        reports = markdown_reports(verdicts, details, **shown).orderBy("trace_id")
        if args.out:
            reports.select("report").write.mode("overwrite").text(args.out)
        else:
            for r in reports.toLocalIterator():
                print(r.report)
        return 0
    except Exception as e:  # a missing path, an unreadable file
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
