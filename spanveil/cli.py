"""Command line: redact and reveal files, look up tokens, look after namespaces."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from spanveil.plans.session import RedactionSession
from spanveil.sources.files import read_files
from spanveil.sources.store import Namespace, namespaces

ROOT = os.path.join(os.path.expanduser("~"), ".spanveil", "namespaces")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanveil")
    top.add_argument("--root", default=ROOT, help="folder of the namespaces")
    does = top.add_subparsers(dest="command", required=True)
    for name in ("redact", "reveal"):
        one = does.add_parser(name)
        one.add_argument("paths", nargs="+", help="files and folders" + (", or - for a text on standard input" if name == "reveal" else ""))
        one.add_argument("--namespace", required=name == "reveal")
        one.add_argument("--output-dir", required=name == "redact")
        if name == "redact":
            one.add_argument("--least", type=float, default=0.5, help="lowest score that counts")
    look = does.add_parser("lookup")
    look.add_argument("token")
    look.add_argument("--namespace", required=True)
    ns = does.add_parser("ns").add_subparsers(dest="action", required=True)
    ns.add_parser("list")
    for name in ("show", "summary", "delete"):
        one = ns.add_parser(name)
        one.add_argument("namespace")
        if name == "show":
            one.add_argument("--unsafe", action="store_true", help="print originals")
    return top


def guarded(folder: str, name: str, root: str) -> Path:
    """Where a file goes: in the folder, and never among the namespaces."""
    at, inside, kept = (Path(folder) / Path(name).name).resolve(), Path(folder).resolve(), Path(root).resolve()
    if inside not in at.parents:
        raise SystemExit(f"outside of {inside}: {at}")
    if kept in at.parents:
        raise SystemExit(f"among the namespaces: {at}")
    return at


def _write(rows, folder: str, root: str, name) -> int:
    written = 0
    for r in rows.toLocalIterator():
        data = r.output if r.output is not None else (r.redacted or "").encode() if "redacted" in rows.columns and r.redacted is not None else None
        if data is None:
            print(f"{r.path}: {r.problem or 'not supported'}", file=sys.stderr)
            continue
        at = guarded(folder, name(r), root)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes(data))
        written += 1
        print(at)
    return written


def run(spark: SparkSession, arguments: list[str] | None = None) -> int:
    """Exit code: 0 done; 1 nothing came of it; 2 not allowed without --unsafe."""
    args = parser().parse_args(arguments)
    if args.command == "ns":
        if args.action == "list":
            print(*namespaces(spark, args.root), sep="\n")
            return 0
        one = Namespace(spark, args.root, args.namespace)
        if args.action == "delete":
            return 0 if one.delete() else 1
        if args.action == "show" and not args.unsafe:
            print("show prints originals; pass --unsafe to allow that", file=sys.stderr)
            return 2
        session = RedactionSession(spark, args.namespace, args.root)
        if args.action == "summary":
            for r in session.summary().orderBy("label").toLocalIterator():
                print(f"{r.label}={r.entities}")
        elif session.mapping is not None:
            for r in session.mapping.orderBy("label", "n").toLocalIterator():
                print(f"{r.pseudonym}\t{r.original}")
        return 0
    session = RedactionSession(spark, args.namespace, args.root, **({"least": args.least} if args.command == "redact" else {}))
    if args.command == "lookup":
        found = session.lookup(args.token)
        print(found if found is not None else "not known", file=sys.stdout if found is not None else sys.stderr)
        return 0 if found is not None else 1
    if args.command == "reveal" and args.paths == ["-"]:
        text = spark.createDataFrame([(0, sys.stdin.read())], "doc_id long, text string")
        print(session.revealed(text).first().revealed, end="")
        return 0
    if args.output_dir is None:
        print("an output folder is needed for files", file=sys.stderr)
        return 1
    files = read_files(spark, args.paths)
    if args.command == "redact":
        done = session.redacted_files(files)
        rows, name = done.selectExpr("path", "output", "redacted", "output_name", "extraction_error AS problem"), lambda r: r.output_name
    else:
        rows, name = session.revealed_files(files).selectExpr("path", "output", "reason AS problem"), lambda r: r.path
    return 0 if _write(rows, args.output_dir, args.root, name) else 1


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("spanveil").getOrCreate()))


if __name__ == "__main__":
    main()
