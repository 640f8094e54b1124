"""Command line: ingest a period, materialize files, build an index, rank activity, ask a question, clear a cache."""

from __future__ import annotations

import argparse
import importlib
import json
import shutil
import sys
from collections.abc import Sequence
from datetime import date
from pathlib import Path
from typing import Any


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkledger")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("materialize", help="build and publish a set from projected files")
    m.add_argument("files", nargs="+")
    m.add_argument("--root", required=True)
    m.add_argument("--allow-rejects", action="store_true")
    i = sub.add_parser("index", help="build the semantic index of the current set")
    i.add_argument("--root", required=True)
    i.add_argument("--dim", type=int, default=384)
    i.add_argument("--force", action="store_true")
    a = sub.add_parser("activity", help="rank obligations in a window")
    a.add_argument("--root", required=True)
    a.add_argument("--from", dest="start", type=date.fromisoformat, required=True)
    a.add_argument("--to", dest="end", type=date.fromisoformat, required=True)
    a.add_argument("--by", choices=("award", "recipient"), default="award")
    a.add_argument("--limit", type=int, default=10)
    g = sub.add_parser("ingest", help="download a period, then build and publish a set of it")
    g.add_argument("--root", required=True)
    g.add_argument("--from", dest="start", type=date.fromisoformat, required=True)
    g.add_argument("--to", dest="end", type=date.fromisoformat, required=True)
    g.add_argument("--service", required=True, help="module:function that gives the download service")
    g.add_argument("--no-load", action="store_true", help="download only")
    g.add_argument("--allow-rejects", action="store_true")
    q = sub.add_parser("ask", help="answer a question with a model that uses the evidence tools")
    q.add_argument("question")
    q.add_argument("--root", required=True)
    q.add_argument("--model", required=True, help="module:function that gives the model")
    q.add_argument("--rounds", type=int, default=6)
    q.add_argument("--calls", type=int, default=12)
    q.add_argument("--dim", type=int, help="search the index of this dimension")
    c = sub.add_parser("clear-test-cache", help="remove cached details of awards and vehicles")
    c.add_argument("--root", required=True)
    return p


def plugged(name: str) -> Any:
    """What a function named module:function gives."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name} is not module:function")
    try:
        return getattr(importlib.import_module(module), function)()
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{name}: {e}") from e


def clear_cache(root: str) -> int:
    """How many cached documents there were; published sets stay."""
    folder = Path(root) / "enrichment"
    n = sum(1 for _ in folder.rglob("*.json"))
    shutil.rmtree(folder, ignore_errors=True)
    return n


def main(argv: Sequence[str] | None = None) -> int:
    """0 when done, 1 when the set was built but not published, 2 for what can't be done."""
    args = parser().parse_args(argv)
    if args.command == "clear-test-cache":
        print(json.dumps({"removed": clear_cache(args.root)}))
        return 0
    from pyspark.sql import SparkSession

    from sparkledger.operators.semantic import hashed_embedder
    from sparkledger.plans.dataset import ProcurementSession
    from sparkledger.plans.materialize import materialize
    from sparkledger.plans.semantic_index import build_index

    spark = SparkSession.builder.appName("sparkledger").getOrCreate()
    try:
        if args.command == "materialize":
            done = materialize(spark, args.files, args.root, args.allow_rejects)
            print(json.dumps({"run_id": done.run_id, "valid": done.valid, "rejected": done.invalid + done.collision, "published": done.published}))
            return 0 if done.published else 1
        if args.command == "ingest":
            from sparkledger.plans.ingest import ingest

            done = ingest(spark, plugged(args.service), args.start, args.end, args.root, load=not args.no_load, allow_rejects=args.allow_rejects)
            print(json.dumps({"run_id": done.run_id if done else None, "published": bool(done and done.published)}))
            return 0 if done is None or done.published else 1
        with ProcurementSession.open(spark, args.root) as session:
            if args.command == "ask":
                from sparkledger.plans.dialogue import Dialogue
                from sparkledger.plans.evidence import EvidenceSession
                from sparkledger.plans.semantic_index import SemanticIndex

                index = SemanticIndex.open(session, hashed_embedder(args.dim), args.dim, "word-hash") if args.dim else None
                talk = Dialogue(EvidenceSession(session, index), plugged(args.model), args.rounds, args.calls)
                said = talk.ask(args.question)
                print(json.dumps(said.as_dict(), default=str))
                talk.model.close()
                return 0 if said.ended != "error" else 1
            if args.command == "index":
                print(json.dumps({"documents": build_index(session, hashed_embedder(args.dim), args.dim, "word-hash", force=args.force).documents}))
            else:
                for r in session.activity(session.resolve(), args.start, args.end, args.by, args.limit).toLocalIterator():
                    print(json.dumps(r.asDict(), default=str))
        return 0
    except (RuntimeError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
