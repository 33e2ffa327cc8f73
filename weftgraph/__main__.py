"""Command line: index a tree, ask for a context pack, review the edits of a reply."""

from __future__ import annotations

import argparse
import json
import sys

from weftgraph.api import DEFAULT_BUDGET, Repository
from weftgraph.session import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the snapshots, which all executors see")
    parser.add_argument("--master", help="Spark's master, if the cluster does not set it")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="scan, parse and index a tree")
    index.add_argument("tree")
    context = commands.add_parser("context", help="the pack for a question")
    context.add_argument("question")
    context.add_argument("--budget", type=int, default=DEFAULT_BUDGET)
    propose = commands.add_parser("propose", help="review the edits in a model's reply, read from standard input")
    propose.add_argument("--reply", help="a file instead of standard input")
    own = parser.parse_args(arguments)
    repo = Repository(session(own.master), own.store)
    if own.command == "index":
        print(json.dumps(repo.index(own.tree)))
        return 0
    if own.command == "context":
        rows = repo.context([own.question], own.budget)
    else:
        reply = open(own.reply, encoding="utf-8").read() if own.reply else sys.stdin.read()
        rows = repo.propose(reply)
    for row in rows.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
