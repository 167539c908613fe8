"""The command line: ``python -m engramlake --root FOLDER status | search QUERY | migrate FOLDER``."""

from __future__ import annotations

import argparse

from .client import Client, title_of
from .model import LIMIT, TIERS
from .session import session
from .sources import corpus


def main(arguments: list[str] | None = None, client: Client | None = None) -> list[str]:
    """Prints and returns the lines of the answer."""
    p = argparse.ArgumentParser(prog="engramlake")
    p.add_argument("--root", required=client is None, help="folder of the log and the documents")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("status")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=5, choices=range(LIMIT[0], LIMIT[1] + 1), metavar="N")
    find.add_argument("--tier", action="append", choices=list(TIERS))
    load = commands.add_parser("migrate")
    load.add_argument("source", help="folder of daily logs (dated Markdown files)")
    a = p.parse_args(arguments)
    client = client or Client(session(), a.root)
    if a.command == "status":
        health = client.health()
        out = [f"status: {health['status']}", f"entries: {health['total']} ({', '.join(f'{k}={v}' for k, v in sorted(health['tiers'].items()))})"]
    elif a.command == "search":
        found = client.search(a.query, a.tier, a.limit)
        rows = [(str(i + 1), hit["tier"], f"{hit['score']:.4f}", title_of(hit["entry"])) for i, hit in enumerate(found["results"])]
        out = ["  ".join(x.ljust(w) for x, w in zip(r, (4, 10, 8, 0), strict=True)).rstrip() for r in [("rank", "tier", "score", "title"), *rows]]
    else:
        out = [f"{client.migrate_logs(corpus.dated_logs(client.spark, a.source)).count()} entries migrated"]
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
