"""Commands ingest and query. Exit code 3 says that another writer holds the store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .lock import LockHeld, WriterLock
from .operators.embed import _registry, embedder
from .operators.ingest import ingest
from .operators.search import DEFAULT_K, search_knowledge
from .operators.store import ChunkStore
from .sources.files import EXCLUDED


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("--collection", default="knowledge")
    p.add_argument("--embedder", default="hash", choices=sorted(_registry))
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="bring a store in line with a folder")
    i.add_argument("corpus_dir")
    i.add_argument("--db", required=True)
    i.add_argument("--exclude", action="append", default=[], metavar="PREFIX", help=f"path prefix to leave out, besides {', '.join(EXCLUDED)}")
    i.add_argument("--clean", action="store_true", help="delete the collection first, once the lock is held")
    i.add_argument("--full", action="store_true", help="embed all files again, whatever the manifest says")
    i.add_argument("--no-snapshot-dedupe", action="store_true", help="keep the repeats in dated series")
    i.add_argument("--quiet", action="store_true", help="report on one line")
    q = sub.add_parser("query", help="search a store")
    q.add_argument("text")
    q.add_argument("--db", required=True)
    q.add_argument("--corpus", required=True)
    q.add_argument("-k", type=int, default=DEFAULT_K)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    get = lambda: spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.command == "query":
        store = ChunkStore(get(), a.db, a.collection, embedder(a.embedder))
        print(json.dumps(search_knowledge(a.text, a.k, store=store, corpus_root=a.corpus), indent=2))
        return 0
    try:
        with WriterLock(a.db):
            session = get()
            if a.clean:
                from .operators.commit import Pointer

                Pointer(session, f"{a.db}/{a.collection}").delete()
            store = ChunkStore(session, a.db, a.collection, embedder(a.embedder))
            report = ingest(
                session, a.corpus_dir, store, exclude=EXCLUDED + tuple(a.exclude), incremental=not (a.full or a.clean), dedupe_snapshots=not a.no_snapshot_dedupe
            )
            summary = report.__dict__ | {"store_count": store.count()}
    except LockHeld as e:
        print(f"skipped: {e}", file=sys.stderr)
        return 3
    print(json.dumps(summary, indent=None if a.quiet else 2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
