"""python -m corpusloom: answer tool calls on standard input, one JSON object a line (JSON-RPC or plain)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .config import Config
from .server import ToolServer, serve


def main() -> int:
    try:
        config = Config.from_env()
    except ValueError as e:
        print(f"configuration error: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    server = ToolServer(lambda: (config.open_store(spark), config.corpus_root))
    server.warm_up()
    serve(server, sys.stdin, lambda text: print(text, flush=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
