"""The one tool a server offers: its schema, its call, and answers to lines of JSON-RPC or of plain calls."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from .operators.search import DEFAULT_K, MAX_K, error, search_knowledge

TOOL = {
    "name": "search_knowledge",
    "description": "Find the passages of the corpus nearest to a query, each with source, heading and chunk index.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "description": "What to look for, in plain language."},
            "k": {"type": "number", "description": f"How many passages, 1 to {MAX_K} (default {DEFAULT_K})."},
        },
        "required": ["query"],
    },
}


class ToolServer:
    """Opens the store on the first call, or on warm_up, and answers every call with JSON text."""

    def __init__(self, open_: Callable[[], tuple[Any, str]]):
        self._open, self._ready = open_, None

    def _state(self) -> tuple[Any, str]:
        if self._ready is None:
            self._ready = self._open()
        return self._ready

    def warm_up(self) -> bool:
        """Open the store ahead of the first call; a failure is left for the call to report."""
        try:
            self._state()
        except Exception:  # noqa: BLE001
            return False
        return True

    def list_tools(self) -> list[dict]:
        return [TOOL]

    def call_tool(self, name: str, arguments: dict | None) -> str:
        if name != TOOL["name"]:
            return json.dumps(error("unknown_tool", f"there is no tool {name!r}"))
        arguments = arguments or {}
        try:
            store, root = self._state()
        except Exception as e:  # noqa: BLE001
            return json.dumps(error("config_error", str(e)))
        return json.dumps(search_knowledge(arguments.get("query", ""), arguments.get("k", DEFAULT_K), store=store, corpus_root=root))


# Fixed value: the protocol version answered to a client that names none.
PROTOCOL = "2025-06-18"


def respond(server: ToolServer, message: object) -> dict | str | None:
    """The answer to one message: of JSON-RPC an object, or None to a notification; to a plain call its JSON text.

    A tool's errors are results like others; errors of the protocol are invalid requests and unknown methods.
    """
    if not isinstance(message, dict) or "jsonrpc" not in message:
        call = message if isinstance(message, dict) else {}
        arguments = call.get("arguments")
        return server.call_tool(call.get("name"), arguments if isinstance(arguments, dict) else {})
    if "id" not in message:
        return None
    params = message.get("params") if isinstance(message.get("params"), dict) else {}
    head = {"jsonrpc": "2.0", "id": message["id"]}
    method = message.get("method")
    if method == "initialize":
        return head | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusloom", "version": "1"}}}
    if method == "ping":
        return head | {"result": {}}
    if method == "tools/list":
        return head | {"result": {"tools": server.list_tools()}}
    if method == "tools/call":
        arguments = params.get("arguments")
        text = server.call_tool(params.get("name"), arguments if isinstance(arguments, dict) else {})
        return head | {"result": {"content": [{"type": "text", "text": text}], "isError": False}}
    return head | {"error": {"code": -32601, "message": f"there is no method {method!r}"}}


def serve(server: ToolServer, lines: Iterable[str], write: Callable[[str], None], workers: int = 4) -> None:
    """Answer each line as a message. Calls run in worker threads, so that a slow one keeps no other waiting; JSON-RPC
    answers carry their id and may come in another order. Plain calls carry none and are answered in turn."""
    mutex = threading.Lock()

    def answer(message: object) -> None:
        out = respond(server, message)
        if out is not None:
            with mutex:
                write(out if isinstance(out, str) else json.dumps(out))

    with ThreadPoolExecutor(workers) as pool:
        for line in lines:
            try:
                message = json.loads(line)
            except ValueError:
                message = None
            if isinstance(message, dict) and message.get("method") == "tools/call":
                pool.submit(answer, message)
            else:
                answer(message)
