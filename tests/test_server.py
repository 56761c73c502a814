from __future__ import annotations

import json
import threading

from corpusloom.server import TOOL, ToolServer, respond, serve


class Store:
    def count(self):
        return 0


def _server():
    return ToolServer(lambda: (Store(), "/srv/vault"))


def test_json_rpc():
    ask = lambda method, **params: respond(_server(), {"jsonrpc": "2.0", "id": 7, "method": method, "params": params})
    assert ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "x"
    assert ask("tools/list")["result"]["tools"] == [TOOL] and ask("ping")["result"] == {}
    called = ask("tools/call", name="search_knowledge", arguments={"query": "pump", "k": 2})
    assert called["id"] == 7 and called["result"]["isError"] is False
    assert json.loads(called["result"]["content"][0]["text"])["error"]["type"] == "empty_store"
    assert json.loads(ask("tools/call", name="other")["result"]["content"][0]["text"])["error"]["type"] == "unknown_tool"
    assert ask("other")["error"]["code"] == -32601
    assert respond(_server(), {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None


def test_plain_calls_and_broken_lines():
    out: list[str] = []
    serve(_server(), [json.dumps({"name": "search_knowledge", "arguments": {"query": ""}}), "no json", "7"], out.append)
    assert [json.loads(x)["error"]["type"] for x in out] == ["invalid_query", "unknown_tool", "unknown_tool"]


def test_a_slow_call_keeps_no_other_waiting():
    free = threading.Event()

    class Slow(Store):
        def count(self):
            assert free.wait(20)
            return 0

    out: list[str] = []

    def write(text):
        out.append(text)
        if json.loads(text)["id"] == 2:
            free.set()

    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search_knowledge", "arguments": {"query": "pump"}}}
    serve(ToolServer(lambda: (Slow(), "/srv/vault")), [json.dumps(call), json.dumps({"jsonrpc": "2.0", "id": 2, "method": "ping"})], write)
    assert [json.loads(x)["id"] for x in out] == [2, 1]
