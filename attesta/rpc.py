"""Line-based JSON-RPC facade and the registry of tools behind it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

TOOLS: dict[str, tuple[Callable, dict]] = {}


def tool(name: str, **properties: str):
    """Registers a function with the JSON types of its arguments."""

    def add(f: Callable) -> Callable:
        TOOLS[name] = (f, {"type": "object", "properties": {k: {"type": t} for k, t in properties.items()}})
        return f

    return add


def clamp(value, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def call(name: str, arguments: dict) -> dict:
    """Result of a tool, or ok=false with the reason."""
    try:
        if "topk" in arguments:
            arguments = arguments | {"topk": clamp(arguments["topk"], 1, 10)}
        return {"ok": True, "result": TOOLS[name][0](**arguments)}
    except Exception as e:  # noqa: BLE001 - the caller gets the reason
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}


def _reply(number, body: dict) -> str:
    return json.dumps({"id": number, "jsonrpc": "2.0"} | body)


def serve(lines: Iterable[str]) -> Iterator[str]:
    """Answers to requests, one per line; notifications get none."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            yield _reply(None, {"error": {"code": -32700, "message": "parse error"}})
            continue
        if "id" not in request:
            continue
        params = request.get("params") or {}
        if (method := request.get("method")) == "initialize":
            body = {"result": {"serverInfo": {"name": "attesta", "version": "1"}, "capabilities": {"tools": {}}}}
        elif method == "tools/list":
            body = {"result": {"tools": [{"name": n, "inputSchema": s} for n, (_, s) in sorted(TOOLS.items())]}}
        elif method == "tools/call" and params.get("name") in TOOLS:
            body = {"result": call(params["name"], params.get("arguments") or {})}
        else:
            body = {"error": {"code": -32601, "message": f"unknown method {method}"}}
        yield _reply(request["id"], body)
