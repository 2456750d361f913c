"""The calls that an agent makes, as JSON-RPC lines on standard input and output."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from .api import KnowledgeBase, RequestError

_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
TOOLS = {
    "kb_search": ("Search the knowledge base.", {"query": _TEXT, "layer": _TEXT, "kind": _TEXT, "limit": {"type": "integer"}}, ["query"]),
    "kb_page": ("Read pages by id.", {"ids": {"type": "array", "items": _TEXT}, "full": _FLAG}, ["ids"]),
    "kb_add": ("Add a document.", {"filename": _TEXT, "content": _TEXT, "source_url": _TEXT, "overwrite": _FLAG}, ["filename", "content"]),
}


def described() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


def call(kb: KnowledgeBase, name: str, a: dict) -> object:
    if name not in TOOLS:
        raise RequestError(f"no tool {name}")
    if missing := [k for k in TOOLS[name][2] if a.get(k) in (None, "")]:
        raise RequestError(f"missing: {', '.join(missing)}")
    if name == "kb_search":
        return kb.search(a["query"], a.get("layer"), a.get("kind"), int(a.get("limit") or 10))
    if name == "kb_page":
        return kb.page(list(a["ids"]), bool(a.get("full")))
    return {"path": kb.add(a["filename"], a["content"], a.get("source_url") or "", bool(a.get("overwrite")))}


def serve(kb: KnowledgeBase, lines: IO[str], out: Callable[[str], object]) -> None:
    """One answer per request line; what can't be read is answered with an error; notifications (no id) get no answer."""
    for line in lines:
        if not line.strip():
            continue
        answer: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(line)
            answer["id"] = request.get("id")
            method, params = request.get("method"), request.get("params") or {}
            if method == "initialize":
                answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lorekeep", "version": "1"}}
            elif method == "tools/list":
                answer["result"] = {"tools": described()}
            elif method == "tools/call":
                try:
                    text, failed = json.dumps(call(kb, params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False, default=str), False
                except RequestError as e:
                    text, failed = str(e), True
                answer["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
            elif answer["id"] is None:
                continue
            else:
                answer["error"] = {"code": -32601, "message": f"no method {method}"}
        except Exception as e:  # noqa: BLE001 - the loop goes on
            answer["error"] = {"code": -32603, "message": str(e)}
        out(json.dumps(answer, ensure_ascii=False) + "\n")
