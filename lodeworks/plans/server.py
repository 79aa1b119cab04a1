"""The tools of a tree over JSON-RPC lines on standard input and output, as model clients speak it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from .. import __version__
from .service import INSTRUCTIONS, Service

PROTOCOL = "2024-11-05"
_K = ("k", "integer", 6, "how many chunks, 1 to 15")
_SYMBOL = ("symbol", "string", None, "a name, or a qualified one such as Door.enter")
#: Tool: what it is for, and its parameters as (name, type, default, meaning); None: required.
TOOLS: dict[str, tuple[str, list[tuple]]] = {
    "search_code": ("Ranked code chunks of this tree for words or an identifier, each with path and lines. Cheaper than reading files.", [("query", "string", None, "what to look for"), _K]),
    "ask_codebase": ("What a question about this tree needs to be answered: the best chunks and the code they call. Answer from it and cite its lines.", [("question", "string", None, "the question"), _K]),
    "get_definition": ("Where a function, method or class is defined.", [_SYMBOL]),
    "impact_of_changes": (
        "What the present changes reach along calls, and which tests to run first. Only calls in the source are seen, so the tests are a beginning, not a proof.",
        [("rev", "string", "", "revision to compare with; empty: the last commit"), ("depth", "integer", 3, "calls to follow"), ("staged", "boolean", False, "staged changes only")],
    ),
    "analyze_impact": ("Everything that reaches a symbol along calls, and by which chain.", [_SYMBOL, ("depth", "integer", 3, "calls to follow")]),
    "find_tests": ("Which tests reach a symbol along calls, and by which chain.", [_SYMBOL, ("depth", "integer", 4, "calls to follow")]),
    "find_callers": ("Every place that calls a symbol.", [_SYMBOL]),
    "find_callees": ("What a symbol calls, inside the tree and outside.", [_SYMBOL]),
}
_PYTHON = {"string": str, "integer": int, "boolean": bool}


class Fault(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def listing() -> list[dict]:
    out = []
    for name, (text, parameters) in TOOLS.items():
        properties = {p: {"type": kind, "description": meaning} | ({} if default is None else {"default": default}) for p, kind, default, meaning in parameters}
        required = [p for p, _, default, _ in parameters if default is None]
        out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


def call(service: Service, name: str, given: dict) -> dict:
    """A tool's answer as text; what goes wrong inside is an answer, too, marked as an error."""
    if name not in TOOLS:
        raise Fault(-32602, f"no tool {name!r}")
    values = []
    for p, kind, default, _ in TOOLS[name][1]:
        value = given.get(p, default)
        if value is None or not isinstance(value, _PYTHON[kind]) or kind == "integer" and isinstance(value, bool):
            raise Fault(-32602, f"{name} needs {p} as {kind}")
        values.append(value)
    if unknown := given.keys() - {p for p, *_ in TOOLS[name][1]}:
        raise Fault(-32602, f"{name} has no {', '.join(sorted(unknown))}")
    try:
        text, failed = getattr(service, name)(*values), False
    except Exception as e:  # noqa: BLE001 - the client is told, the server lives on
        text, failed = f"{type(e).__name__}: {str(e)[:500]}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def _initialize(service: Service, params: dict) -> dict:
    asked = params.get("protocolVersion")
    return {
        "protocolVersion": asked if isinstance(asked, str) else PROTOCOL, "capabilities": {"tools": {}},
        "serverInfo": {"name": "lodeworks", "version": __version__}, "instructions": INSTRUCTIONS,
    }


METHODS: dict[str, Callable[[Service, dict], dict]] = {
    "initialize": _initialize,
    "ping": lambda service, params: {},
    "tools/list": lambda service, params: {"tools": listing()},
    "tools/call": lambda service, params: call(service, str(params.get("name")), params.get("arguments") or {}),
}


def reply(service: Service, line: str) -> dict | None:
    """What one line is answered with; None for notifications."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
    if "id" not in message:
        return None
    try:
        method = METHODS.get(message["method"])
        if method is None:
            raise Fault(-32601, f"no method {message['method']!r}")
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise Fault(-32602, "parameters are named")
        return {"jsonrpc": "2.0", "id": message["id"], "result": method(service, params)}
    except Fault as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}


def serve(service: Service, source: TextIO, out: TextIO) -> None:
    """Answer line by line until the source ends."""
    for line in source:
        if line.strip() and (answer := reply(service, line)) is not None:
            out.write(json.dumps(answer) + "\n")
            out.flush()
