"""The session's operations as tools over standard input and output: JSON-RPC 2.0,
one message a line, in the model context protocol's public form."""

from __future__ import annotations

import inspect
import json
import types
from typing import IO, Any, Union, get_args, get_origin, get_type_hints

from tidewater.session import Session

# Protocol version and error codes.
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602

NAMES = {str: "string", int: "integer", bool: "boolean", float: "number"}


class ProtocolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _schema(hint: Any) -> dict:
    if get_origin(hint) in (Union, types.UnionType):
        return _schema(next(a for a in get_args(hint) if a is not type(None)))
    if get_origin(hint) is list:
        return {"type": "array", "items": _schema(get_args(hint)[0])}
    return {"type": NAMES[hint]}


def tool(name: str) -> dict:
    """Name, description and input schema, from the operation's signature."""
    operation = getattr(Session, name)
    hints = get_type_hints(operation)
    given = list(inspect.signature(operation).parameters.values())[1:]
    schema = {"type": "object", "properties": {p.name: _schema(hints[p.name]) for p in given}}
    if required := [p.name for p in given if p.default is inspect.Parameter.empty]:
        schema["required"] = required
    return {"name": name, "description": inspect.getdoc(operation), "inputSchema": schema}


def _run_tool(session: Session, params: dict) -> dict:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in Session.OPERATIONS or not isinstance(arguments, dict):
        raise ProtocolError(INVALID_PARAMS, f"unknown tool or bad arguments: {name!r}")
    try:
        # through JSON, so dates and the like are plain in both forms
        text = json.dumps(session.call(name, arguments), default=str)
    except Exception as e:  # noqa: BLE001 - a failure of a tool is its answer
        return {"content": [{"type": "text", "text": f"{e}"[:500] or type(e).__name__}], "isError": True}
    return {"content": [{"type": "text", "text": text}], "structuredContent": json.loads(text), "isError": False}


def answer(session: Session, request: Any) -> dict | None:
    """The response to one message, none to a notification."""
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
    if "id" not in request:
        return None
    method, params = request["method"], request.get("params") or {}
    try:
        if not isinstance(params, dict):
            raise ProtocolError(INVALID_PARAMS, "params must be an object")
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tidewater", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [tool(name) for name in Session.OPERATIONS]}
        elif method == "tools/call":
            result = _run_tool(session, params)
        else:
            raise ProtocolError(NO_METHOD, f"unknown method {method!r}")
    except ProtocolError as e:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": e.code, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def serve_stdio(session: Session, source: IO[str], sink: IO[str]) -> None:
    """Answer the messages of *source* until it ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            response = answer(session, json.loads(line))
        except json.JSONDecodeError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
        if response is not None:
            sink.write(json.dumps(response) + "\n")
            sink.flush()
