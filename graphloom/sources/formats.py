"""Readers of configuration and contract texts, as functions for Arrow-batched use.

``parsed`` applies one of them to a text column; each returns JSON text, or null for a
text that is not of its format.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def jsonc(text: str) -> str:
    """JSON from JSON with comments and trailing commas."""
    return _TRAILING.sub(lambda m: m[1] or "", _JSONC.sub(lambda m: m[1] or "", text))


def toml(text: str) -> str:
    return json.dumps(tomllib.loads(text), default=str, sort_keys=True)


def ini(text: str) -> str:
    parser = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    parser.optionxform = str
    parser.read_string(text)
    return json.dumps({s: {k: v or "" for k, v in parser.items(s)} for s in parser.sections()}, sort_keys=True)


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return text


def yaml(text: str) -> str:
    """JSON from block YAML: mappings, lists and scalars by indentation; no anchors or flow maps."""
    rows = []
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if body.strip() and body.strip() != "---":
            rows.append((len(body) - len(body.lstrip()), body.strip()))

    def block(i: int, indent: int) -> tuple[object, int]:
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out: list = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1][:1] == "-":
                rest = rows[i][1][1:].strip()
                if not rest:
                    value, i = block(i + 1, rows[i + 1][0]) if i + 1 < len(rows) and rows[i + 1][0] > indent else (None, i + 1)
                elif re.match(r"[^\"'\[{]+?:(\s|$)", rest):
                    inner = indent + rows[i][1].index(rest)
                    rows[i] = (inner, rest)
                    value, i = block(i, inner)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            return out, i
        table: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            key, colon, rest = rows[i][1].partition(":")
            if not colon:
                raise ValueError(rows[i][1])
            if rest.strip():
                table[str(_scalar(key))], i = _scalar(rest), i + 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > indent or (rows[i + 1][0] == indent and rows[i + 1][1][:1] == "-")):
                table[str(_scalar(key))], i = block(i + 1, rows[i + 1][0])
            else:
                table[str(_scalar(key))], i = None, i + 1
        return table, i

    value, end = block(0, rows[0][0]) if rows else (None, 0)
    if end < len(rows):
        raise ValueError(rows[end][1])
    return json.dumps(value, sort_keys=True)


def proto(text: str) -> str:
    """Services of a .proto text: [{package, service, rpc, request, response}]."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", text)
    out = []
    for service in re.finditer(r"\bservice\s+(\w+)\s*\{", text):
        depth, end = 1, service.end()
        while depth and end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        for rpc in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)", text[service.end() : end]):
            out.append({"package": package[1] if package else "", "service": service[1], "rpc": rpc[1], "request": rpc[2], "response": rpc[3]})
    return json.dumps(out)


def graphql(text: str) -> str:
    """Root fields of a GraphQL schema: [{type, field}] with the canonical root type."""
    text = re.sub(r'"""(?:.|\n)*?"""|"[^"\n]*"|#[^\n]*', "", text)
    roots = {"Query": "Query", "Mutation": "Mutation", "Subscription": "Subscription"}
    for schema in re.finditer(r"\bschema\b[^{]*\{([^}]*)\}", text):
        for kind, name in re.findall(r"(query|mutation|subscription)\s*:\s*(\w+)", schema[1]):
            roots[name] = kind.capitalize()
    out = []
    for block in re.finditer(r"\b(?:extend\s+)?type\s+(\w+)[^{]*\{([^}]*)\}", text):
        if block[1] in roots:
            body = re.sub(r"\([^)]*\)", "", block[2])
            out += [{"type": roots[block[1]], "field": f} for f in re.findall(r"(\w+)\s*:", body)]
    return json.dumps(out)


# Methods of an OpenAPI path item.
METHODS = ["get", "post", "put", "delete", "patch", "head", "options", "trace"]


def openapi(text: str) -> str:
    """Operations of an OpenAPI or Swagger document (JSON or YAML): [{method, path, id}]."""
    doc = json.loads(text if text.lstrip()[:1] == "{" else yaml(text))
    servers = doc.get("servers") or [{}]
    base = doc.get("basePath") or re.sub(r"^[a-z]+://[^/]*", "", servers[0].get("url", ""))
    out = [{"method": m.upper(), "path": base.rstrip("/") + path, "id": op.get("operationId")} for path, item in (doc.get("paths") or {}).items() for m, op in item.items() if m in METHODS]
    return json.dumps(out, sort_keys=True)


READERS: dict[str, Callable[[str], str]] = {"jsonc": jsonc, "toml": toml, "ini": ini, "yaml": yaml, "proto": proto, "graphql": graphql, "openapi": openapi}


def parsed(text: Column, reader: str) -> Column:
    """JSON text of a column by one of READERS; null for null and for texts it can't read."""
    read = READERS[reader]

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else read(value)
        except (ValueError, KeyError, IndexError, AttributeError, TypeError, configparser.Error):
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(text)
