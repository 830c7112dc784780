"""Syntax facts of Python sources: declarations, calls, references and imports.

One text gives rows of several kinds; ``extract`` returns them in one table (kind tells
them apart) so that a text is parsed once. A text that is not Python gives one row of
kind ``error``.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, name string, qualified string, owner string, detail string, line int, end_line int, n int"


class _Facts(ast.NodeVisitor):
    def __init__(self) -> None:
        self.scope: list[str] = []
        self.rows: list[tuple] = []

    def add(self, kind: str, name: str, node: ast.AST, detail: str = "", n: int = 0) -> None:
        owner = ".".join(self.scope) or "<module>"
        self.rows.append((kind, name, ".".join([*self.scope, name]), owner, detail, node.lineno, node.end_lineno or node.lineno, n))

    def _inside(self, node: ast.AST, name: str, body: list[ast.AST]) -> None:
        self.scope.append(name)
        for child in body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node, ",".join(ast.unparse(b) for b in node.bases), len(node.bases))
        for child in [*node.decorator_list, *node.bases]:
            self.visit(child)
        self._inside(node, node.name, node.body)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, execution: str) -> None:
        args = [a.arg for a in [*node.args.posonlyargs, *node.args.args]]
        yields = any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node))
        self.add("function", node.name, node, ("generator" if yields and execution == "ordinary" else execution) + ":" + ",".join(args), len(args))
        for child in [*node.decorator_list, *node.args.defaults]:
            self.visit(child)
        self._inside(node, node.name, node.body)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, "ordinary")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, "coroutine")

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.add("function", "<lambda>", node, "ordinary:" + ",".join(a.arg for a in node.args.args), len(node.args.args))
        self._inside(node, "<lambda>", [node.body])

    def visit_Call(self, node: ast.Call) -> None:
        self.add("call", ast.unparse(node.func).split(".")[-1], node, ast.unparse(node.func), len(node.args) + len(node.keywords))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node, "." * node.level + (node.module or "") + ":" + a.name)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name):
                constant = isinstance(node.value, ast.Constant)
                self.add("data" if not self.scope else "assignment", target.id, node, repr(node.value.value) if constant else "")
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("reference", node.id, node)


def facts(text: str) -> list[tuple]:
    visitor = _Facts()
    visitor.visit(ast.parse(text))
    return visitor.rows


def extract(files: DataFrame) -> DataFrame:
    """Fact rows of ``files`` (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows += [(path, *r) for r in facts(text or "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "error", type(e).__name__, "", "", "", 0, 0, 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInPandas(run, SCHEMA)
