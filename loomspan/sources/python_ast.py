"""Python sources as rows: functions with their line, complexity and calls, from which call graphs are resolved."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, status string, functions array<struct<name:string,line:int,complexity:int,calls:array<struct<name:string,line:int>>>>"
_CALL = pa.struct([("name", pa.string()), ("line", pa.int32())])
_ARROW = pa.schema([("path", pa.string()), ("status", pa.string()), ("functions", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("complexity", pa.int32()), ("calls", pa.list_(_CALL))])))])
_BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def functions_of(text: str) -> list[dict]:
    """Each function (methods by Class.name) with one more than its branches, and the names that it calls; nested ones are their own."""
    out: list[dict] = []

    def measure(node: ast.AST) -> tuple[int, list[dict]]:
        branches, calls = 0, []
        todo = list(ast.iter_child_nodes(node))
        while todo:
            n = todo.pop(0)
            if isinstance(n, (*_DEFS, ast.ClassDef)):
                continue
            branches += isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0)
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append({"name": name, "line": n.lineno})
            todo += ast.iter_child_nodes(n)
        return branches + 1, sorted(calls, key=lambda c: (c["line"], c["name"]))

    def walk(node: ast.AST, prefix: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, _DEFS):
                complexity, calls = measure(n)
                out.append({"name": prefix + n.name, "line": n.lineno, "complexity": complexity, "calls": calls})
                walk(n, f"{prefix}{n.name}.")
            elif isinstance(n, ast.ClassDef):
                walk(n, f"{prefix}{n.name}.")
            else:
                walk(n, prefix)

    walk(ast.parse(text), "")
    return out


def parse(files: DataFrame) -> DataFrame:
    """A row for each file (path, text); a file that doesn't parse has the status "damaged: ..." and no functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    row = {"path": path, "status": "ok", "functions": functions_of(text or "")}
                except (SyntaxError, ValueError, RecursionError) as e:
                    row = {"path": path, "status": f"damaged: {type(e).__name__}", "functions": []}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def functions(parsed: DataFrame) -> DataFrame:
    """fkey ("path:name"), name (without its class), path, line, complexity."""
    f = parsed.select("path", F.explode("functions").alias("f"))
    return f.select(F.concat_ws(":", "path", "f.name").alias("fkey"), F.substring_index("f.name", ".", -1).alias("name"), "path", F.col("f.line").alias("line"), F.col("f.complexity").alias("complexity"))


def call_sites(parsed: DataFrame) -> DataFrame:
    """caller (fkey), callee (name), line."""
    f = parsed.select("path", F.explode("functions").alias("f")).select(F.concat_ws(":", "path", "f.name").alias("caller"), F.explode("f.calls").alias("c"))
    return f.select("caller", F.col("c.name").alias("callee"), F.col("c.line").alias("line"))
