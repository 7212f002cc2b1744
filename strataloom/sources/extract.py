"""Symbols and edges of sources: Python by the standard parser, languages with braces by their own walk."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.sources import braces

SYMBOLS = "file_path string, language string, local_id int, parent int, name string, kind string, line_start int, line_end int, signature string, decorators string"
EDGES = "file_path string, language string, from_local int, to_name string, kind string, target_kind string, line int"


def parse(text: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of one file: symbols from 1 on, 0 is the module. A file that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    symbols: list[tuple] = [(0, None, "<module>", "module", 1, max(1, text.count("\n") + 1), None, None)]
    edges: list[tuple] = []

    def visit(node: ast.AST, owner: int, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at, inside = owner, in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                at = len(symbols)
                is_class = isinstance(child, ast.ClassDef)
                signature = None if is_class else f"({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                marks = "".join(f",{ast.unparse(d).split('(')[0]}" for d in child.decorator_list)
                symbols.append((at, owner, child.name, "class" if is_class else "method" if in_class else "function", child.lineno, child.end_lineno, signature, marks + "," if marks else None))
                inside = is_class
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    edges.append((owner, f.id, "calls", "function", child.lineno))
                elif isinstance(f, ast.Attribute):
                    edges.append((owner, f.attr, "calls", "method", child.lineno))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                edges.extend((owner, a.name.rpartition(".")[2], "imports", None, child.lineno) for a in child.names)
            visit(child, at, inside)

    visit(tree, 0, False)
    return symbols, edges


def rows_of(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of one file; a language without an extractor has none."""
    if language == "python":
        return parse(text)
    return braces.parse(text, language) if language in braces.LANGUAGES or language == "vue" else ([], [])


def _rows(files: DataFrame, which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    files = files if "language" in files.columns else files.withColumn("language", F.lit("python"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, g, *r) for p, t, g in zip(part["path"], part["text"], part["language"]) for r in rows_of(t or "", g)[which]]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names if c in ("local_id", "parent", "line_start", "line_end", "from_local", "line")})

    return files.select("path", "text", "language").mapInPandas(run, schema)


def extracted_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, text, language); identifiers are unique over all files by a hash of path and local number."""
    rows = _rows(files, 0, SYMBOLS)
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64("file_path", c))
    return rows.select(key("local_id").alias("id"), "name", "kind", "file_path", "line_start", "line_end", "signature", key("parent").alias("parent_id"), "decorators", "language")


def extracted_edges(files: DataFrame) -> DataFrame:
    """from_id, to_name, kind, line and target_kind of (path, text, language)."""
    rows = _rows(files, 1, EDGES)
    return rows.select(F.xxhash64("file_path", "from_local").alias("from_id"), "to_name", "kind", "line", "target_kind").distinct()


def python_symbols(files: DataFrame) -> DataFrame:
    """The same of Python files (path, text)."""
    return extracted_symbols(files.select("path", "text"))


def python_edges(files: DataFrame) -> DataFrame:
    return extracted_edges(files.select("path", "text"))
