"""A symbol provider for Python sources: the rows of :data:`refweave.schema.PROVIDER_SYMBOLS` by the ``ast`` module."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.schema import PROVIDER_SYMBOLS

_COLS = [f.name for f in PROVIDER_SYMBOLS.fields]
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROVIDER_SYMBOLS.fields) + ", error string"


def outline(text: str) -> list[tuple]:
    """Rows of PROVIDER_SYMBOLS, without the path, of classes, functions and methods. Lines and characters count from 0,
    characters in UTF-16 units; the selection is where the name begins."""
    rows: list[tuple] = []
    lines = text.splitlines(keepends=True)

    def units(line: int, column: int) -> int:
        """The place of a column, which counts bytes."""
        return len(lines[line - 1].encode()[:column].decode(errors="ignore").encode("utf-16-le")) // 2 if line <= len(lines) else column

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        k = 0
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                key = f"{parent}.{k}" if parent else str(k)
                kind = 4 if isinstance(child, ast.ClassDef) else 5 if in_class else 11
                start = units(child.lineno, child.col_offset)
                word = {ast.ClassDef: "class ", ast.FunctionDef: "def ", ast.AsyncFunctionDef: "async def "}[type(child)]
                rows.append((key, parent, k, child.name, kind, child.lineno - 1, start, child.end_lineno - 1, units(child.end_lineno, child.end_col_offset), child.lineno - 1, start + len(word)))
                k += 1
                visit(child, key, isinstance(child, ast.ClassDef))

    visit(ast.parse(text), None, False)
    return rows


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["file_text"]):
                try:
                    out += [(path, *r, None) for r in outline(text or "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, "", *[None] * (len(_COLS) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*_COLS, "error"]).astype({c: "Int32" for c in ("ordinal", "kind", *_COLS[-6:])})

    return files.select("path", "file_text").mapInPandas(run, _ROWS)


def provider_symbols(files: DataFrame) -> DataFrame:
    """files: (path, file_text). A null text has no symbols, nor has a file that can't be parsed: that is told by
    :func:`provider_errors` and doesn't end the run."""
    return _parsed(files).where(F.col("error").isNull()).drop("error")


def provider_errors(files: DataFrame) -> DataFrame:
    """(path, error): one row for each of :func:`provider_symbols`' files that can't be parsed."""
    return _parsed(files).where(F.col("error").isNotNull()).select("path", "error")
