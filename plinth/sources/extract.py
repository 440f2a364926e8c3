"""What source texts declare and import, by one pattern for each language; Python by its own grammar.

Patterns see less than a grammar does: names inside strings and comments aren't told apart,
and types of receivers aren't followed.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import language_of

_SCRIPT = r"(?m)(?:^|[;\s])(?:import|export)\b[^'\";]*?from\s*['\"]([^'\"]+)['\"]|(?:^|\s)import\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"
IMPORTS = {
    "typescript": _SCRIPT, "javascript": _SCRIPT, "vue": _SCRIPT, "svelte": _SCRIPT,
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"(?m)^\s*import\s+([\w.]+)", "csharp": r"(?m)^\s*(?:global\s+)?using\s+([\w.]+)\s*;",
    "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\s]+)\"\s*$", "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "php": r"(?m)^\s*use\s+([\w\\]+)",
    "cpp": r"(?m)^\s*#\s*include\s*([<\"][^>\"]+[>\"])", "razor": r"(?m)^\s*@(?:using|model|inherits)\s+([\w.]+)",
}
DECLARATIONS = {
    "typescript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|type|function|enum)\s+(\w+)", "javascript": r"(?m)^(?:export\s+)?(?:default\s+)?(class|function)\s+(\w+)",
    "java": r"(?m)^\s*(?:public\s+|final\s+|abstract\s+)*(class|interface|record|enum)\s+(\w+)", "csharp": r"(?m)^\s*(?:public\s+|internal\s+|sealed\s+|abstract\s+|partial\s+|static\s+)*(class|interface|record|struct|enum)\s+(\w+)",
    "kotlin": r"(?m)^(?:data\s+|open\s+|abstract\s+)*(class|interface|object|fun)\s+(\w+)", "go": r"(?m)^(type|func)\s+(\w+)", "rust": r"(?m)^(?:pub\s+)?(struct|enum|trait|fn|union|type)\s+(\w+)",
    "php": r"(?m)^(?:abstract\s+|final\s+)?(class|interface|trait|enum|function)\s+(\w+)", "cpp": r"(?m)^(class|struct|enum|union)\s+(\w+)\s*[:{]",
}
#: Kinds of nodes that the words of declarations mean.
KINDS = {"class": "class", "record": "class", "struct": "class", "union": "class", "object": "class", "interface": "interface", "trait": "interface", "function": "function", "func": "function", "fun": "function", "fn": "function", "type": "type", "enum": "type"}


def _listed(n: int):
    return lambda x: F.array(*[x.getField(f"g{k}") for k in range(n)])


def _each(files: DataFrame, patterns: dict[str, str], n: int) -> DataFrame:
    rows = files.withColumn("language", language_of(F.col("path")))
    found = F.lit(None).cast("array<array<string>>")
    for name, p in patterns.items():
        groups = [F.regexp_extract_all("text", F.lit(p), F.lit(k + 1)) for k in range(n(name) if callable(n) else n)]
        named = [g.alias(f"g{k}") for k, g in enumerate(groups)]
        each = F.transform(F.arrays_zip(*named), _listed(len(groups)))
        found = F.when(F.col("language") == name, each).otherwise(found)
    return rows.select("path", "language", F.posexplode(found).alias("ord", "m"))


def imports(files: DataFrame) -> DataFrame:
    """(file, ord, specifier) of files (path, text), in the order of the text; the first of each specifier."""
    rows = _each(files, IMPORTS, lambda name: 3 if IMPORTS[name] is _SCRIPT else 1)
    said = F.get(F.filter("m", lambda x: x != ""), F.lit(0))
    return rows.select(F.col("path").alias("file"), "ord", said.alias("specifier")).where("specifier is not null").groupBy("file", "specifier").agg(F.min("ord").alias("ord")).select("file", "ord", "specifier")


def declarations(files: DataFrame) -> DataFrame:
    """(file, ord, name, kind, owner) of top-level declarations."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = _each(files, DECLARATIONS, 2)
    return rows.select(F.col("path").alias("file"), "ord", F.get("m", F.lit(1)).alias("name"), F.try_element_at(kinds, F.get("m", F.lit(0))).alias("kind"), F.lit(None).cast("string").alias("owner"))


_PYTHON = "file string, what string, ord int, name string, kind string, owner string, line int, error boolean"


def _python_rows(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [(path, "error", 0, None, None, None, None, True)]
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append((path, "symbol", len(out), node.name, "class", None, node.lineno, None))
            out += [(path, "extends", len(out) + k, ast.unparse(b), None, node.name, node.lineno, None) for k, b in enumerate(node.bases)]
            for m in node.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    out.append((path, "symbol", len(out), m.name, "method", node.name, m.lineno, None))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((path, "symbol", len(out), node.name, "function", None, node.lineno, None))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(path, "import", len(out) + k, a.name, None, None, node.lineno, None) for k, a in enumerate(node.names)]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, "import", len(out) + k, f"{'.' * node.level}{node.module or ''}#{a.name}", None, None, node.lineno, None) for k, a in enumerate(node.names)]
    return out


def python_rows(files: DataFrame) -> DataFrame:
    """(file, what, ord, name, kind, owner, line, error): symbols, bases and imports of Python files; a file that doesn't parse gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in _python_rows(path, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PYTHON.split(", ")])

    return files.where(language_of(F.col("path")) == "python").select("path", "text").mapInPandas(run, _PYTHON)


def links(pages: DataFrame, text: str = "html") -> DataFrame:
    """The addresses that markup links to, as often as it does."""
    return pages.select("*", F.explode(F.regexp_extract_all(text, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
