"""Control flow of Python functions: boxes and edges, one table of each, by the grammar's own nodes.

Statements in a row are one box; a decision has edges yes and no, a loop goes back to itself,
and jumps lead to the end, the loop, or what follows it. Inner functions are a step of their
own and counted as not drawn.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import language_of

LABEL = 80
Ends = list[tuple[int, str]]


class _Walk:
    """Boxes (kind, label, line, more) and edges of one function. Each walk takes and gives loose ends: (box, label)."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        self.boxes: list[tuple[str, str, int, int]] = [("start", function.name, function.lineno, 0), ("end", "", function.end_lineno or function.lineno, 0)]
        self.edges: list[tuple[int, int, str]] = []
        self.loops: list[tuple[int, Ends]] = []
        self.inner = 0
        self.tie(self.body(function.body, [(0, "")]), 1)

    def tie(self, ends: Ends, to: int) -> None:
        self.edges += [(a, to, label) for a, label in ends]

    def box(self, kind: str, node: ast.AST, text: str, ends: Ends, more: int = 0) -> int:
        self.boxes.append((kind, text.split("\n")[0][:LABEL], node.lineno, more))
        self.tie(ends, len(self.boxes) - 1)
        return len(self.boxes) - 1

    def body(self, statements: list[ast.stmt], ends: Ends) -> Ends:
        run: list[ast.stmt] = []
        for s in [*statements, None]:
            if s is not None and not isinstance(s, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.Match | ast.With | ast.AsyncWith | ast.Return | ast.Raise | ast.Break | ast.Continue):
                self.inner += isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
                run.append(s)
                continue
            if run and ends:
                ends = [(self.box("action", run[0], ast.unparse(run[0]), ends, len(run) - 1), "")]
            run = []
            if s is not None and ends:  # what nothing leads to isn't drawn
                ends = self.one(s, ends)
        return ends

    def one(self, s: ast.stmt, ends: Ends) -> Ends:
        match s:
            case ast.If():
                at = self.box("decision", s, ast.unparse(s.test), ends)
                return self.body(s.body, [(at, "yes")]) + (self.body(s.orelse, [(at, "no")]) if s.orelse else [(at, "no")])
            case ast.For() | ast.AsyncFor() | ast.While():
                head = ast.unparse(s.test) if isinstance(s, ast.While) else f"{ast.unparse(s.target)} in {ast.unparse(s.iter)}"
                at, out = self.box("loop", s, head, ends), []
                self.loops.append((at, out))
                self.tie(self.body(s.body, [(at, "yes")]), at)
                self.loops.pop()
                endless = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
                return ([] if endless else self.body(s.orelse, [(at, "no")])) + out
            case ast.Try():
                at = self.box("action", s, "try", ends)
                done = self.body(s.orelse, self.body(s.body, [(at, "")]))
                for h in s.handlers:
                    done += self.body(h.body, [(at, "catch")])
                return self.body(s.finalbody, done)
            case ast.Match():
                at, done = self.box("decision", s, ast.unparse(s.subject), ends), []
                for c in s.cases:
                    done += self.body(c.body, [(at, ast.unparse(c.pattern)[:LABEL])])
                every = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases)
                return done + ([] if every else [(at, "else")])
            case ast.With() | ast.AsyncWith():
                return self.body(s.body, [(self.box("action", s, ast.unparse(s), ends), "")])
            case ast.Break() | ast.Continue():
                if self.loops:
                    loop, out = self.loops[-1]
                    if isinstance(s, ast.Break):
                        out += ends
                    else:
                        self.tie(ends, loop)
                return []
        self.tie([(self.box("exit", s, ast.unparse(s), ends), "")], 1)
        return []


_DDL = "file string, function string, what string, a int, b int, kind string, label string, line int, more int"


def flows(files: DataFrame) -> DataFrame:
    """(file, function, what, a, b, kind, label, line, more) of files (path, text): 'box' rows (a: its number), 'edge' rows (a to b), and a 'not drawn' row where inner functions were left out (more: how many)."""

    def of(path: str, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        out = []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                w = _Walk(node)
                out += [(path, node.name, "box", i, None, kind, label, line, more) for i, (kind, label, line, more) in enumerate(w.boxes)]
                out += [(path, node.name, "edge", a, b, None, label, None, None) for a, b, label in w.edges]
                if w.inner:
                    out.append((path, node.name, "not drawn", None, None, None, "inner functions", node.lineno, w.inner))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in of(p, t or "")]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _DDL.split(", ")])
            yield frame.astype({c: "Int32" for c in ("a", "b", "line", "more")})

    return files.where(language_of(F.col("path")) == "python").select("path", "text").mapInPandas(run, _DDL)
