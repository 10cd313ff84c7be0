"""Symbols and imports of Python sources, parsed as data and never run."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.ship import ship

SYMBOLS = "path string, kind string, name string, line long, module string, level long, type_checking boolean"


def _rows(path: str, source: str):
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        yield path, "PARSE_ERROR", None, 0, None, 0, False
        return
    todo = [(n, False, "") for n in tree.body]
    while todo:
        node, guarded, owner = todo.pop(0)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield path, "METHOD" if owner else "FUNCTION", owner + node.name, node.lineno, None, 0, guarded
        elif isinstance(node, ast.ClassDef):
            yield path, "CLASS", owner + node.name, node.lineno, None, 0, guarded
            todo += [(n, guarded, f"{owner}{node.name}.") for n in node.body]
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield path, "IMPORT", a.asname or a.name, node.lineno, a.name, 0, guarded
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield path, "IMPORT", a.asname or a.name, node.lineno, ".".join(filter(None, (node.module, a.name))), node.level, guarded
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and not owner:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    yield path, "CONSTANT" if t.id.isupper() else "VARIABLE", t.id, node.lineno, None, 0, guarded
        elif isinstance(node, ast.If):
            typed = guarded or "TYPE_CHECKING" in ast.dump(node.test)
            todo += [(n, typed, owner) for n in node.body] + [(n, guarded, owner) for n in node.orelse]
        elif isinstance(node, ast.Try):
            todo += [(n, guarded, owner) for n in node.body + [x for h in node.handlers for x in h.body]]


def symbols(files: DataFrame) -> DataFrame:
    """Definitions and imports of ``files`` (path, text); function bodies are not entered."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"]) for r in _rows(p, t or "")], columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("path", "text").mapInPandas(run, SYMBOLS)


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """Imports resolved to files: of the candidate paths in order, the first that exists."""
    i = found.where(F.col("kind") == "IMPORT")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    up = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("level"), F.lit(1)).cast("int")), folder, lambda acc, k: F.when(k < 2, acc).otherwise(F.regexp_replace(acc, r"[^/]+/$", "")))
    base = F.when(F.col("level") > 0, up).otherwise("")
    dotted = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    parent = F.regexp_replace(dotted, r"/?[^/]+$", "")
    candidates = F.array(F.concat(base, dotted, F.lit(".py")), F.concat(base, dotted, F.lit("/__init__.py")), F.concat(base, parent, F.lit(".py")), F.concat(base, parent, F.lit("/__init__.py")))
    tried = i.select(F.col("path").alias("src"), "line", "module", "type_checking", F.posexplode(candidates).alias("pos", "target"))
    hit = tried.join(files.select(F.col("path").alias("target")).distinct(), "target")
    first = hit.groupBy("src", "line", "module").agg(F.min_by("target", "pos").alias("dst"), F.first("type_checking").alias("type_checking"))
    return first.select("src", "dst", F.when(F.col("type_checking"), "TYPE_CHECKING").otherwise("RUNTIME").alias("edge"), "module")
