"""Code graphs: symbols and edges from sources, callers and callees, blast radius, search."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "id string, name string, kind string, file_path string, line_start int, line_end int, language string, docstring string, signature string, parent string"
EDGES = "source string, target string, kind string"


def parse_python(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Symbols and edges of a Python file; a file that doesn't parse has none.

    Ids are ``file::Class.name``.  Calls go to the file's own symbols where a name
    is known, else to the bare name; imports, ``from`` imports and bases give edges.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    symbols: list[dict] = []
    edges: list[dict] = []
    calls: list[tuple[str, str]] = []

    def add(node, name: str, kind: str, parent: str | None) -> str:
        full = f"{parent.split('::', 1)[1]}.{name}" if parent else name
        sid = f"{path}::{full}"
        args = f"({', '.join(a.arg for a in node.args.args)})" if hasattr(node, "args") and isinstance(node.args, ast.arguments) else ""
        symbols.append({"id": sid, "name": name, "kind": kind, "file_path": path, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, "language": "python", "docstring": ast.get_docstring(node) or "", "signature": f"{name}{args}", "parent": parent})
        return sid

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, add(child, child.name, "method" if in_class else "function", owner), False)
            elif isinstance(child, ast.ClassDef):
                sid = add(child, child.name, "class", owner)
                edges.extend({"source": sid, "target": ast.unparse(b), "kind": "inherits"} for b in child.bases)
                visit(child, sid, True)
            else:
                if isinstance(child, ast.Import):
                    edges.extend({"source": path, "target": a.name, "kind": "imports"} for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    edges.append({"source": path, "target": "." * child.level + (child.module or ""), "kind": "imports"})
                elif isinstance(child, ast.Call) and owner:
                    name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                    if name:
                        calls.append((owner, name))
                visit(child, owner, in_class)

    visit(tree, None, False)
    of_name: dict[str, str] = {}
    for s in symbols:
        of_name.setdefault(s["name"], s["id"])
    edges += [{"source": o, "target": of_name.get(n, n), "kind": "calls"} for o, n in calls]
    return symbols, edges


_DEFINES = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)|^type\s+(\w+)\s+(?:struct|interface)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+(\w+)",
    "generic": r"^\s*(?:public|private|protected|static|\s)*(class|interface|def|func|fn|function)\s+(\w+)",
}
_DEFINES["typescript"] = _DEFINES["javascript"]


def parse_text(path: str, source: str, language: str) -> tuple[list[dict], list[dict]]:
    """Symbols of other languages by their defining lines, and calls between those of the file."""
    rule = re.compile(_DEFINES.get(language, _DEFINES["generic"]))
    lines = source.split("\n")
    symbols = []
    for i, line in enumerate(lines, 1):
        if m := rule.match(line):
            name = next(g for g in reversed(m.groups()) if g)
            kind = "class" if re.search(r"\b(class|struct|enum|trait|interface)\b", m.group(0)) else "function"
            symbols.append({"id": f"{path}::{name}", "name": name, "kind": kind, "file_path": path, "line_start": i, "line_end": i, "language": language, "docstring": "", "signature": line.strip()[:200], "parent": None})
    for s, nxt in zip(symbols, [*symbols[1:], {"line_start": len(lines) + 1}], strict=True):
        s["line_end"] = nxt["line_start"] - 1
    names = {s["name"]: s["id"] for s in reversed(symbols)}
    edges = [{"source": s["id"], "target": names[n], "kind": "calls"} for s in symbols for n in sorted(set(re.findall(r"\b(\w+)\s*\(", "\n".join(lines[s["line_start"] : s["line_end"]])))) if n in names]
    return symbols, edges


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of source files (path, language, content)."""

    def run(batches: Iterator[pd.DataFrame], want: int, schema: str) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            rows: list[dict] = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                rows += (parse_python(path, content) if language == "python" else parse_text(path, content, language or "generic"))[want]
            yield pd.DataFrame(rows, columns=names)

    rows = files.select("path", "language", "content")
    return rows.mapInPandas(lambda it: run(it, 0, SYMBOLS), SYMBOLS), rows.mapInPandas(lambda it: run(it, 1, EDGES), EDGES)


def _calls(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'calls'").select("source", "target").distinct()


def callers(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, caller): symbols that call the first symbol of each name."""
    first = symbols.join(names, "name", "left_semi").groupBy("name").agg(F.min("id").alias("target"))
    return first.join(_calls(edges), "target").join(symbols.select(F.col("id").alias("source")), "source").select("name", F.col("source").alias("caller"))


def callees(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, callee): symbols that the first symbol of each name calls."""
    first = symbols.join(names, "name", "left_semi").groupBy("name").agg(F.min("id").alias("source"))
    return first.join(_calls(edges), "source").join(symbols.select(F.col("id").alias("target")), "target").select("name", F.col("target").alias("callee"))


def resolve(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol of a name: an exact match, else the first that holds it in any case."""
    exact = F.col("name") == name
    near = F.contains(F.lower("name"), F.lit(name.lower()))
    return symbols.filter(exact | near).orderBy(F.when(exact, 0).otherwise(1), "id").limit(1)


def explore(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """A symbol with its callers and callees, and their counts with dangling ones."""
    one = resolve(symbols, name)
    calls = _calls(edges)
    into = one.select("id").join(calls, F.col("id") == F.col("target")).groupBy("id").agg(F.count("*").alias("n_callers"), F.sort_array(F.collect_set("source")).alias("callers"))
    out = one.select("id").join(calls, F.col("id") == F.col("source")).groupBy("id").agg(F.count("*").alias("n_callees"), F.sort_array(F.collect_set("target")).alias("callees"))
    return one.join(into, "id", "left").join(out, "id", "left")


def blast_radius(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, id, depth): what reaches each start over calls within ``max_depth``, at the least depth; direct callees have depth -1.

    Breadth first: each level is one join from the frontier and an anti-join with
    what was seen, so cycles end and shared callers are visited once.
    """
    calls = _calls(edges)
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("id"), F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(calls, F.col("id") == F.col("target")).select("start", F.col("source").alias("id")).distinct()
        front = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    below = starts.select(F.col("id").alias("start")).distinct().join(calls, F.col("start") == F.col("source")).select("start", F.col("target").alias("id")).distinct()
    below = below.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(-1))
    return seen.filter("depth > 0").unionByName(below)


def file_info(symbols: DataFrame) -> DataFrame:
    """(file_path, language, lines, n, symbols): every file with its symbols in order of their places."""
    inside = F.sort_array(F.collect_list(F.struct("line_start", "id", "kind")))
    grouped = symbols.groupBy("file_path").agg(F.min("language").alias("language"), F.max("line_end").alias("lines"), F.count("*").alias("n"), inside.alias("symbols"))
    return grouped.withColumn("symbols", F.transform("symbols", lambda s: F.struct(s["id"].alias("id"), s["kind"].alias("kind"))))


def search_symbols(symbols: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Symbols (of a kind, if given) by how they match: exact name 1.0, name .8, docstring .5, path .3; then by name."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    score = F.when(F.lower("name") == q, 1.0).when(has(F.col("name")), 0.8).when(has(F.col("docstring")), 0.5).when(has(F.col("file_path")), 0.3)
    if kind is not None:
        symbols = symbols.filter(F.col("kind") == kind)
    return symbols.withColumn("score", score).filter("score is not null").orderBy(F.col("score").desc(), "name", "id").limit(limit)


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, value, n): counts by symbol kind, language and edge kind."""
    s = symbols.groupBy(F.lit("symbol_kind").alias("facet"), F.col("kind").alias("value")).count()
    lang = symbols.groupBy(F.lit("language").alias("facet"), F.col("language").alias("value")).count()
    e = edges.groupBy(F.lit("edge_kind").alias("facet"), F.col("kind").alias("value")).count()
    return s.unionByName(lang).unionByName(e).withColumnRenamed("count", "n")


def dump(symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines, one a symbol or edge, with their part."""
    rows = symbols.select(F.lit("symbol").alias("part"), F.to_json(F.struct("*")).alias("body")).unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("*")).alias("body")))
    rows.write.mode("overwrite").json(path)


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of :func:`dump`."""
    rows = spark.read.schema("part string, body string").json(path)
    part = lambda name, schema: rows.filter(F.col("part") == name).select(F.from_json("body", schema).alias("r")).select("r.*")
    return part("symbol", SYMBOLS), part("edge", EDGES)
