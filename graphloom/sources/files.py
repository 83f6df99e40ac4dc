"""Source files: discovery, languages and guards; specifications and owner rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "py": "Python", "pyi": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "rs": "Rust", "go": "Go", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "rb": "Ruby", "php": "PHP", "swift": "Swift", "scala": "Scala", "lua": "Lua", "sh": "Bash", "bash": "Bash", "sql": "SQL", "md": "Markdown", "mdx": "Markdown", "markdown": "Markdown", "zig": "Zig", "ps1": "PowerShell", "ex": "Elixir", "exs": "Elixir", "m": "Objective-C", "dart": "Dart", "vue": "Vue", "svelte": "Svelte", "txt": "Text", "ipynb": "Notebook", "eml": "Email", "mbox": "Mbox",
}
# Folders that are never read.
SKIPPED = ("node_modules", "__pycache__", "target", "dist", "build", ".venv", "venv")
# Ends of names of generated files, which are never read.
GENERATED = (".min.js", ".bundle.js", ".map")


def language_of(path: Column) -> Column:
    """The language of a file by its extension; null if there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def skipped(path: Column) -> Column:
    """Whether a path has a hidden or excluded folder in it."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(*SKIPPED) | (x.startswith(".") & (F.length(x) > 1) & (x != "..")))


def problem(content: Column, most_bytes: int = 512 * 1024, longest_line: int = 5120) -> Column:
    """Why a file's bytes are not read: size, encoding or a very long line; null if they are."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(F.length(content) > most_bytes, "too_large").when(text.isNull(), "not_utf8").when(F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > longest_line), "long_line")


def generated(path: Column) -> Column:
    """Whether a file's name says that it was made by a tool."""
    return F.lower(path).rlike("(" + "|".join(re.escape(x) for x in GENERATED) + ")$")


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether any of the globs fits a path: ** crosses folders, * and ? stay within one."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    patterns = ["".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|.", g, re.S)) for g in globs]
    return path.rlike("^(" + "|".join(patterns) + ")$") if globs else F.lit(False)


def source_files(spark: SparkSession, root: str, most_bytes: int = 512 * 1024, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, content, problem) of the files below a folder, paths relative to it; with globs to
    ``include``, only those that fit one. A file that is too large has its row, but its bytes are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), rf"^.*?{root.split('://')[-1].strip('/')}/", "")
    small = raw.where(F.col("length") <= most_bytes).select(path.alias("path"), "content", problem(F.col("content"), most_bytes).alias("problem"))
    large = raw.where(F.col("length") > most_bytes).select(path.alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("problem"))
    own = F.col("path")
    rows = small.unionByName(large).where(~skipped(own) & ~generated(own) & ~matches(own, exclude))
    rows = (rows.where(matches(own, include)) if include else rows).select("path", language_of(own).alias("language"), "content", "problem")
    return rows.where(F.col("language").isNotNull()).withColumn("content", F.when(F.col("problem").isNull(), F.col("content").cast("string")))


def owner_rules(lines: DataFrame) -> DataFrame:
    """(rule_no, pattern, owner) of an owners file (line_no, line): no comments, two words and more."""
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.where(~F.col("line").rlike(r"^\s*#")).select(F.col("line_no").alias("rule_no"), words.alias("w")).where(F.size("w") > 1)
    return rows.select("rule_no", F.col("w")[0].alias("pattern"), F.array_join(F.slice("w", 2, 1000), " ").alias("owner"))


def rpc_endpoints(files: DataFrame) -> DataFrame:
    """(path, operation, request, response) of "rpc X(Y) returns (Z)" in interface files (path, content)."""
    pattern = r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)"
    each = lambda i: F.regexp_extract_all("content", F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(each(1).alias("operation"), each(2).alias("request"), each(3).alias("response"))
    return files.select("path", F.explode(zipped).alias("x")).select("path", "x.operation", "x.request", "x.response")


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """(path, operation, method, route) of OpenAPI files (path, content) in YAML or JSON."""
    methods = ("get", "post", "put", "delete", "patch", "head", "options")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    spec = yaml.safe_load(content) or {}
                except yaml.YAMLError:
                    continue
                paths = spec.get("paths") if isinstance(spec, dict) else None
                for route, ways in paths.items() if isinstance(paths, dict) else ():
                    for m, way in ways.items() if isinstance(ways, dict) else ():
                        if m in methods:
                            named = way.get("operationId") if isinstance(way, dict) else None
                            rows.append((path, str(named or f"{m}_{route}"), m.upper(), str(route)))
            yield pd.DataFrame(rows, columns=["path", "operation", "method", "route"])

    return files.select("path", "content").mapInPandas(run, "path string, operation string, method string, route string")


def ontology_types(spark: SparkSession, path: str) -> DataFrame:
    """(name, extends, properties) of the entity types of an ontology's YAML file or folder of them; what isn't
    of that form is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for content in batch["value"]:
                try:
                    spec = yaml.safe_load(content)
                except yaml.YAMLError:
                    continue
                types = next((spec[k] for k in ("entity_types", "entities", "types") if isinstance(spec, dict) and spec.get(k)), [])
                types = [{"name": k} | (v or {}) for k, v in types.items()] if isinstance(types, dict) else types
                for x in types if isinstance(types, list) else ():
                    if isinstance(x, dict) and x.get("name"):
                        own = x.get("properties") or []
                        names = list(own) if isinstance(own, dict) else [y.get("name") if isinstance(y, dict) else y for y in own]
                        rows.append((str(x["name"]), x.get("extends"), [str(y) for y in names if y is not None]))
            yield pd.DataFrame(rows, columns=["name", "extends", "properties"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "name string, extends string, properties array<string>")
