"""Source code to symbols, calls and imports: Python by its syntax tree, others by line rules.

The line rules know definitions of functions, types and methods by keyword and braces; they are an
approximation of a full parser, which this library does not carry. Further languages, and a caller's own, are
written in the rule language of ``rules.py``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R

SYMBOL = "name string, qualified_name string, kind string, start_line long, end_line long, signature string, decorators array<string>, return_type string, superclasses array<string>"
FACTS = f"file_path string, fact string, {SYMBOL}, target string, line long"

# Definitions by line, for languages with braces or ends: (kind, pattern with the name in group 1).
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "JavaScript": (("Class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("Function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("Method", r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;]*\)\s*(?::\s*[^{;]+)?\{\s*$")),
    "TypeScript": (("Interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("TypeAlias", r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"), ("Enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)")),
    "Rust": (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("Enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("Interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")),
    "Go": (("Method", r"^func\s+\([^)]*\)\s+(\w+)"), ("Function", r"^func\s+(\w+)"), ("Interface", r"^type\s+(\w+)\s+interface"), ("Class", r"^type\s+(\w+)\s+struct")),
    "Java": (("Class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(\w+)"), ("Interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("Enum", r"^\s*(?:(?:public|private|protected)\s+)*enum\s+(\w+)"), ("Method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$")),
    "Ruby": (("Class", r"^\s*class\s+(\w+)"), ("Module", r"^\s*module\s+(\w+)"), ("Method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")),
    "PHP": (("Class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)")),
    "C": (("Function", r"^(?!\s|return\b|else\b|typedef\b|#)[\w*\s]+?\b(\w+)\s*\([^;]*$"), ("Class", r"^\s*(?:typedef\s+)?struct\s+(\w+)")),
    "Kotlin": (("Class", r"^\s*(?:(?:data|open|abstract|sealed)\s+)*class\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Function", r"^\s*(?:(?:private|public|override|suspend)\s+)*fun\s+(?:<[^>]+>\s*)?(\w+)")),
    "Swift": (("Class", r"^\s*(?:(?:public|private|final)\s+)*(?:class|struct)\s+(\w+)"), ("Interface", r"^\s*(?:public\s+)?protocol\s+(\w+)"), ("Enum", r"^\s*(?:public\s+)?enum\s+(\w+)"), ("Function", r"^\s*(?:(?:public|private|static|override)\s+)*func\s+(\w+)")),
}
RULES["TypeScript"] += RULES["JavaScript"]
RULES["C#"] = RULES["Java"]
RULES["C++"] = (("Class", r"^\s*class\s+(\w+)"), *RULES["C"])
RULES["Scala"] = (("Class", r"^\s*(?:case\s+)?class\s+(\w+)"), ("Interface", r"^\s*trait\s+(\w+)"), ("Module", r"^\s*object\s+(\w+)"), ("Function", r"^\s*def\s+(\w+)"))
IMPORT = re.compile(r"""^\s*(?:import\b.*?from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"]|(?:import|use|using)\s+([\w.:]+)|#include\s*[<"]([^>"]+)[>"]|require(?:_relative)?\s*\(?['"]([^'"]+)['"])""")
CALL = re.compile(r"(?<![\w.])(?:(?:\w+)(?:\.|::|->))*(\w+)\s*\(")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "def", "match", "sizeof", "super", "new", "throw", "await", "elif", "class"}


def python_facts(content: str) -> Iterator[dict]:
    """Symbols, calls and imports of a Python file; none if it doesn't parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = content.split("\n")

    def walk(node: ast.AST, owner: str, kind: str) -> Iterator[dict]:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{owner}.{x.name}" if owner else x.name
                own = "Class" if isinstance(x, ast.ClassDef) else "Method" if kind == "Class" else "Function"
                yield {"fact": "symbol", "name": x.name, "qualified_name": name, "kind": own, "start_line": x.lineno, "end_line": x.end_lineno, "signature": lines[x.lineno - 1].strip(), "decorators": [ast.unparse(d) for d in x.decorator_list], "return_type": ast.unparse(x.returns) if getattr(x, "returns", None) else None, "superclasses": [ast.unparse(b) for b in getattr(x, "bases", [])]}
                yield from walk(x, name, own)
                continue
            if isinstance(x, ast.Import):
                yield from ({"fact": "import", "target": a.name, "line": x.lineno} for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                yield from ({"fact": "import", "target": f"{'.' * x.level}{x.module or ''}.{a.name}", "line": x.lineno} for a in x.names)
            elif isinstance(x, ast.Call):
                target = x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id if isinstance(x.func, ast.Name) else None
                if target and owner:
                    yield {"fact": "call", "qualified_name": owner, "target": target, "line": x.lineno}
            yield from walk(x, owner, kind)

    yield from walk(tree, "", "Module")


def ruled_facts(content: str, language: str) -> Iterator[dict]:
    """Symbols by line rules, ended by their braces (or by indentation); calls and imports by line."""
    lines, rules = content.split("\n"), [(k, re.compile(p)) for k, p in RULES[language]]
    found: list[dict] = []
    for i, line in enumerate(lines):
        for kind, rule in rules:
            if m := rule.match(line):
                depth, end, seen = 0, i, False
                indent = len(line) - len(line.lstrip())
                for j in range(i, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    seen |= "{" in lines[j]
                    if seen and depth <= 0 or language == "Ruby" and j > i and lines[j].strip() == "end" and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                        end = j
                        break
                    if not seen and lines[j].rstrip().endswith(";"):
                        end = j
                        break
                owner = next((f for f in reversed(found) if f["start_line"] <= i + 1 <= f["end_line"] and f["kind"] in ("Class", "Interface", "Module")), None)
                own = "Method" if owner and kind == "Function" else kind
                found.append({"fact": "symbol", "name": m[1], "qualified_name": f"{owner['qualified_name']}.{m[1]}" if owner else m[1], "kind": own, "start_line": i + 1, "end_line": end + 1, "signature": line.strip()})
                break
    yield from found
    for i, line in enumerate(lines):
        if m := IMPORT.match(line):
            yield {"fact": "import", "target": next(g for g in m.groups() if g), "line": i + 1}
            continue
        owner = next((f for f in reversed(found) if f["start_line"] < i + 1 <= f["end_line"] and f["kind"] in ("Function", "Method")), None)
        if owner:
            yield from ({"fact": "call", "qualified_name": owner["qualified_name"], "target": t, "line": i + 1} for t in CALL.findall(line) if t not in KEYWORDS)


def code_facts(files: DataFrame, rules: str = "") -> DataFrame:
    """FACTS of files (path, language, content): fact is symbol, call or import. A call's qualified_name is the
    caller; target is the name called or the module imported. ``rules``, in the rule language, replace what is
    built in for their languages. Files of other languages have no facts."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    own, more = R.parse_rules(rules), R.parse_rules(R.RULE_TEXT)

    def of(content: str, language: str) -> Iterator[dict]:
        if language in own:
            return R.facts(content, own[language])
        if language == "Python":
            return python_facts(content)
        if language in RULES:
            return ruled_facts(content, language)
        return R.facts(content, more[language]) if language in more else iter(())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                if not content:
                    continue
                rows += [{"file_path": path} | f for f in of(content, language)]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return files.select("path", "language", "content").mapInPandas(run, FACTS)


def symbols_of(facts: DataFrame, repo: str) -> DataFrame:
    """Symbol rows with ids that stay the same when a file is read again."""
    own = facts.where("fact = 'symbol'")
    uid = F.sha2(F.concat_ws("|", F.lit(repo), "file_path", "qualified_name", "kind", F.col("start_line").cast("string")), 256)
    return own.select(F.substring(uid, 1, 32).alias("uid"), "name", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature", F.lit(repo).alias("repo_id"), F.to_json(F.struct("decorators", "return_type", "superclasses")).alias("metadata"))
