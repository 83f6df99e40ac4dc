r"""A rule language for source code: a language's definitions, calls and imports as lines of text.

    language Zig             begins a language
    like Vue                 takes all rules of a language above
    only <open> <close>      only lines between lines that match these are read
    comment //               what begins a line that no rule sees
    block braces             how the bodies of the scopes below end: braces, end (a line "end" no deeper than the
                             definition), line (at once), or until <pattern>
    body <pattern>           only definitions on lines that match have a body; others end at once
    scope Function <pattern> a definition of that kind; the first group is its name
    import <pattern>         the first group that takes part is what is imported
    call <pattern>           the first group that takes part is the name called
    except if while          names that are no calls

Blank lines and lines that begin with "#" are notes. A function within a class, interface or module is a method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..schema import NODE_KINDS

OWNERS = ("Class", "Interface", "Module")


@dataclass(frozen=True)
class Scope:
    kind: str
    pattern: re.Pattern
    block: str
    until: re.Pattern | None = None
    body: re.Pattern | None = None


@dataclass(frozen=True)
class Rules:
    scopes: tuple[Scope, ...] = ()
    imports: tuple[re.Pattern, ...] = ()
    calls: tuple[re.Pattern, ...] = ()
    words: frozenset[str] = field(default_factory=frozenset)
    comments: tuple[str, ...] = ()
    only: tuple[re.Pattern, re.Pattern] | None = None


def _pattern(text: str, groups: int = 1) -> re.Pattern:
    found = re.compile(text)
    if found.groups < groups:
        raise ValueError(f"no group in {text!r}")
    return found


def parse_rules(text: str) -> dict[str, Rules]:
    """The rules of each language; a line that isn't of the language above is an error that names it."""
    out: dict[str, Rules] = {}
    name, block, until, body = "", "braces", None, None
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        try:
            if word == "language":
                name, block, until, body = rest, "braces", None, None
                out[name] = Rules()
                continue
            own = out[name]
            if word == "like":
                out[name] = out[rest]
            elif word == "only":
                out[name] = replace(own, only=tuple(_pattern(x, 0) for x in rest.split(" ", 1)))
            elif word == "comment":
                out[name] = replace(own, comments=(*own.comments, rest))
            elif word == "block":
                block, _, end = rest.partition(" ")
                if block not in ("braces", "end", "line", "until") or (block == "until") != bool(end):
                    raise ValueError(f"unknown block {rest!r}")
                until = _pattern(end, 0) if end else None
            elif word == "body":
                body = _pattern(rest, 0)
            elif word == "scope":
                kind, _, pattern = rest.partition(" ")
                if kind not in NODE_KINDS:
                    raise ValueError(f"unknown kind {kind!r}")
                out[name] = replace(own, scopes=(*own.scopes, Scope(kind, _pattern(pattern.strip()), block, until, body)))
            elif word == "import":
                out[name] = replace(own, imports=(*own.imports, _pattern(rest)))
            elif word == "call":
                out[name] = replace(own, calls=(*own.calls, _pattern(rest)))
            elif word == "except":
                out[name] = replace(own, words=own.words | frozenset(rest.split()))
            else:
                raise ValueError(f"unknown rule {word!r}")
        except (KeyError, ValueError, re.error) as e:
            raise ValueError(f"rule line {n}: {e}") from e
    return out


@dataclass
class _Open:
    fact: dict
    scope: Scope
    depth: int
    indent: int
    seen: bool = False

    def ends(self, line: str, first: bool, depth: int) -> bool:
        """Whether the definition's body is over with this line, after which braces are ``depth`` deep."""
        way = self.scope.block
        if way == "line" or first and self.scope.body and not self.scope.body.search(line):
            return True
        if way == "until":
            return bool(self.scope.until.search(line)) and (not first or line.rstrip().endswith(";"))
        if way == "end":
            closes = re.search(r"\bend\b", line) if first else re.match(r"\s*end\b", line)
            return bool(closes) and len(line) - len(line.lstrip()) <= self.indent
        self.seen |= "{" in line
        return depth <= self.depth if self.seen else line.rstrip().endswith(";")


def _first(m: re.Match) -> str | None:
    return next((g for g in m.groups() if g), None)


def facts(content: str, rules: Rules) -> Iterator[dict]:
    """Symbols, imports and calls of a file, in one pass over its lines; what never ends goes to the last line."""
    found: list[dict] = []
    others: list[dict] = []
    stack: list[_Open] = []
    depth, inside, lines = 0, rules.only is None, content.split("\n")
    for i, line in enumerate(lines, 1):
        if rules.only and not inside:
            inside = bool(rules.only[0].search(line))
            continue
        if rules.only and rules.only[1].search(line):
            inside = False
            continue
        if any(line.lstrip().startswith(c) for c in rules.comments):
            continue
        new, rest = None, line
        for scope in rules.scopes:
            m = scope.pattern.search(line)
            if m and _first(m):
                name, owner = _first(m), next((o.fact for o in reversed(stack) if o.fact["kind"] in OWNERS), None)
                kind = "Method" if owner and scope.kind == "Function" else scope.kind
                fact = {"fact": "symbol", "name": name, "qualified_name": f"{owner['qualified_name']}.{name}" if owner else name, "kind": kind, "start_line": i, "end_line": len(lines), "signature": line.strip()}
                new, rest = _Open(fact, scope, depth, len(line) - len(line.lstrip())), line[m.end(1) :]
                found.append(fact)
                stack.append(new)
                break
        depth += line.count("{") - line.count("}")
        imported = [x for p in rules.imports for m in p.finditer(line) if (x := _first(m))]
        others += [{"fact": "import", "target": x, "line": i} for x in imported]
        caller = next((o.fact for o in reversed(stack) if o.fact["kind"] in ("Function", "Method")), None)
        if caller and not imported:
            names = {(m.start(), x) for p in rules.calls for m in p.finditer(rest) if (x := _first(m)) and x not in rules.words}
            others += [{"fact": "call", "qualified_name": caller["qualified_name"], "target": x, "line": i} for _, x in sorted(names)]
        while stack and stack[-1].ends(line, stack[-1] is new, depth):
            stack.pop().fact["end_line"] = i
    yield from found
    yield from others


RULE_TEXT = r"""
language Lua
block end
comment --
scope Function ^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(\w+)
scope Function ^\s*(?:local\s+)?(?:[\w.]+\.)?(\w+)\s*=\s*function\b
import \brequire\s*\(?\s*['"]([^'"]+)
call (\w+)\s*\(
except if elseif while until for function and or not return

language Bash
comment #
scope Function ^\s*(?:function\s+)?([\w-]+)\s*\(\)
scope Function ^\s*function\s+([\w-]+)\s*\{
import ^\s*(?:source|\.)\s+["']?([^\s"']+)
call ^\s*([A-Za-z_][\w-]*)(?=\s|$)
except if then else elif fi for while until do done case esac function return local export echo set shift in exit

language Zig
comment //
scope Class ^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|union)\b
scope Enum ^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*enum\b
scope Function ^\s*(?:(?:pub|export|inline|extern)\s+)*fn\s+(\w+)
import @import\("([^"]+)"\)
call (?<![@\w])(\w+)\s*\(
except if while for switch return catch fn struct union enum

language PowerShell
comment #
scope Class (?i)^\s*class\s+(\w+)
scope Enum (?i)^\s*enum\s+(\w+)
scope Function (?i)^\s*(?:function|filter)\s+([\w:-]+)
import (?i)^\s*(?:import-module|using\s+module|\.)\s+["']?([^\s"']+)
call (?<![\w$-])([A-Z][A-Za-z]+-\w+)
except Import-Module

language Elixir
block end
comment #
body \bdo\s*$
scope Module ^\s*defmodule\s+([\w.]+)
scope Interface ^\s*defprotocol\s+([\w.]+)
scope Function ^\s*defp?\s+(\w+[?!]?)
scope Function ^\s*defmacrop?\s+(\w+[?!]?)
import ^\s*(?:import|alias|use|require)\s+([\w.]+)
call (\w+[?!]?)\(
except if unless case cond with for fn quote unquote

language Objective-C
comment //
block until ^\s*@end
scope Class ^\s*@(?:interface|implementation)\s+(\w+)
scope Interface ^\s*@protocol\s+(\w+)
block braces
scope Method ^\s*[-+]\s*\([^)]*\)\s*(\w+)
scope Function ^(?!\s|return\b|else\b|typedef\b|#|@)[\w*\s]+?\b(\w+)\s*\([^;]*$
import ^\s*[#@](?:import|include)\s+[<"]?([^>";]+)
call \[\s*[\w.]+\s+(\w+)
call (?<![\w@])(\w+)\s*\(
except if while for switch return sizeof

language Dart
comment //
scope Class ^\s*(?:abstract\s+|sealed\s+|final\s+)*class\s+(\w+)
scope Class ^\s*(?:mixin|extension)\s+(\w+)
scope Enum ^\s*enum\s+(\w+)
scope TypeAlias ^\s*typedef\s+(\w+)\s*=
scope Function ^(?!\s*(?:return|else|await|throw|new|if|for|while|switch)\b)\s*(?:static\s+)?[\w<>?,\[\]]+\s+(\w+)\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{|=>)
import ^\s*(?:import|export|part)\s+['"]([^'"]+)
call (?<!\w)(\w+)\s*\(
except if while for switch return catch assert super

language SQL
comment --
block until ;\s*$
scope Function (?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)
scope Class (?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)
call (?i)(?<![\w.])(\w+)\s*\(

language Vue
only <script\b </script>
comment //
scope Class ^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)
scope Function ^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)
scope Function ^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>
scope Method ^\s+(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|function\b)(\w+)\s*\([^;]*\)\s*\{\s*$
import ^\s*import\b.*?['"]([^'"]+)['"]
call (?<![\w])(?:\w+\.)*(\w+)\s*\(
except if while for switch return catch function super

language Svelte
like Vue
"""
