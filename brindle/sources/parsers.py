"""Facts of source files: symbols, imports, calls, base types, uses and types of variables.

Every parser turns one file into rows of one flat shape, so that resolution is joins. Python is parsed by the standard
library; the languages with braces share a scanner that is told their declarations.
"""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, language string, module string, fact string, owner string, name string, kind string, object string, remote string, start_line int, start_col int, end_line int, end_col int, ord int"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
FILE = "$file"
#: Words of control flow, and further names that are no calls of their own when nothing stands before them.
CONTROL = frozenset("if for while switch return catch sizeof typeof function await match fn defer go select elif when using lock foreach nameof".split())
NO_CALLS = CONTROL | {"new", "super", "assert", "print", "println", "panic"}


@dataclass
class Index:
    path: str
    language: str
    module: str
    rows: list[tuple] = field(default_factory=list)

    def add(self, fact: str, owner: str = "", name: str = "", kind: str = "", obj: str | None = None, remote: str | None = None, at: tuple[int, int, int, int] = (0, 0, 0, 0)) -> None:
        self.rows.append((self.path, self.language, self.module, fact, owner, name, kind, obj, remote, *at, len(self.rows)))


def module_key(path: str, language: str) -> str:
    """The dotted module name of a file."""
    stem = re.sub(r"\.\w+$", "", path)
    parts = [p for p in stem.split("/") if p not in ("", ".")]
    last = {"Python": "__init__", "TypeScript": "index", "JavaScript": "index", "Rust": "mod"}.get(language)
    if parts and parts[-1] == last:
        parts = parts[:-1] or parts
    if language == "Go" and len(parts) > 1:
        parts = parts[:-1]
    return ".".join(parts)


# --- Python


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def _span(n: ast.AST) -> tuple[int, int, int, int]:
    return n.lineno, n.col_offset + 1, n.end_lineno or n.lineno, (n.end_col_offset or 0) + 1


def _types(node: ast.AST | None) -> list[str]:
    return [] if node is None else [d for x in ast.walk(node) if (d := _dotted(x)) and "." not in d]


def parse_python(path: str, text: str, language: str = "Python") -> Index:
    """Classes nest with dotted keys; functions inside functions are no symbols, their calls are the outer function's."""
    ix = Index(path, language, module_key(path, language))
    tree = ast.parse(text)
    ix.add("symbol", "", FILE, "File", at=(1, 1, max(1, text.count("\n") + 1), 1))
    seen: set[str] = set()

    def imports(n: ast.AST) -> None:
        if isinstance(n, ast.Import):
            for a in n.names:
                ix.add("import", FILE, a.asname or a.name.split(".")[0], "module", a.name, None, _span(n))
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            for a in n.names:
                ix.add("import", FILE, a.asname or a.name, "star" if a.name == "*" else "name", module, a.name, _span(n))

    def body(owner: str, cls: str, nodes: list[ast.AST]) -> None:
        for top in nodes:
            for n in ast.walk(top):
                if isinstance(n, (ast.Import, ast.ImportFrom)):
                    imports(n)
                elif isinstance(n, ast.Call):
                    f = n.func
                    if isinstance(f, ast.Name) and f.id == "isinstance" and len(n.args) == 2:
                        for t in _types(n.args[1]):
                            ix.add("use", owner, t, at=_span(n))
                    elif isinstance(f, ast.Name) and f.id not in ("print", "super"):
                        ix.add("call", owner, f.id, at=_span(n))
                    elif isinstance(f, ast.Attribute) and (obj := _dotted(f.value)):
                        ix.add("call", owner, f.attr, "", obj, at=_span(n))
                elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                    made = n.value.func if isinstance(n.value, ast.Call) else n.annotation if isinstance(n, ast.AnnAssign) else None
                    t = _dotted(made) if made is not None else None
                    for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        d = _dotted(target)
                        if d and t and d.startswith("self.") and cls:
                            ix.add("type", cls, d[5:], "field", t, at=_span(n))
                        elif d and t and "." not in d:
                            ix.add("type", owner, d, "local", t, at=_span(n))

    def function(n: ast.FunctionDef | ast.AsyncFunctionDef, prefix: str) -> None:
        key = f"{prefix}.{n.name}" if prefix else n.name
        seen.add(key)
        ix.add("symbol", prefix, key, "Function", at=_span(n))
        a = n.args
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
            for t in _types(arg.annotation):
                ix.add("use", key, t, at=_span(arg))
            if t := (arg.annotation is not None and _dotted(arg.annotation)):
                ix.add("type", key, arg.arg, "local", t, at=_span(arg))
        for t in _types(n.returns):
            ix.add("use", key, t, at=_span(n))
        body(key, prefix, n.body)

    def block(nodes: list[ast.stmt], prefix: str) -> None:
        for n in nodes:
            if isinstance(n, ast.ClassDef):
                key = f"{prefix}.{n.name}" if prefix else n.name
                seen.add(key)
                ix.add("symbol", prefix, key, "Class", at=_span(n))
                for b in n.bases:
                    if (d := _dotted(b)) and d != "object":
                        ix.add("extends", key, d, at=_span(b))
                block(n.body, key)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(n, prefix)
            elif not prefix and isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
                for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(target, ast.Name) and target.id not in seen:
                        seen.add(target.id)
                        ix.add("symbol", "", target.id, "Function", at=_span(n))
                body(FILE, "", [n])
            elif not prefix and isinstance(n, (ast.If, ast.Try, ast.With)):
                for part in ("body", "orelse", "finalbody"):
                    block(getattr(n, part, []), "")
            else:
                body(prefix or FILE, prefix, [n])

    block(tree.body, "")
    return ix


_LOOSE_IMPORT = re.compile(r"^[ \t]*(?:from\s+(?P<mod>[.\w]+)\s+import\s+(?P<names>\([^)]*\)|[^\n#]+)|import\s+(?P<mods>[^\n#]+))", re.M)
_LOOSE_DEF = re.compile(r"^(?P<what>class|(?:async\s+)?def)\s+(?P<name>\w+)", re.M)
_LOOSE_CALL = re.compile(r"(?<![\w.])(?:(?P<obj>\w+)\.)?(?P<name>\w+)\(")
_LOOSE_QUIET = re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def parse_python_loosely(path: str, text: str, language: str = "Python") -> Index:
    """A file that does not parse, by patterns: its own symbol, top-level definitions, imports, and calls of names and of members of names."""
    ix = Index(path, language, module_key(path, language))
    code = _LOOSE_QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines = code.count("\n") + 1
    ix.add("symbol", "", FILE, "File", at=(1, 1, lines, 1))
    for m in _LOOSE_IMPORT.finditer(code):
        for part in filter(None, (x.strip() for x in (m["names"] or m["mods"]).strip("() \t").split(","))):
            remote, _, local = (x.strip() for x in part.partition(" as "))
            if m["mod"]:
                ix.add("import", FILE, local or remote, "star" if remote == "*" else "name", m["mod"], remote)
            else:
                ix.add("import", FILE, local or remote.split(".")[0], "module", remote, None)
    tops = [(m.start(), m["name"], m["what"]) for m in _LOOSE_DEF.finditer(code)]
    starts = [x[0] for x in tops]
    for i, (at, name, what) in enumerate(tops):
        line = code.count("\n", 0, at) + 1
        ix.add("symbol", "", name, "Class" if what == "class" else "Function", at=(line, 1, line, 1))
    for m in _LOOSE_CALL.finditer(code):
        if m["name"] in ("print", "super") or m["name"] in keyword.kwlist or re.search(r"\b(?:def|class)\s+$", code[max(0, m.start() - 8) : m.start()]):
            continue
        i = bisect_right(starts, m.start()) - 1
        indented = code[code.rfind("\n", 0, m.start()) + 1 : m.start() + 1][:1] in " \t"
        ix.add("call", tops[i][1] if i >= 0 and indented else FILE, m["name"], "", m["obj"])
    return ix


# --- languages with braces


@dataclass(frozen=True)
class Grammar:
    """Patterns of declarations, each with the groups they name; they are matched on lines without comments and strings."""

    types: str
    functions: tuple[str, ...]
    imports: Callable[[str], list[tuple[str, str, str, str | None]]]
    made: str = r"\b(?P<var>\w+)\s*(?::=|=)\s*(?:new\s+|&)?(?P<type>[A-Z]\w*)\s*[({]"
    separator: str = r"\.|->|::"
    fields: tuple[str, ...] = ()


#: Fields: what a method makes and keeps, parameters that are kept, and declarations with the type before or behind the name.
_SET = r"\b(?:this|self)\s*(?:\.|->)\s*(?P<var>\w+)\s*=\s*(?:new\s+)?(?P<type>[A-Z]\w*)\s*[({<]"
_PARAMETER = r"[(,]\s*(?:(?:private|public|protected|readonly)\s+)+(?P<var>\w+)\s*\??:\s*(?P<type>[A-Z]\w*)"
_TYPE_BEFORE = r"^\s*(?:(?:public|private|protected|internal|static|final|readonly|volatile|mutable|const)\s+)*(?:(?:std::)?(?:unique_ptr|shared_ptr|Optional|List)\s*<\s*)?(?P<type>[A-Z]\w*)(?:<[^>;]*>)?\s*>?\s*[*&?]?\s*\b(?P<var>\w+)\s*(?:=[^;]*|\{[^;}]*[;}][^;}]*\})?;?\s*$"
_TYPE_BEHIND = r"^\s*(?:(?:private|public|protected|readonly|static|declare|pub(?:\([^)]*\))?)\s+)*(?P<var>\w+)\s*[?!]?:\s*(?:&\s*(?:mut\s+)?)?(?:(?:Box|Arc|Rc|Option|Mutex|RefCell)\s*<\s*)*(?P<type>[A-Z]\w*)"
_GO_FIELD = r"^\s+(?P<var>\w+)\s+\*?(?:\w+\.)?(?P<type>[A-Z]\w*)\s*$"
#: The types of fields that each language declares.
FIELDS = {"TypeScript": (_PARAMETER, _TYPE_BEHIND), "Rust": (_TYPE_BEHIND,), "Go": (_GO_FIELD,), "Java": (_TYPE_BEFORE,), "CSharp": (_TYPE_BEFORE,), "C": (_TYPE_BEFORE,), "Cpp": (_TYPE_BEFORE,)}


def _js_imports(text: str) -> list[tuple[str, str, str, str | None]]:
    out: list[tuple[str, str, str, str | None]] = []
    for m in re.finditer(r"\b(?:import|export)\s+(?P<what>[\w\s{},*$]+?)\s+from\s+['\"](?P<mod>[^'\"]+)['\"]|\bimport\s+['\"](?P<bare>[^'\"]+)['\"]", text):
        if m["bare"]:
            out.append((m["bare"], m["bare"], "module", None))
            continue
        what = m["what"].replace("type ", "")
        if braces := re.search(r"\{([^}]*)\}", what):
            for part in filter(None, (p.strip() for p in braces[1].split(","))):
                remote, _, local = part.partition(" as ")
                out.append((m["mod"], (local or remote).strip(), "name", remote.strip()))
        rest = re.sub(r"\{[^}]*\}", "", what)
        for part in filter(None, (p.strip() for p in rest.split(","))):
            if star := re.match(r"\*\s+as\s+(\w+)", part):
                out.append((m["mod"], star[1], "module", None))
            elif part == "*":
                out.append((m["mod"], "*", "star", "*"))
            else:
                out.append((m["mod"], part, "name", part))
    for m in re.finditer(r"\b(?:const|let|var)\s+(?:(?P<name>\w+)|\{(?P<names>[^}]*)\})\s*=\s*require\(\s*['\"](?P<mod>[^'\"]+)['\"]", text):
        if m["name"]:
            out.append((m["mod"], m["name"], "module", None))
        for part in filter(None, (p.strip() for p in (m["names"] or "").split(","))):
            remote, _, local = part.partition(":")
            out.append((m["mod"], (local or remote).strip(), "name", remote.strip()))
    return out


def _rust_imports(text: str) -> list[tuple[str, str, str, str | None]]:
    out: list[tuple[str, str, str, str | None]] = []

    def tree(prefix: str, s: str) -> None:
        depth, start, parts = 0, 0, []
        for i, c in enumerate(s + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(s[start:i].strip())
                start = i + 1
        for p in filter(None, parts):
            if (b := p.find("{")) >= 0:
                tree(prefix + p[:b], p[b + 1 : p.rfind("}")])
                continue
            full, _, alias = (prefix + p).partition(" as ")
            module, _, leaf = full.strip().rpartition("::")
            if leaf == "*":
                out.append((module, "*", "star", "*"))
            elif leaf == "self":
                out.append((module, alias.strip() or module.rpartition("::")[2], "module", None))
            else:
                out.append((module, alias.strip() or leaf, "name", leaf))

    for m in re.finditer(r"\buse\s+([^;]+);", text):
        tree("", re.sub(r"\s+", " ", m[1]))
    return out


def _go_imports(text: str) -> list[tuple[str, str, str, str | None]]:
    blocks = re.findall(r"\bimport\s*\(([^)]*)\)|\bimport\s+((?:\w+\s+)?\"[^\"]+\")", text)
    return [(mod, alias or mod.rpartition("/")[2], "module", None) for b in blocks for alias, mod in re.findall(r"(\w+)?\s*\"([^\"]+)\"", b[0] or b[1])]


def _java_imports(text: str) -> list[tuple[str, str, str, str | None]]:
    out: list[tuple[str, str, str, str | None]] = []
    for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", text):
        module, _, leaf = m[1].rpartition(".")
        out.append((m[1], "*", "star", "*") if m[2] else (m[1], leaf, "name", leaf))
    return out


def _using(text: str) -> list[tuple[str, str, str, str | None]]:
    return [(m[2], m[1] or "*", "module" if m[1] else "star", None if m[1] else "*") for m in re.finditer(r"\busing\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", text)]


def _includes(text: str) -> list[tuple[str, str, str, str | None]]:
    return [(m[1], "*", "star", "*") for m in re.finditer(r"^\s*#\s*include\s+\"([^\"]+)\"", text, re.M)]


_METHOD = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|inline|constexpr|extern|unsafe|const|default)\s+)*[\w<>\[\],.:*&?~ ]+?[\s*&](?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|throws\s+[\w., ]+|where\s[^{]*|:[^{;]*)*\s*\{"
_CONSTRUCTOR = r"^\s*(?:(?:public|private|protected|internal|explicit)\s+)*(?P<name>[A-Z]\w*)\s*\([^;{}]*\)\s*(?::[^{;]*|throws\s+[\w., ]+)?\{"
_C_TYPES = r"\b(?:class|struct|enum(?:\s+class)?|union|namespace)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[^{;]+))?\{"
GRAMMARS = {
    "JavaScript": Grammar(
        r"\b(?:class)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?[^{;]*\{",
        (r"\bfunction\s*\*?\s*(?P<name>\w+)\s*\(", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", r"\b(?:module\.)?exports\.(?P<name>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>)", r"\b(?P<class>\w+)\.prototype\.(?P<name>\w+)\s*=\s*function\b", r"^\s*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?(?P<name>(?!(?:if|for|while|switch|catch|return|function)\b)\w+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^{;=]+)?\{"),
        _js_imports,
    ),
    "Rust": Grammar(
        r"\b(?:struct|enum|trait|union|mod)\s+(?P<name>\w+)[^;{(]*[{(;]|\bimpl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<impl>\w+)[^{;]*\{",
        (r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\(", r"\b(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_][A-Z0-9_]*)\s*:", r"\btype\s+(?P<name>\w+)\s*="),
        _rust_imports,
        made=r"\blet\s+(?:mut\s+)?(?P<var>\w+)\s*(?::[^=]+)?=\s*(?P<type>[A-Z]\w*)\s*(?:::|\{|\()",
    ),
    "Go": Grammar(r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{", (r"\bfunc\s+\(\s*\w*\s*\*?(?P<class>\w+)[^)]*\)\s*(?P<name>\w+)\s*\(", r"\bfunc\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), _go_imports),
    "Java": Grammar(r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?\s*(?:extends\s+(?P<bases>[\w.<>, ]+?))?\s*(?:implements\s+(?P<more>[\w.<>, ]+?))?\s*\{", (_METHOD, _CONSTRUCTOR), _java_imports),
    "CSharp": Grammar(r"\b(?:class|interface|enum|struct|record)\s+(?P<name>\w+)(?:<[^>{]*>)?\s*(?::\s*(?P<bases>[\w.<>, ]+?))?\s*(?:where[^{]*)?\{", (_METHOD, _CONSTRUCTOR), _using),
    "C": Grammar(r"\b(?:struct|enum|union)\s+(?P<name>\w+)\s*\{", (_METHOD,), _includes),
    "Cpp": Grammar(_C_TYPES, (r"^\s*[\w<>:*&,~ ]*?\b(?P<class>\w+)::(?P<name>~?\w+)\s*\([^;{}]*\)[^;{}]*\{", _METHOD, _CONSTRUCTOR), _includes),
}
GRAMMARS["TypeScript"] = Grammar(GRAMMARS["JavaScript"].types.replace(r"(?:class)", r"(?:class|interface|enum)").replace(r"[^{;]*\{", r"[^{;]*\{|\btype\s+(?P<alias>\w+)\s*(?:<[^>]*>)?="), GRAMMARS["JavaScript"].functions, _js_imports)
GRAMMARS = {n: replace(g, fields=FIELDS.get(n, ())) for n, g in GRAMMARS.items()}
_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)


def quiet(text: str, language: str) -> str:
    """The text with comments and the insides of strings blanked, every offset kept."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if language == "Rust" and s[0] == "'" and len(s) > 4:
            return s
        keep = s[0] in "\"'`"
        return (s[0] if keep else " ") + re.sub(r"[^\n]", " ", s[1:-1]) + (s[-1] if keep else " ") if len(s) > 1 else s

    return _QUIET.sub(blank, text)


def parse_braces(path: str, text: str, language: str) -> Index:
    g = GRAMMARS[language]
    ix = Index(path, language, module_key(path, language))
    code = quiet(text, language)
    starts = [0]
    for m in re.finditer("\n", code):
        starts.append(m.end())

    def where(a: int, b: int) -> tuple[int, int, int, int]:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        return i + 1, a - starts[i] + 1, j + 1, b - starts[j] + 1

    closing: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            closing[open_.pop()] = m.end()

    def end_of(at: int) -> int:
        """The end of the block that opens after ``at``, before any statement ends."""
        m = re.compile(r"[{;]").search(code, at)
        return closing.get(m.start(), len(code)) if m and m[0] == "{" else (m.end() if m else len(code))

    ix.add("symbol", "", FILE, "File", at=(1, 1, len(starts), 1))
    for module, local, kind, remote in g.imports(text):
        ix.add("import", FILE, local, kind, module, remote)
    scopes: list[tuple[int, int, str, bool]] = []  # start, end, key, whether a type
    around: list[tuple[int, int, str, bool]] = []  # those of them that are open where the search has come to

    def scope(at: int) -> str:
        """The innermost type around a place that lies behind all places asked for before."""
        around[:] = [x for x in around if at < x[1]]
        inner = [x for x in around if x[3]]
        return max(inner, key=lambda x: x[0])[2] if inner else ""

    def opened(a: int, b: int, key: str, is_type: bool) -> None:
        scopes.append((a, b, key, is_type))
        around.append(scopes[-1])

    found = []
    for m in re.finditer(g.types, code, re.M):
        d = m.groupdict()
        name = d.get("name") or d.get("alias") or d.get("impl")
        if name:
            found.append((m.start(), end_of(m.end() - 1) if code[m.end() - 1] == "{" else end_of(m.start()), name, True, d))
    for pattern in g.functions:
        for m in re.finditer(pattern, code, re.M):
            name = m["name"]
            if name in CONTROL:
                continue
            at = m.end() - 1 if code[m.end() - 1] == "{" else m.end()
            found.append((m.start("name"), end_of(at), name, False, m.groupdict()))
    done: set[tuple[str, int]] = set()
    for a, b, name, is_type, d in sorted(found, key=lambda x: (x[0], not x[3])):
        within = scope(a)
        # Functions inside functions are no symbols.
        if any(not x[3] for x in around):
            continue
        prefix = d.get("class") or within
        key = f"{prefix}.{name}" if prefix and prefix != name or (prefix and not is_type) else name
        if is_type and d.get("impl"):
            opened(a, b, name, True)
            if d.get("trait"):
                ix.add("extends", name, d["trait"].rpartition("::")[2], at=where(a, a + 1))
            continue
        if (key, where(a, b)[0]) in done:
            continue
        done.add((key, where(a, b)[0]))
        opened(a, b, key, is_type)
        ix.add("symbol", prefix, key, "Class" if is_type else "Function", at=where(a, b))
        for base in re.split(r",", ",".join(x for x in (d.get("bases"), d.get("more")) if x)):
            base = re.sub(r"<.*|\b(?:public|private|protected|virtual)\b", "", base).strip()
            if base and is_type:
                ix.add("extends", key, base, at=where(a, a + 1))

    def finder(kept: list[tuple[int, int, str, bool]]) -> Callable[[int], str]:
        """The key of the scope that begins last before a place and holds it, or ''."""
        kept = sorted(kept, key=lambda x: x[0])
        begins, ends = [x[0] for x in kept], []
        for x in kept:
            ends.append(max(x[1], ends[-1] if ends else 0))

        def find(at: int) -> str:
            i = bisect_right(begins, at) - 1
            while i >= 0 and ends[i] > at:
                if at < kept[i][1]:
                    return kept[i][2]
                i -= 1
            return ""

        return find

    function_at, type_at = finder([x for x in scopes if not x[3]]), finder([x for x in scopes if x[3]])
    names_at = {x[0] for x in scopes if not x[3]}

    def owner(at: int) -> str:
        return function_at(at) or FILE

    for m in re.finditer(r"(?P<obj>(?:\w+\s*(?:\.|->|::)\s*)*)\b(?P<name>\w+)\s*(?:::<[^>]*>)?\(", code):
        name = m["name"]
        before = code[max(0, m.start() - 12) : m.start()]
        if name in (CONTROL if m["obj"] else NO_CALLS) or name.isdigit() or re.search(r"\b(?:fn|func|function|class|def)\s+$", before):
            continue
        at = m.start("name")
        if at in names_at:
            continue
        obj = re.sub(r"\s*(?:->|::)\s*", ".", m["obj"].strip()).rstrip(".").strip() or None
        ix.add("call", owner(at), name, "", obj, at=where(at, m.end()))
    if language in ("JavaScript", "TypeScript"):
        for m in re.finditer(r"<(?P<name>[A-Z]\w*)[\s/>]", code):
            ix.add("call", owner(m.start()), m["name"], at=where(m.start(), m.end()))
    for m in re.finditer(g.made, code):
        if not re.search(r"(?:this|self)\s*(?:\.|->)\s*$", code[max(0, m.start() - 12) : m.start()]):
            ix.add("type", owner(m.start()), m["var"], "local", m["type"], at=where(m.start(), m.end()))
    for pattern in (*g.fields, _SET):
        for m in re.finditer(pattern, code, re.M):
            cls = type_at(m.start("var"))
            # Declarations count in a type's own block, parameters of its constructor and what methods set on the instance anywhere.
            if cls and (pattern in (_SET, _PARAMETER) or not function_at(m.start("var"))):
                ix.add("type", cls, m["var"], "field", m["type"], at=where(m.start(), m.end()))
    return ix


def parse(path: str, text: str, language: str) -> Index:
    return parse_python(path, text) if language == "Python" else parse_braces(path, text, language)


PARSERS: dict[str, Callable[[str, str, str], Index]] = {"Python": lambda p, t, _: parse_python(p, t), **{n: parse_braces for n in GRAMMARS}}


#: What reads a file that its language's parser cannot.
LOOSE: dict[str, Callable[[str, str, str], Index]] = {"Python": parse_python_loosely}


def facts(files: DataFrame) -> DataFrame:
    """Rows of facts of files (path, language, content); a file that cannot be parsed has a row with fact ``error``.

    Such a file of Python has the facts that patterns find, too. PARSERS and LOOSE may be given further languages.

    Null paths, contents and languages without a parser are left out. Files are parsed where they lie.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, language, content in zip(b["path"], b["language"], b["content"]):
                parser = PARSERS.get(language)
                if parser is None or content is None or path is None:
                    continue
                try:
                    rows += parser(path, content, language).rows
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, language, "", "error", "", type(e).__name__, "", None, None, 0, 0, 0, 0, 0))
                    rows += LOOSE[language](path, content, language).rows if language in LOOSE else []
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.astype({c: "int32" for c in COLUMNS[-5:]})

    return files.select("path", "language", "content").mapInPandas(run, FACTS)
