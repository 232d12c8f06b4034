"""Facts of Python files: definitions from the syntax tree, or from indentation where there is none; all else from tokens."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

# Decorators that don't hand a function to a framework.
NEUTRAL = {
    "property", "staticmethod", "classmethod", "abstractmethod", "override", "overload", "cached_property", "dataclass", "total_ordering", "wraps", "setter", "getter",
    "deleter", "final", "contextmanager", "lru_cache", "cache", "unique",
}
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _last_name(node: ast.expr) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", "")


def _from_tree(tree: ast.Module) -> list[dict]:
    """Definitions in order of their start: (name, kind, line, column of the name's line, end, parent, decorators, bases)."""
    out: list[dict] = []

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            at = parent
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                bases = [ast.unparse(b) for b in [*child.bases, *child.keywords]] if isinstance(child, ast.ClassDef) else []
                out.append({"name": child.name, "kind": "class" if isinstance(child, ast.ClassDef) else "function", "line": child.lineno, "end": child.end_lineno, "parent": parent, "decorators": [_last_name(d) for d in child.decorator_list], "bases": bases})
                at = len(out) - 1
            elif parent is None and isinstance(node, ast.Module) and isinstance(child, ast.Assign | ast.AnnAssign):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        out.append({"name": t.id, "kind": "variable", "line": t.lineno, "end": child.end_lineno, "parent": None, "decorators": [], "bases": []})
            visit(child, at)

    visit(tree, None)
    return out


def _from_lines(text: str) -> list[dict]:
    """Definitions by indentation, of files that don't parse."""
    lines, out, open_ = text.split("\n"), [], []
    for m in _DEF.finditer(text):
        line, indent = text.count("\n", 0, m.start()) + 1, len(m[1].expandtabs())
        end = next((k for k in range(line, len(lines)) if lines[k].strip() and len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) <= indent), len(lines))
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        out.append({"name": m[3], "kind": "class" if m[2] == "class" else "function", "line": line, "end": end, "parent": open_[-1][1] if open_ else None, "decorators": [], "bases": []})
        open_.append((indent, len(out) - 1))
    return out


def _tokens(text: str) -> list[tokenize.TokenInfo]:
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            out.append(t)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    return out


def _guarded(tree: ast.Module) -> set[int]:
    """Lines of imports in a try whose handlers catch a missing module; not those in functions or classes inside it."""
    found: set[int] = set()

    def catches(h: ast.ExceptHandler) -> bool:
        kinds = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]
        return h.type is None or any(_last_name(k) in ("ImportError", "ModuleNotFoundError") for k in kinds)

    def inside(nodes):
        for n in nodes:
            if isinstance(n, ast.Import | ast.ImportFrom):
                found.add(n.lineno)
            elif not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inside(ast.iter_child_nodes(n))

    for node in ast.walk(tree):
        if isinstance(node, ast.Try) and any(catches(h) for h in node.handlers):
            inside(node.body)
    return found


def _imports(tokens: list[tokenize.TokenInfo], optional: set[int]) -> tuple[list[dict], dict[str, str], set[int]]:
    """Import statements by their tokens, the aliases they make, and the places of their tokens."""
    out, aliases, spans = [], {}, set()
    i, fresh = 0, True
    while i < len(tokens):
        t = tokens[i]
        if fresh and t.type == tokenize.NAME and t.string in ("import", "from"):
            j, stmt = i, []
            while j < len(tokens) and tokens[j].type not in (tokenize.NEWLINE, tokenize.ENDMARKER) and tokens[j].string != ";":
                if tokens[j].type not in (tokenize.NL, tokenize.COMMENT):
                    stmt.append(tokens[j].string)
                j += 1
            spans.update(range(i, j))
            kind, line = "optional" if t.start[0] in optional else "import", t.start[0]
            cut = stmt.index("import") if "import" in stmt else len(stmt)
            clauses = "\0".join(x for x in stmt[cut + 1 :] if x not in "()").split("\0,\0")
            if stmt[0] == "from":
                module, names = "".join(stmt[1:cut]), []
                for c in clauses:
                    parts = [p for p in c.split("\0") if p and p != ","]
                    if parts and parts[0] != "*":
                        names.append(parts[0])
                        if len(parts) == 3:
                            aliases[parts[2]] = parts[0]
                out.append({"stmt": i, "module": module, "names": names, "line": line, "kind": kind})
            else:
                for c in clauses:
                    parts = c.split("\0")
                    module = "".join(parts[: parts.index("as")] if "as" in parts else parts).strip(",")
                    if module:
                        out.append({"stmt": i, "module": module, "names": [], "line": line, "kind": kind})
                        if "as" in parts and "." not in module:
                            aliases[parts[-1]] = module
            i = j
        fresh = i < len(tokens) and (tokens[i].type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.NL, tokenize.COMMENT) or tokens[i].string in (";", ":"))
        i += 1
    return out, aliases, spans


def extract(path: str, text: str, test_file: bool, pack) -> dict:
    try:
        tree, status = ast.parse(text), "ok"
        defs, optional = _from_tree(tree), _guarded(tree)
    except (SyntaxError, ValueError, RecursionError):
        status, defs, optional = "syntax-errors", _from_lines(text), set()
    symbols: list[dict] = []
    for d in defs:
        p = symbols[d["parent"]] if d["parent"] is not None else None
        kind = "method" if d["kind"] == "function" and p and p["kind"] == "class" else d["kind"]
        name, private = d["name"], d["name"].startswith("_")
        s = {"kind": kind, "name": name, "qname": f"{p['qname']}.{name}" if p else name, "start_line": d["line"], "end_line": d["end"], "parent_idx": d["parent"]}
        s["exported"] = not private if p is None else p["exported"] and kind == "method" and not private
        if kind == "method" and name.startswith("__") and name.endswith("__") and len(name) > 4:
            s |= {"entry": "dunder method", "entry_cond": "parent"}
        s["is_test"] = test_file and p is None and kind == "function" and name.startswith("test")
        s["decorated"] = any(x not in NEUTRAL for x in d["decorators"])
        bases = defs[d["parent"]]["bases"] if kind == "method" else []
        s["subclass"] = bool(bases) and bases != ["object"]
        symbols.append(s)
    tokens = _tokens(text)
    imports, aliases, skip = _imports(tokens, optional)
    named = {(s["start_line"], s["name"]) for s in symbols}
    real = [i for i, t in enumerate(tokens) if t.type not in (tokenize.NL, tokenize.COMMENT)]
    after = dict(zip(real, real[1:], strict=False))
    before = dict(zip(real[1:], real, strict=False))
    inner = _innermost(symbols)
    refs, strings = [], []
    for i, t in enumerate(tokens):
        if t.type == tokenize.STRING:
            try:
                value = ast.literal_eval(t.string)
                strings.append(value.decode("utf-8", "replace") if isinstance(value, bytes) else value)
            except (ValueError, SyntaxError):
                continue
        elif t.type == getattr(tokenize, "FSTRING_MIDDLE", -1):
            strings.append(t.string)
        elif t.type == tokenize.NAME and i not in skip and not keyword.iskeyword(t.string):
            if (t.start[0], t.string) in named and (i not in before or tokens[before[i]].string in ("def", "class") or tokens[before[i]].type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT)):
                continue
            nxt, prev = tokens[after[i]].string if i in after else "", tokens[before[i]].string if i in before else ""
            refs.append({"name": t.string, "kind": "calls" if nxt == "(" else "references", "line": t.start[0], "member": prev == ".", "src_idx": inner(t.start[0])})
    return {"status": status, "symbols": symbols, "refs": refs, "imports": imports, "strings": strings, "aliases": aliases}


def _innermost(symbols: list[dict]):
    """line -> index of the innermost definition that covers it; variables cover theirs."""
    by_line: dict[int, int] = {}
    for i, s in enumerate(symbols):  # starts ascend and inner ones come later
        for line in range(s["start_line"], s["end_line"] + 1):
            by_line[line] = i
    return by_line.get
