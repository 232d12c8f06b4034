"""Facts of JavaScript, TypeScript, Rust, Go, Java and C#: comments and strings are blanked, braces matched, and definitions found by their heads.

There is no grammar here: a head that a pattern doesn't foresee is missed, and code in unusual shapes can be told wrongly. Each
language's heads are in its own function; scopes, references, imports and strings are shared.
"""

from __future__ import annotations

import re

from arborlight.extract import engine

_LEX = {
    "js": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "rust": r"//[^\n]*|/\*.*?\*/|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^']*|[^'\\\n])'",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'",
    "java": r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "csharp": r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\$?@\$?\"(?:\"\"|[^\"])*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
}
_LEX = {k: re.compile(v, re.S) for k, v in _LEX.items()}
_KEYWORDS = {
    "js": "abstract any as async await boolean break case catch class const constructor continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let namespace never new null number of private protected public readonly return set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new null package private protected public return short static super switch synchronized this throw throws transient true false try void volatile while var record",
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get goto if implicit in int interface internal is lock long namespace new null object operator out override params partial private protected public readonly record ref return sbyte sealed set short static string struct switch this throw true try typeof uint ulong unsafe ushort using value var virtual void volatile where while yield",
}
_KEYWORDS = {k: frozenset(v.split()) for k, v in _KEYWORDS.items()}
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_IDENT = re.compile(_NAME)
# Methods that engines and protocols call by name, and attributes that hand nothing to a framework.
JS_LIFECYCLE = {"toString", "toJSON", "valueOf", "then", "catch", "finally", "render", "componentDidMount", "componentDidUpdate", "componentWillUnmount", "ngOnInit", "ngOnDestroy"}
GO_METHODS = {"String", "Error", "Len", "Less", "Swap", "ServeHTTP", "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText", "Read", "Write", "Close", "Unwrap", "Is", "As", "Format", "Scan", "Value", "Push", "Pop", "Seek", "ReadFrom", "WriteTo"}
RUST_NEUTRAL = {"derive", "doc", "allow", "warn", "deny", "forbid", "cfg", "cfg_attr", "inline", "must_use", "deprecated", "rustfmt", "non_exhaustive", "repr", "expect", "automatically_derived", "track_caller", "cold", "test", "bench", "ignore", "should_panic", "feature", "macro_use"}
RUST_ENTRIES = {"no_mangle", "export_name", "proc_macro", "proc_macro_derive", "proc_macro_attribute", "used"}
TYPES = ("class", "struct", "interface", "enum", "trait")
NEUTRAL_ANNOTATIONS = {"Override", "SuppressWarnings", "Deprecated", "FunctionalInterface", "SafeVarargs", "Nullable", "NonNull", "NotNull", "Obsolete", "Serializable", "Flags", "MethodImpl", "Pure", "DebuggerDisplay"}
TEST_ANNOTATIONS = {"Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Before", "After", "Fact", "Theory", "TestCase", "TestMethod", "DataTestMethod", "SetUp", "TearDown", "TestClass", "TestFixture"}


class Source:
    """A text with its code (comments and strings blanked, same length), its strings, line numbers and matched brackets."""

    def __init__(self, text: str, family: str):
        self.text, self.family, self.strings = text, family, []
        parts, at = [], 0
        for m in _LEX[family].finditer(text):
            s = m[0]
            parts.append(text[at : m.start()])
            blank = re.sub(r"[^\n]", " ", s)
            if not s.startswith(("//", "/*")):
                body = s.lstrip("@$brf#").strip("\"'`#")
                self.strings.append((m.start(), body))
                if s[0] == "`" and family == "js":  # code inside a template stays code
                    blank = list(blank)
                    for c in re.finditer(r"\$\{([^{}]*)\}", s):
                        blank[c.start(1) : c.end(1)] = c[1]
                    blank = "".join(blank)
                elif family == "rust":  # names captured by a format string
                    for c in re.finditer(r"(?<!\{)\{([^\W\d]\w*)[:}]", s):
                        blank = blank[: c.start(1)] + c[1] + blank[c.end(1) :]
            parts.append(blank)
            at = m.end()
        self.code = "".join([*parts, text[at:]])
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match: dict[int, int] = {}
        open_: list[int] = []
        self.depth_at: list[tuple[int, int]] = []
        self.balanced = True
        for m in re.finditer(r"[{}()\[\]]", self.code):
            if m[0] in "{([":
                open_.append(m.start())
            elif open_ and self.code[open_[-1]] + m[0] in ("{}", "()", "[]"):
                self.match[open_.pop()] = m.start()
            else:
                self.balanced = False
        self.balanced = self.balanced and not open_

    def line(self, at: int) -> int:
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo + 1

    def body(self, at: int, stop: str = ";") -> tuple[int, int]:
        """From a head's end: (start of the braces or -1, end of the definition); brackets in between are skipped."""
        code, n = self.code, len(self.code)
        while at < n:
            c = code[at]
            if c == "{":
                return at, self.match.get(at, n - 1)
            if c in stop:
                return -1, at
            if c in "([" and at in self.match:
                at = self.match[at]
            at += 1
        return -1, n - 1


def _def(src: Source, at: int, name: str, kind: str, head_end: int, stop: str = ";", **more) -> dict:
    start, end = src.body(head_end, stop)
    return {"at": at, "name": name, "kind": kind, "open": start, "close": end, **more}


def _inside(defs: list[dict], at: int, kinds=TYPES) -> dict | None:
    held = [d for d in defs if d["kind"] in kinds and d["open"] >= 0 and d["open"] < at < d["close"]]
    return max(held, key=lambda d: d["open"], default=None)


def _members(src: Source, owner: dict, pattern: re.Pattern):
    """Matches of the pattern directly in the owner's braces, bodies of its members left out."""
    at = owner["open"] + 1
    while m := pattern.search(src.code, at, owner["close"]):
        brace = next((b for b in sorted(src.match) if at <= b <= m.start() and src.code[b] in "{([" and src.match[b] > m.start()), None)
        if brace is not None:
            at = src.match[brace] + 1
            continue
        yield m
        at = m.end()


def _js(src: Source) -> list[dict]:
    code, defs = src.code, []
    head = r"(?P<pre>(?:\b(?:export|default|declare|abstract|async)\s+)*)"
    for m in re.finditer(head + rf"\bfunction\b\s*\*?\s*(?P<name>{_NAME})", code):
        defs.append(_def(src, m.start("name"), m["name"], "function", m.end(), exported="export" in m["pre"]))
    for kind, word in (("class", "class"), ("interface", "interface"), ("enum", r"(?:const\s+)?enum"), ("type", "type")):
        for m in re.finditer(head + rf"\b{word}\s+(?P<name>{_NAME})(?P<rest>[^{{;=]*)", code):
            if kind == "type" and not re.match(r"\s*(?:<[^;]*?>)?\s*=", code[m.end("name") :]):
                continue
            if m["name"] not in _KEYWORDS["js"]:
                defs.append(_def(src, m.start("name"), m["name"], kind, m.end(), ";\n" if kind == "type" else ";", exported="export" in m["pre"], bases=bool(re.search(r"\b(?:extends|implements)\b", m["rest"])) and kind == "class"))
    depth, top = 0, []
    for i, c in enumerate(code):
        depth += (c in "{([") - (c in "})]")
        if depth == 0 and c in "clv":
            top.append(i)
    for m in re.finditer(head + rf"\b(?:const|let|var)\s+(?P<name>{_NAME})", code):
        word = code.rfind(re.search(r"const|let|var", m[0])[0], m.start(), m.start("name"))
        if word in set(top):
            arrow = re.match(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", code[m.end() :])
            defs.append(_def(src, m.start("name"), m["name"], "function" if arrow else "variable", m.end(), ";", exported="export" in m["pre"]))
    method = re.compile(rf"(?P<mod>(?:\b(?:static|async|get|set|public|private|protected|readonly|abstract|override|declare)\s+)*)\*?\s*(?P<name>#?(?:{_NAME}))\s*(?:<[^<>(){{}};]*>)?\s*\(")
    for owner in [d for d in defs if d["kind"] == "class" and d["open"] >= 0]:
        for m in _members(src, owner, method):
            close = src.match.get(m.end() - 1)
            if m["name"] in _KEYWORDS["js"] - {"constructor", "get", "set", "of", "from", "type", "is"} or close is None or not re.match(r"\s*(?::[^;{}]+)?\{", code[close + 1 :]):
                continue
            extra = {"entry": "constructor", "entry_cond": "parent"} if m["name"] == "constructor" else {"entry": "well-known method", "entry_cond": "parent"} if m["name"] in JS_LIFECYCLE else {}
            defs.append(_def(src, m.start("name"), m["name"], "method", close + 1, subclass=owner["bases"], **extra))
    for d in defs:
        if d["kind"] == "method":
            owner = _inside(defs, d["at"], ("class",))
            d["exported"] = bool(owner and owner.get("exported")) and not d["name"].startswith(("_", "#"))
    return defs


def _rust(src: Source, path: str) -> list[dict]:
    code, defs = src.code, []
    vis = r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?"
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "union": "struct", "trait": "trait", "type": "type", "const": "const", "static": "const", "mod": "module"}
    for m in re.finditer(vis + r"(?:\b(?:async|unsafe|default|const|extern(?:\s*\"[^\"]*\")?)\s+)*?\b(?P<word>fn|struct|enum|union|trait|type|const|static|mod)\s+(?:mut\s+)?(?P<name>[^\W\d]\w*)", code):
        if m["name"] in _KEYWORDS["rust"] or (m["word"] == "mod" and re.match(r"\s*;", code[m.end() :])):
            continue
        defs.append(_def(src, m.start("name"), m["name"], kinds[m["word"]], m.end(), exported=(m["vis"] or "").strip() == "pub", attrs=_attributes(src, m.start()), line_at=m.start(), unsafe="unsafe" in m[0]))
    for m in re.finditer(r"\bmacro_rules!\s*(?P<name>\w+)", code):
        defs.append(_def(src, m.start("name"), m["name"], "macro", m.end(), exported=False, attrs=_attributes(src, m.start()), line_at=m.start()))
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>(?=\s))?(?P<head>[^{;]*)\{", code, re.M):
        parts = re.split(r"\bfor\b", re.sub(r"\bwhere\b.*", "", m["head"], flags=re.S))
        of = re.split(r"[<\s]", parts[-1].strip().lstrip("&"))[0].split("::")[-1]
        at = m.start("head") + m["head"].rfind(of) if of else m.start("head")
        defs.append({"at": at, "name": "" if len(parts) > 1 else of, "type": of, "trait": len(parts) > 1, "kind": "impl", "open": m.end() - 1, "close": src.match.get(m.end() - 1, len(code) - 1), "exported": False, "attrs": [], "line_at": m.start(), "entry": "impl block", "entry_cond": f"type:{of}"})
    main_file = path.rsplit("/", 1)[-1] in ("main.rs", "build.rs") or "/bin/" in f"/{path}"
    for d in defs:
        heads = [re.match(r"[\w:]*", a)[0] for a in d["attrs"]]
        d["is_test"] = any(a in ("test", "bench", "test_case") or a.endswith("::test") for a in heads) or any(re.match(r"cfg\s*\(\s*test\b", a) for a in d["attrs"])
        d["decorated"] = any(a.split("::")[-1] not in RUST_NEUTRAL | RUST_ENTRIES for a in heads)
        if any(re.sub(r"^unsafe\(|\)$", "", a) in RUST_ENTRIES for a in heads):
            d["entry"] = "exported by an attribute"
        if d["kind"] == "function":
            owner = _inside(defs, d["at"], ("impl", "trait", "function"))
            if owner and owner["kind"] == "impl":
                d |= {"kind": "method", "qname": f"{owner['type']}::{d['name']}"}
                if owner["trait"]:
                    d |= {"entry": "trait impl method", "entry_cond": f"type:{owner['type']}", "exported": False}
            elif owner and owner["kind"] == "trait":
                d |= {"kind": "method", "entry": "trait default method", "entry_cond": "parent"}
            elif owner is None and d["name"] == "main":
                d["entry"] = "binary entry point" if main_file else None
                d["no_convention"] = not main_file
    return defs


def _attributes(src: Source, at: int) -> list[str]:
    """Rust attributes right above a place: what stands in #[...]."""
    out, line = [], src.line(at) - 1
    while line > 0:
        row = src.text[src.starts[line - 1] : src.starts[line]].strip()
        if row.startswith("#["):
            out.append(row[2:].rstrip().removesuffix("]"))
        elif not row.startswith("//"):
            break
        line -= 1
    return out


def _go(src: Source) -> list[dict]:
    code, defs = src.code, []
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(?P<recv>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*[\[(]", code, re.M):
        kind = "method" if m["recv"] else "function"
        d = _def(src, m.start("name"), m["name"], kind, m.end() - 1, "\n", exported=m["name"][:1].isupper())
        if m["recv"]:
            d["qname"] = f"{m['recv']}.{m['name']}"
        d |= {"entry": "well-known interface method"} if kind == "method" and m["name"] in GO_METHODS else {"entry": "init function"} if kind == "function" and m["name"] == "init" else {}
        defs.append(d)
    for m in re.finditer(r"(?:^type\s+|^\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<of>struct|interface|[\w.*\[\]]+)", code, re.M):
        group = m[0].startswith("\t")
        opened = [o for o in re.finditer(r"^type\s*\(", code, re.M) if o.start() < m.start() < src.match.get(o.end() - 1, 0)]
        if not group or opened:
            kind = {"struct": "struct", "interface": "interface"}.get(m["of"], "type")
            defs.append(_def(src, m.start("name"), m["name"], kind, m.end("of"), "\n", exported=m["name"][:1].isupper()))
    for m in re.finditer(r"^const\s+(?P<name>\w+)", code, re.M):
        defs.append(_def(src, m.start("name"), m["name"], "const", m.end(), "\n", exported=m["name"][:1].isupper()))
    for o in re.finditer(r"^const\s*\(", code, re.M):
        for m in re.finditer(r"^\s+(?P<name>[^\W\d]\w*)", code[: src.match.get(o.end() - 1, o.end())][o.end() :], re.M):
            at = o.end() + m.start("name")
            defs.append(_def(src, at, m["name"], "const", at + len(m["name"]), "\n)", exported=m["name"][:1].isupper()))
    return defs


def _classlike(src: Source, family: str) -> list[dict]:
    code, defs = src.code, []
    words = {"class": "class", "interface": "interface", "enum": "enum", "record": "class", "@interface": "interface"} if family == "java" else {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "class"}
    mods = r"(?P<mods>(?:\b(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|async|override|virtual|new|extern|unsafe|synchronized|native|default|strictfp|ref)\s+)*)"
    for m in re.finditer(mods + r"(?<![\w.])(?P<word>@interface|class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>[^\W\d]\w*)(?P<rest>[^{;]*)", code):
        word = m["word"].split()[0]
        if word in words and m["name"] not in _KEYWORDS[family]:
            bases = re.search(r"\b(?:extends|implements)\b", m["rest"]) if family == "java" else re.search(r"(?<!:):(?!:)", re.sub(r"\([^)]*\)", "", m["rest"]))
            after = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"\bwhere\b.*", "", m["rest"][bases.end() :], flags=re.S))) if bases else ""
            named = [re.split(r"[.:]", re.sub(r"\(.*", "", b).strip())[-1].strip() for b in after.split(",")]
            defs.append(_def(src, m.start("name"), m["name"], words[word], m.end("name"), mods=m["mods"].split(), bases=bool(bases), base_names=[b for b in named if b], annotations=_annotations(src, m.start()), line_at=m.start()))
    method = re.compile(mods + r"(?P<type>(?:[^\W\d][\w.]*(?:\s*<[^;{}()]*>)?(?:\s*\[[\s,]*\])*\??\s+)?)(?P<name>[^\W\d]\w*)\s*(?:<[\w\s,]*>)?\s*\(")
    for owner in [d for d in defs if d["open"] >= 0]:
        for m in _members(src, owner, method):
            close = src.match.get(m.end() - 1)
            built = m["name"] == owner["name"]
            if close is None or m["name"] in _KEYWORDS[family] or m["type"].strip() in ("return", "new", "throw", "else", "await", "in") or not (m["type"].strip() or built):
                continue
            if not re.match(r"\s*(?:throws\s[\w.,\s]+|where\s[^{;]*|:\s*(?:base|this)\s*\([^)]*\)\s*)?(?:\{|;|=>|default\b)", code[close + 1 :]):
                continue
            defs.append(_def(src, m.start("name"), m["name"], "method", close + 1, mods=m["mods"].split(), built=built, base_names=[], type=m["type"].strip(), annotations=_annotations(src, m.start()), line_at=m.start()))
    for d in defs:
        owner, public = _inside(defs, d["at"]), "public" in d["mods"]
        up = []
        while owner:
            up.append(owner)
            owner = _inside(defs, owner["at"])
        member = public or "protected" in d["mods"] or (up and up[0]["kind"] == "interface")
        d["exported"] = public if not up else bool(member) and "public" in up[-1]["mods"]
        names = d["annotations"]
        d["is_test"] = any(a in TEST_ANNOTATIONS for a in names)
        d["decorated"] = any(a not in NEUTRAL_ANNOTATIONS | TEST_ANNOTATIONS for a in names)
        if d["kind"] == "method":
            d["subclass"] = bool(up and up[0]["bases"])
            if d["built"]:
                d |= {"entry": "constructor", "entry_cond": "parent"}
            elif "override" in d["mods"] or "Override" in names:
                d["entry"] = "override"
            elif d["name"].lower() == "main" and "static" in d["mods"]:
                d["entry"] = "program entry point"
            elif family == "java" and d["name"] in ("readObject", "writeObject", "readResolve", "writeReplace"):
                d["entry"] = "serialization hook"
        if not d.get("entry") and family == "java" and d["decorated"]:
            d["entry"] = "annotated: a framework may use it"
    return defs


def _top(src: Source, at: int) -> int:
    """The line on which the annotations right above a head begin: a definition starts there."""
    line, mark = src.line(at), "@" if src.family == "java" else "["
    while line > 1 and src.text[src.starts[line - 2] : src.starts[line - 1]].strip().startswith(mark):
        line -= 1
    return line


def _annotations(src: Source, at: int) -> list[str]:
    """Names of the annotations (@X, [X]) before a head, on its line or right above."""
    out, line = [], src.line(at)
    row = src.text[src.starts[line - 1] : at]
    while True:
        found = re.findall(r"@(?:[\w.]*\.)?(\w+)", row) if src.family == "java" else [x for b in re.findall(r"\[([^\]]*)\]", row) for x in re.findall(r"(?:^|,)\s*(?:\w+:\s*)?(?:[\w.]*\.)?(\w+)", re.sub(r"\([^)]*\)", "", b))]
        out += [x for x in found if x != "interface"]
        line -= 1
        row = src.text[src.starts[line - 1] : src.starts[line]].strip() if line > 0 else ""
        if not (row.startswith("@") if src.family == "java" else row.startswith("[")):
            return out


_IMPORTS = {
    "js": re.compile(r"\b(?:import|export)\b(?P<what>[^;'\"`]*?)\bfrom\s*(?P<m>['\"])|\bimport\s*(?P<m2>['\"])|\b(?P<call>require|import)\s*\(\s*(?P<m3>['\"`])"),
    "rust": re.compile(r"(?:^|(?<=[;{}]))\s*(?P<pub>pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<use>[^;]+);|mod\s+(?P<mod>\w+)\s*;|extern\s+crate\s+(?P<crate>\w+)[^;]*;)", re.M),
    "go": re.compile(r"^import\s*(?:\((?P<block>[^)]*)\)|(?:[\w.]+\s+)?(?P<one>[\"`]))", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+)(?:\.\*)?\s*;", re.M),
    "csharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<m>[\w.]+)\s*;", re.M),
}


def _imports(src: Source) -> tuple[list[dict], dict[str, str], list[tuple[int, int]]]:
    """Imports, aliases, and the stretches of code that they take."""
    from arborlight.operators.resolve import rust_use_bindings

    text_at = dict(src.strings)
    out, aliases, spans = [], {}, []
    # opening quotes are blanked with their strings: put back what patterns need to see
    seen = list(src.code)
    for at, _ in src.strings:
        seen[at] = src.text[at]
    seen = "".join(seen)
    for m in _IMPORTS[src.family].finditer(seen):
        at = src.line(m.start() + len(m[0]) - len(m[0].lstrip()))
        row = {"stmt": m.start(), "line": at, "names": [], "kind": "import"}
        spans.append(m.span())
        if src.family == "js":
            q = next(m.start(g) for g in ("m", "m2", "m3") if m[g])
            row |= {"module": text_at.get(q, ""), "kind": "require" if m["call"] == "require" else "import"}
            for part in re.findall(r"\{([^}]*)\}", m["what"] or ""):
                for item in filter(None, (x.strip() for x in part.split(","))):
                    words = item.removeprefix("type ").split()
                    row["names"].append(words[0])
                    if len(words) == 3 and words[1] == "as" and m[0].startswith("import"):
                        aliases[words[2]] = words[0]
            if m[0].startswith("export"):
                spans.pop()
        elif src.family == "rust":
            if m["use"]:
                row |= {"module": re.sub(r"\s+", "", m["use"]).replace("as", " as ") if " as " not in m["use"] else re.sub(r"\s+", " ", m["use"]).strip(), "names": rust_use_bindings(m["use"])}
                row["module"] = re.sub(r"\s+", " ", m["use"]).strip()
            else:
                row |= {"module": m["mod"] or m["crate"], "kind": "mod" if m["mod"] else "extern_crate"}
        elif src.family == "go":
            stretch = (m.start("block"), m.end("block")) if m["block"] is not None else (m.start("one"), m.start("one") + 1)
            out += [{**row, "stmt": q, "line": src.line(q), "module": s} for q, s in src.strings if stretch[0] <= q < stretch[1]]
            continue
        else:
            row["module"] = m["m"]
            row["names"] = [m["m"].rsplit(".", 1)[-1]] if src.family == "java" else []
        if row["module"]:
            out.append(row)
    return out, aliases, spans


def extract(path: str, text: str, test_file: bool, pack) -> dict:
    src = Source(text, pack.family)
    defs = {"js": _js, "go": _go}[pack.family](src) if pack.family in ("js", "go") else _rust(src, path) if pack.family == "rust" else _classlike(src, pack.family)
    first: dict[int, dict] = {}
    for d in defs:  # one definition for a name's place, a variable last
        if d["at"] not in first or first[d["at"]]["kind"] == "variable":
            first[d["at"]] = d
    defs = sorted(first.values(), key=lambda d: (d.get("line_at", d["at"]), -d["close"]))
    symbols, open_ = [], []
    sep = "::" if pack.family == "rust" else "."
    for i, d in enumerate(defs):
        while open_ and defs[open_[-1]]["close"] < d["at"]:
            open_.pop()
        parent = next((j for j in reversed(open_) if defs[j]["open"] >= 0 and defs[j]["open"] < d["at"] <= defs[j]["close"]), None)
        qname = d.get("qname") or (f"{symbols[parent]['qname']}{sep}{d['name']}" if parent is not None and symbols[parent]["qname"] else d["name"])
        s = {"kind": d["kind"], "name": d["name"], "qname": qname, "start_line": _top(src, d["line_at"]) if "annotations" in d else src.line(d["at"]), "end_line": src.line(max(d["at"], min(d["close"], len(text) - 1))), "parent_idx": parent}
        s |= {k: d.get(k) for k in ("exported", "is_test", "entry", "entry_cond", "decorated", "subclass")}
        s |= {k: bool(s[k]) for k in ("exported", "is_test", "decorated", "subclass")}
        symbols.append(s)
        if d["open"] >= 0 or d["kind"] == "variable":
            open_.append(i)
    if pack.family == "csharp":
        engine.annotate(symbols, defs, path, src.code)
    imports, aliases, spans = _imports(src)
    places = {d["at"] for d in defs if d["name"]}
    keywords, refs = _KEYWORDS[pack.family], []
    order = sorted(range(len(defs)), key=lambda i: defs[i]["at"])
    live: list[int] = []
    k = 0
    for m in _IDENT.finditer(src.code):
        at, name = m.start(), m[0]
        while k < len(order) and defs[order[k]]["at"] <= at:
            live.append(order[k])
            k += 1
        live = [i for i in live if defs[i]["close"] >= at]
        if at in places or name in keywords or any(a <= at < b for a, b in spans):
            continue
        rest = src.code[m.end() : m.end() + 2]
        before = src.code[max(0, at - 24) : at].rstrip()
        call = rest.lstrip().startswith("(") or rest.startswith("!") or before.endswith("new") or src.code[m.end() : m.end() + 3] == "::<"
        refs.append({"name": name, "kind": "calls" if call else "references", "line": src.line(at), "member": before.endswith(".") and not before.endswith(".."), "src_idx": live[-1] if live else None})
    strings = [s for _, s in src.strings]
    return {"status": "ok" if src.balanced else "syntax-errors", "symbols": symbols, "refs": refs, "imports": imports, "strings": strings, "aliases": aliases}
