"""Import resolution of all languages as one join of candidates with targets.

An import gives candidates (group, priority, space, key); the files, modules and packages of a project give targets (space,
key, files). Both sides are DataFrames, so a project of any size resolves by one equi-join: of each group the candidate of the
least priority that has a target counts, and an import with a group that counts is local. Without one, its own default holds.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlight.functions.scalar import normalize_package

# Modules that come with the languages, and what a JavaScript path may be short of.
NODE_BUILTINS = frozenset(
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process "
    "punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib test sqlite".split()
)
RUST_STD = frozenset("std core alloc proc_macro test".split())
PYTHON_STDLIB = frozenset(sys.stdlib_module_names) | {"__future__"}
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json", ".d.ts"]
JAVA_STDLIB = ("java.", "javax.", "jdk.", "sun.")
ECOSYSTEM = {"python": "pypi", "javascript": "npm", "typescript": "npm", "tsx": "npm", "rust": "crates.io"}


def lexical_join(base: str, rel: str) -> str | None:
    """rel seen from the folder base; None where it leaves the root."""
    parts = [p for p in base.split("/") if p]
    for seg in rel.split("/"):
        if seg == "..":
            if not parts:
                return None
            parts.pop()
        elif seg not in ("", "."):
            parts.append(seg)
    return "/".join(parts)


def rust_use_bindings(arg: str) -> list[str]:
    """Names that a ``use`` binds: a::b::{c, d::e, f as g, self} gives c, e, g, b; globs bind none that can be told."""
    out: list[str] = []
    word, last, stack, alias = "", "", [], False
    for token in [*re.findall(r"\w+|::|[{},*]", arg), ","]:
        if token == "{":
            stack.append(last)
            word = last = ""
        elif token in ",}":
            bound = (stack[-1] if stack else "") if word == "self" and stack else word
            if bound:
                out.append(bound)
            word, alias = "", False
            if token == "}" and stack:
                last = stack.pop()
        elif token == "::":
            last, word = word or last, ""
        elif token == "*":
            word = ""
        elif token == "as":
            alias = True
        else:
            word = token
    return out


def _js_keys(stem: str) -> list[str]:
    stems = [stem, *[stem[: -len(e)] for e in (".js", ".jsx", ".mjs", ".cjs") if stem.endswith(e)]]
    return [k for s in stems for k in [s + e for e in JS_ENDINGS] + [f"{s}/index{e}" for e in JS_ENDINGS[1:]]]


def candidates(file: str, lang: str, module: str, names: list[str], kind: str) -> tuple[str, str | None, list[tuple[int, int, str, str]]]:
    """(class without a target, its package, [(group, priority, space, key)])."""
    folder, m = file.rpartition("/")[0], module
    listed = lambda group, space, keys: [(group, i, space, k) for i, k in enumerate(keys)]
    if lang == "python":
        if m.startswith("."):
            rest = m.lstrip(".")
            base = folder
            for _ in range(len(m) - len(rest) - 1):
                base = base.rpartition("/")[0]
            at = lambda rel: "/".join(x for x in (base, rel) if x)
            rel = rest.replace(".", "/")
            tries = lambda stem: [f"{stem}.py", f"{stem}.pyi", f"{stem}/__init__.py"]
            out = listed(0, "path", tries(at(rel)) if rel else [at("__init__.py")])
            for g, n in enumerate(names, 1):
                out += listed(g, "path", tries(at(f"{rel}/{n}" if rel else n)))
            return ("local" if not rel and not names else "unresolved"), None, out
        first = m.split(".")[0]
        out = [(0, 0, "pymod", m), (0, 1, "pydir", m)] + [(g, 0, "pymod", f"{m}.{n}") for g, n in enumerate(names, 1)]
        if first in PYTHON_STDLIB:
            return "stdlib", None, out
        return "external", first, [*out, (len(names) + 1, 0, "package", first.lower().replace("_", "-").replace(".", "-"))]
    if ECOSYSTEM.get(lang) == "npm":
        if m.startswith(("http://", "https://", "data:")):
            return "url", None, []
        if m in (".", "..") or m.startswith(("./", "../")):
            joined = lexical_join(folder, m)
            if joined is None:
                return "unresolved", None, []
            keys = listed(0, "path", _js_keys(joined) + [f"{joined}/index{e}".lstrip("/") for e in JS_ENDINGS[1:]])
            return "unresolved", None, [*keys, (0, len(keys), "folder", joined)]
        if m.startswith("node:"):
            return "stdlib", None, []
        if m.startswith(("/", "@/", "~", "#", "$")):
            return "alias", None, []
        package = "/".join(m.split("/")[: 2 if m.startswith("@") else 1])
        if package in NODE_BUILTINS:
            return "stdlib", None, []
        rest = listed(0, "path", _js_keys(m)) if "/" in m and not m.startswith("@") else []
        return "external", package, [(0, -1, "npm package", package), *rest]
    if lang == "rust":
        m = m.removeprefix("::")
        if kind == "mod":
            stem, top = file.rpartition("/")[2].removesuffix(".rs"), folder.rpartition("/")[2]
            root = stem in ("mod", "lib", "main") or file.endswith("build.rs") or top in ("tests", "benches", "examples") or folder.endswith("src/bin")
            base = folder if root else "/".join(x for x in (folder, stem) if x)
            at = "/".join(x for x in (base, m) if x)
            return "unresolved", None, listed(0, "path", [f"{at}.rs", f"{at}/mod.rs"])
        first = re.split(r"[:{;,]", m, maxsplit=1)[0].strip()
        if not first or first[0].isupper():
            return "local", None, []
        if first in ("crate", "self", "super"):
            segments = [s.strip() for s in m.split("::") if s.strip() not in ("crate", "self", "super", "*") and not s.strip().startswith("{")]
            return "local", None, listed(0, "rust", ["/".join(segments[:n]) for n in range(len(segments), 0, -1)])
        if first in RUST_STD:
            return "stdlib", None, []
        return "external", first, [(0, 0, "rust module", first), (0, 1, "package", first.lower().replace("_", "-")), (0, 2, "bound", f"{file}|{first}")]
    if lang == "go":
        parts = m.split("/")
        default = "external" if "." in parts[0] else "stdlib"
        return default, m if default == "external" else None, listed(0, "go folder", ["/".join(parts[i:]) for i in range(len(parts)) if parts[i]])
    if lang == "java":
        rel = m.replace(".", "/")
        return "stdlib" if m.startswith(JAVA_STDLIB) else "external", None, [(0, 0, "java file", f"{rel}.java"), (0, 1, "java folder", rel)]
    return "stdlib" if m == "System" or m.startswith(("System.", "Microsoft.")) else "external", None, []


def _suffixes(path: Column, sep: str, join: str | None = None) -> Column:
    parts = F.split(path, f"[{sep}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), join or sep))


def targets(files: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(space, key, found) of files(path, lang), imports(file, lang, module, names, kind) and local packages(eco, name)."""
    folder = F.regexp_replace(F.when(F.col("path").contains("/"), F.col("path")).otherwise("/"), "/[^/]*$", "")
    f = files.select("path", "lang", folder.alias("dir"))
    none = F.array().cast("array<string>")
    one = F.array("path")
    py = f.where("lang = 'python'").withColumn("stem", F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), "(^|/)__init__$", ""))
    modules = py.where("stem <> ''").select("path", F.explode(_suffixes(F.col("stem"), "/", ".")).alias("key")).groupBy("key").agg(F.array(F.min("path")).alias("found"))
    folders = py.select("dir").distinct().where("dir <> ''").select(F.explode(_suffixes(F.col("dir"), "/", ".")).alias("key")).distinct()
    above = f.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("key")).distinct()
    rust = f.where("lang = 'rust'").withColumn("stem", F.regexp_replace("path", r"(/mod)?\.rs$", ""))
    rust = rust.select("path", F.explode(_suffixes(F.col("stem"), "/")).alias("key")).groupBy("key").agg(F.array(F.min("path")).alias("found"))
    go = f.where("path like '%.go'").groupBy(F.col("dir").alias("key")).agg(F.array_sort(F.collect_list(F.when(~F.col("path").endswith("_test.go"), F.col("path")))).alias("found"))
    java = f.where("path like '%.java'")
    java_files = java.select("path", F.explode(_suffixes(F.col("path"), "/")).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("found"))
    java_dirs = java.select("path", F.explode(_suffixes(F.col("dir"), "/")).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("found"))
    rust_imports = imports.where("lang = 'rust'")
    mods = rust.select(F.element_at(F.split("key", "/"), -1).alias("key")).unionByName(rust_imports.where("kind = 'mod'").select(F.col("module").alias("key"))).distinct()
    bound = rust_imports.where("kind = 'import'").select(F.explode("names").alias("n"), "file").select(F.concat("file", F.lit("|"), "n").alias("key")).distinct()
    named = packages.where("name is not null")
    spaces = [
        ("path", f.select(F.col("path").alias("key"), one.alias("found"))), ("pymod", modules), ("pydir", folders), ("folder", above), ("rust", rust), ("go folder", go), ("java file", java_files), ("java folder", java_dirs),
        ("rust module", mods), ("bound", bound), ("package", named.select(normalize_package(F.col("name")).alias("key")).distinct()), ("npm package", named.where("eco = 'npm'").select(F.col("name").alias("key")).distinct()),
    ]
    out = None
    for space, df in spaces:
        part = df.select(F.lit(space).alias("space"), "key", (F.col("found") if "found" in df.columns else none).alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """imports(import_id, file, lang, module, names, line, kind, ...) with class, resolved_files and package.

    class: local, stdlib, external, unresolved, alias or url. Of paths that share a suffix the least counts.
    """
    kind = "import_id long, default_class string, default_package string, tries array<struct<grp:int,prio:int,space:string,key:string>>"
    one = pa.struct([("grp", pa.int32()), ("prio", pa.int32()), ("space", pa.string()), ("key", pa.string())])
    schema = pa.schema([("import_id", pa.int64()), ("default_class", pa.string()), ("default_package", pa.string()), ("tries", pa.list_(one))])

    def run(batches):
        for b in batches:
            rows = []
            for i, *rest in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                c, p, tries = candidates(rest[0], rest[1], rest[2], rest[3] or [], rest[4])
                rows.append({"import_id": i, "default_class": c, "default_package": p, "tries": [dict(zip(("grp", "prio", "space", "key"), t, strict=True)) for t in tries]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    made = imports.select("import_id", "file", "lang", "module", "names", "kind").mapInArrow(run, kind)
    met = made.select("import_id", F.inline("tries")).join(targets(files, imports, packages), ["space", "key"])
    best = met.groupBy("import_id", "grp").agg(F.min_by("found", "prio").alias("found"))
    best = best.groupBy("import_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("resolved_files"))
    out = imports.join(made.drop("tries"), "import_id").join(best, "import_id", "left")
    local = F.col("resolved_files").isNotNull()
    return out.withColumns({
        "class": F.when(local, "local").otherwise(F.col("default_class")), "package": F.when(~local, F.col("default_package")),
        "resolved_files": F.coalesce("resolved_files", F.array().cast("array<string>")),
    }).drop("default_class", "default_package")
