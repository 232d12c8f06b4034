"""Functions of paths and names: language of a file, kind of a text file, joined paths, package and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each language, in the order in which languages are tried.
LANGUAGES = {
    "csharp": [".cs"], "go": [".go"], "java": [".java"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyi"],
    "rust": [".rs"], "tsx": [".tsx"], "typescript": [".ts", ".mts", ".cts"],
}
# Files whose names are read as mentions only, and lock files that aren't.
TEXT_KINDS = {"html": "html", "htm": "html", "json": "text", "toml": "text", "yaml": "text", "yml": "text", "cfg": "text", "ini": "text"}
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "composer.lock"]

_PYPI, _CRATE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$", r"^[A-Za-z][A-Za-z0-9_-]{0,63}$"
_SEGMENT = r"[A-Za-z0-9~-][A-Za-z0-9._~-]*"
_NPM = rf"^(?:@{_SEGMENT}/)?{_SEGMENT}$"


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def language_of(path: Column) -> Column:
    """The first language with an extension that ends the file's name, in any case; null if none."""
    name, out = file_name(path), F.lit(None).cast("string")
    for language, endings in reversed(LANGUAGES.items()):
        hit = F.lit(False)
        for e in endings:
            hit = hit | name.endswith(e)
        out = F.when(hit, language).otherwise(out)
    return out


def text_kind(path: Column) -> Column:
    """html or text for files whose words count as mentions; null for others, lock files and minified code."""
    name = file_name(path)
    ending = F.element_at(F.split(name, "[.]"), -1)
    kinds = F.create_map(*[F.lit(x) for pair in TEXT_KINDS.items() for x in pair])
    locked = name.isin(LOCK_FILES) | name.endswith(".min.js") | name.endswith(".lock")
    return F.when(~locked, F.try_element_at(kinds, ending))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(F.when(path.contains("/"), path).otherwise("/"), "/[^/]*$", "")


def joined_path(base: Column, rel: Column) -> Column:
    """rel seen from the folder base, without . and ..; null where it leaves the root."""
    parts = F.filter(F.split(base, "/"), lambda s: s != "")

    def step(at, seg):
        above = F.slice(at["parts"], 1, F.greatest(F.size(at["parts"]) - 1, F.lit(0)))
        return (
            F.when(seg.isin("", "."), at)
            .when(seg == "..", F.struct(above.alias("parts"), (at["ok"] & (F.size(at["parts"]) > 0)).alias("ok")))
            .otherwise(F.struct(F.concat(at["parts"], F.array(seg)).alias("parts"), at["ok"].alias("ok")))
        )

    start = F.struct(parts.alias("parts"), F.lit(True).alias("ok"))
    return F.aggregate(F.split(rel, "/"), start, step, lambda at: F.when(at["ok"], F.array_join(at["parts"], "/")))


def valid_package(eco: Column, name: Column) -> Column:
    """Whether the ecosystem (pypi, crates.io, npm) admits the name; false for others and for null."""
    fits = F.when(eco == "pypi", name.rlike(_PYPI)).when(eco == "crates.io", name.rlike(_CRATE)).when(eco == "npm", name.rlike(_NPM) & (F.length(name) <= 214))
    return F.coalesce(fits, F.lit(False))


def symbol_name(symbol: Column) -> Column:
    """The name in an index symbol's last descriptor; null for local symbols and for what doesn't parse."""
    quoted, plain = r"`((?:[^`]|``)+)`", r"([\w+$-]+)"
    end = r"(?:[/#.:!]|\([\w+$-]*\)[.])$"
    tries = [quoted + end, plain + end, rf"\[{plain}\]$", rf"\({plain}\)$", rf"\[{quoted}\]$", rf"\({quoted}\)$"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(symbol, t, 1), F.lit("")) for t in tries])
    return F.when(~symbol.startswith("local "), F.replace(found, F.lit("``"), F.lit("`")))
