"""What the extractors know of each language, and packs that users add."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from arborlight.functions.scalar import glob_regex


@dataclass(frozen=True)
class Pack:
    """One language: its file endings, family of extractor, entry points, test paths, markers of dynamic access, registry."""

    id: str
    family: str
    extensions: tuple[str, ...]
    registry: str | None = None
    entry_names: tuple[str, ...] = ()
    dynamic_markers: tuple[str, ...] = ()
    test_globs: tuple[str, ...] = ()
    tests: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "tests", re.compile("|".join(glob_regex(g) for g in self.test_globs) or r"(?!)"))

    def is_test(self, path: str) -> bool:
        return self.tests.search(path) is not None


# Markers, entry names and test paths that decide scores and roots.
_JS_MARKS = ("eval(", "new Function(", "require(", "import(", "Reflect.", "window[", "globalThis[", "module.exports")
_JS_TESTS = ("**/__tests__/**", "**/*.test.*", "**/*.spec.*", "**/tests/**", "**/test/**", "**/*.stories.*")
PACKS = {
    p.id: p
    for p in (
        Pack("csharp", "csharp", (".cs",), None, (), ("Activator.CreateInstance", "System.Reflection", "Assembly.Load", "GetMethod(", "Type.GetType"),
             ("**/tests/**", "**/Tests/**", "**/*Tests.cs", "**/*Test.cs", "**/*.Tests/**", "**/*.Test/**")),
        Pack("go", "go", (".go",), None, ("main", "init"), ("reflect.", "plugin.Open", "go:linkname", "unsafe."), ("**/*_test.go", "**/testdata/**")),
        Pack("java", "java", (".java",), None, (), ("Class.forName", "java.lang.reflect", "ServiceLoader", "MethodHandles", "@Autowired", "@Inject"),
             ("**/src/test/**", "**/test/**", "**/*Test.java", "**/*Tests.java", "**/*IT.java")),
        Pack("javascript", "js", (".js", ".jsx", ".mjs", ".cjs"), "npm", ("main",), _JS_MARKS, _JS_TESTS),
        Pack("python", "python", (".py", ".pyi"), "pypi", ("main",),
             ("getattr", "setattr", "importlib", "__import__", "eval(", "exec(", "globals()", "locals()", "__all__"),
             ("**/tests/**", "**/test/**", "**/test_*.py", "**/*_test.py", "**/conftest.py")),
        Pack("rust", "rust", (".rs",), "crates.io", ("main",), ("dyn Any", "libloading", "dlopen", 'extern "C"', "#[no_mangle]"), ("**/tests/**", "**/benches/**", "**/examples/**")),
        Pack("tsx", "js", (".tsx",), "npm", ("main",), _JS_MARKS, _JS_TESTS),
        Pack("typescript", "js", (".ts", ".mts", ".cts"), "npm", ("main",), _JS_MARKS, _JS_TESTS),
    )
}


def load_packs(folder: str | None = None) -> dict[str, Pack]:
    """The packs here, overridden by id by those of a folder of ``<id>/pack.toml``; its family must be one that is built in."""
    out = dict(PACKS)
    for path in sorted(Path(folder).glob("*/pack.toml")) if folder else []:
        if Path(folder).resolve() not in path.resolve().parents:
            raise ValueError(f"{path} lies outside the folder of packs")
        d = tomllib.loads(path.read_text(encoding="utf-8"))
        family = {"javascript": "js", "typescript": "js", "tsx": "js"}.get(d.get("grammar", ""), d.get("grammar"))
        if family not in {p.family for p in PACKS.values()} or not d.get("id") or not d.get("extensions"):
            raise ValueError(f"{path}: needs an id, extensions and a known grammar")
        out[d["id"]] = Pack(d["id"], family, tuple(d["extensions"]), d.get("registry"), tuple(d.get("entry_names", ())), tuple(d.get("dynamic_markers", ())), tuple(d.get("test_globs", ())))
    return out


def pack_for(path: str, packs: dict[str, Pack] = PACKS) -> Pack | None:
    """The first pack with an ending that the file's name has, in any case."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((p for p in packs.values() if any(name.endswith(e) for e in p.extensions)), None)
