"""The table function: files (path, lang, text) to facts, and facts to normal tables with ids that don't depend on partitions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from arborlight.extract import braces, python_source
from arborlight.extract.packs import PACKS, Pack
from arborlight.functions.scalar import GENERATED_ENDS, GENERATED_MARKS

SYMBOL = "idx int, kind string, name string, qname string, start_line long, end_line long, exported boolean, is_test boolean, entry string, entry_cond string, decorated boolean, subclass boolean, framework_risk string, unity string, keep string, parent_idx int"
REF = "pos int, src_idx int, name string, kind string, line long, member boolean"
IMPORT = "pos int, module string, names array<string>, line long, kind string"


def _struct(ddl: str) -> str:
    return "array<struct<" + re.sub(r"(\w+) (array<string>|\w+)", r"\1:\2", ddl) + ">>"


FACTS = f"path string, lang string, is_test boolean, is_generated boolean, parse_status string, dynamic array<string>, symbols {_struct(SYMBOL)}, refs {_struct(REF)}, imports {_struct(IMPORT)}, strings array<string>"
_IDENT = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
#: An annotation in a comment, on the line of a definition or the one above, that keeps it: <tool>:keep(reason).
_KEEP = re.compile(r"\w:keep\(([^)]*)\)")


def ident_like(s: str) -> bool:
    return _IDENT.fullmatch(s) is not None and len(s.encode()) <= 64


def generated_file(path: str, text: str) -> bool:
    return path.lower().endswith(GENERATED_ENDS) or any(m in line for line in text.split("\n", 10)[:10] for m in GENERATED_MARKS)


def extract(path: str, text: str, pack: Pack) -> dict:
    """Facts of one file, whatever its state: broken files give what can be told from them and parse_status syntax-errors."""
    test = pack.is_test(path)
    found = python_source.extract(path, text, test, pack) if pack.family == "python" else braces.extract(path, text, test, pack)
    lines = text.split("\n")
    for i, s in enumerate(found["symbols"]):
        s["idx"] = i
        parent = s.get("parent_idx")
        s["is_test"] = bool(s.get("is_test")) or test or (parent is not None and found["symbols"][parent]["is_test"])
        near = lines[max(0, s["start_line"] - 2) : s["start_line"]]
        s["keep"] = next((m[1] for line in reversed(near) if (m := _KEEP.search(line))), None)
        if not s.get("entry") and s["name"] in pack.entry_names and parent is None and s["kind"] == "function":
            s["entry"] = "conventional entry point"
    names = {s["name"] for s in found["symbols"]}
    aliases = {a: n for a, n in found.get("aliases", {}).items() if a not in names}
    for r in found["refs"]:
        r["name"] = aliases.get(r["name"], r["name"])
    return {
        "path": path, "lang": pack.id, "is_test": test, "is_generated": generated_file(path, text), "parse_status": found["status"],
        "dynamic": [m for m in pack.dynamic_markers if m in text], "symbols": found["symbols"], "refs": [{**r, "pos": i} for i, r in enumerate(found["refs"])],
        "imports": [{**m, "pos": i} for i, m in enumerate(merge_imports(found["imports"]))], "strings": sorted({s for s in found["strings"] if ident_like(s)}),
    }


def merge_imports(imports: list[dict]) -> list[dict]:
    """One import for each statement and module, with its names in order."""
    out: dict[tuple, dict] = {}
    for i in imports:
        key = (i.get("stmt", id(i)), i["module"])
        held = out.setdefault(key, {"module": i["module"], "names": [], "line": i["line"], "kind": i["kind"]})
        held["names"] = sorted({*held["names"], *i["names"]})
    return list(out.values())


def extract_files(files: DataFrame, packs: dict[str, Pack] = PACKS) -> DataFrame:
    """Facts of files(path, lang, text): one row for each; a null text (too large) has status ``error`` and no facts."""
    schema = to_arrow_schema(_parse_datatype_string(FACTS))

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b = whole.slice(s, 64)
                rows = []
                for path, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if lang in packs and text is not None:
                        rows.append(extract(path, text, packs[lang]))
                    else:
                        rows.append({"path": path, "lang": lang, "is_test": False, "is_generated": False, "parse_status": "error: skipped", "dynamic": [], "symbols": [], "refs": [], "imports": [], "strings": []})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "lang", "text").mapInArrow(run, FACTS)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, refs, imports and strings; ids follow the paths' order: symbols file_id * 2^20 + idx, refs file_id * 2^24 + pos."""
    f = facts.withColumn("file_id", F.row_number().over(Window.orderBy("path")).cast("long"))
    sym = f.select("file_id", F.inline("symbols")).withColumn("sym_id", F.col("file_id") * (1 << 20) + F.col("idx"))
    refs = f.select("file_id", F.inline("refs")).withColumns({"ref_id": F.col("file_id") * (1 << 24) + F.col("pos"), "src_sym": F.when(F.col("src_idx").isNotNull(), F.col("file_id") * (1 << 20) + F.col("src_idx"))})
    imports = f.select("file_id", F.col("path").alias("file"), "lang", F.inline("imports")).withColumn("import_id", F.col("file_id") * (1 << 20) + F.col("pos"))
    return {"files": f.drop("symbols", "refs", "imports", "strings"), "symbols": sym, "refs": refs, "imports": imports, "strings": f.select("file_id", F.explode("strings").alias("name"))}
