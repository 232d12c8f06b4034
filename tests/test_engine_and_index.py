"""Hosts of engine messages over several files, and code indexes: decoded, laid over the edges, told apart when stale."""

import pytest

from arborlight.index import Store
from arborlight.operators.deadcode import dead_code
from arborlight.operators.hosts import merged_hosts
from arborlight.operators.precise import apply_index
from arborlight.sources import scip
from arborlight.sources.workspace import scan_workspace

ENGINE = {
    "Assets/A.cs": "using UnityEngine;\n\npublic class Hero : MonoBehaviour\n{\n    void Update() { }\n    void Lost() { }\n    public void Bound() { }\n    [ContextMenu(\"x\")]\n    void Menu() { }\n}\n",
    "Assets/B.cs": "public partial class Part\n{\n    void Start() { }\n}\n", "Assets/C.cs": "public partial class Part : Middle { }\n", "Assets/D.cs": "public class Middle : MonoBehaviour { }\n",
    "Assets/E.cs": "public class Far : Outside\n{\n    void Awake() { }\n}\npublic class Loop : Loop2 { void OnGUI() { } }\npublic class Loop2 : Loop { }\n",
    "Server/S.cs": "public class Plain\n{\n    void Update() { }\n}\n",
}


def graph_of(spark, root, files, store):
    for n, t in files.items():
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(t)
    return Store(spark, str(store)).update(scan_workspace(spark, str(root)), spark.createDataFrame([], "eco string, name string"))


def test_messages_are_live_where_their_host_is_proven(spark, tmp_path):
    graph = graph_of(spark, tmp_path / "p", ENGINE, tmp_path / "s")
    merged = merged_hosts(graph)
    names = {r.sym_id: r.qname for r in graph["symbols"].collect()}
    got = {(names[r.sym_id], r.live, r.unresolved_base) for r in merged.collect()}
    assert got == {("Part", True, None), ("Part.Start", True, None), ("Far.Awake", False, "Outside")}
    found = {r.symbol: r.confidence for r in dead_code(graph, merged=merged, least=0.0).collect()}
    assert "Hero.Update" not in found and "Hero.Menu" not in found and "Part.Start" not in found and found["Hero.Lost"] == 0.71 and found["Hero.Bound"] < 0.6
    assert found["Far.Awake"] <= 0.85 and found["Plain.Update"] == 0.95 and "Loop.OnGUI" in found


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def block(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def index(docs):
    out = block(1, block(2, block(1, b"maker")))
    for path, occurrences in docs.items():
        body = block(1, path.encode())
        for symbol, line, roles in occurrences:
            body += block(2, block(1, varint(line - 1) + varint(4) + varint(9)) + block(2, symbol.encode()) + varint(3 << 3) + varint(roles))
        out += block(2, body)
    return out


CODE = {
    "a.py": "def same():\n    return 1\n\n\ndef used():\n    return 2\n", "b.py": "def same():\n    return 3\n", "c.py": "import a\n\n\ndef go():\n    a.same()\n    print(1)\n",
}


def test_indexes_replace_what_names_told(spark, tmp_path):
    graph = graph_of(spark, tmp_path / "p", CODE, tmp_path / "s")
    data = index({"a.py": [("p m a/same().", 1, 1), ("p m a/used().", 5, 1)], "c.py": [("p m c/go().", 4, 1), ("p m a/same().", 5, 0), ("p x builtins/print().", 6, 0), ("local 3", 5, 0)], "gone.py": [("p m q/x().", 1, 1)]})
    (tmp_path / "index.scip").write_bytes(data)
    assert scip.discover(str(tmp_path)) == [str(tmp_path / "index.scip")]
    rows = scip.read_scip(spark, str(tmp_path / "index.scip"))
    assert rows.count() == 7 and {r.tool for r in rows.collect()} == {"maker"}
    names = {r.sym_id: (r.qname, r.file_id) for r in graph["symbols"].collect()}
    made = apply_index(graph, rows.drop("mtime"))
    found = {(names[r.src_sym][0], names[r.dst_sym], r.confidence, r.source) for r in made["edges"].collect()}
    a = next(v for v in names.values() if v[0] == "used")[1]
    assert found == {("go", ("same", a), 0.97, "scip")}
    c = made["coverage"].first()
    assert (c.documents, c.matched, c.unmatched, c.stale, c.edges_added, c.symbols_mapped) == (3, 2, 1, 0, 1, 3)
    dead = {r.symbol: (r.confidence, r.source) for r in dead_code(graph | {"edges": made["edges"]}, precise=made["precise"], precise_refs=made["precise_refs"], least=0.0).collect()}
    assert dead["used"][1] == "scip"
    stale = apply_index(graph, rows, spark.createDataFrame([("a.py", 1 << 60), ("c.py", 1)], "path string, mtime long"))["coverage"].first()
    assert (stale.matched, stale.stale) == (1, 1)
    for bad in (data[:-3], b"\x0b", b"\x0a\xff"):
        with pytest.raises(ValueError):
            list(scip.parse_index(bad))
    assert list(scip.parse_index(b"")) == []
