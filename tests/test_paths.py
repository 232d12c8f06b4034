from pyspark.sql import functions as F

from arborlight.functions import paths as P
from arborlight.sources.workspace import scan_workspace


def test_names(spark):
    rows = [("a/B.PY", "python", None), ("x.d.ts", "typescript", None), ("a.json", None, "text"), ("Cargo.lock", None, None), ("q.min.js", "javascript", None), ("noext", None, None), (None, None, None)]
    for path, lang, kind in rows:
        got = spark.createDataFrame([(path,)], "path string").select(P.language_of(F.col("path")), P.text_kind(F.col("path"))).first()
        assert tuple(got) == (lang, kind), path


def test_joined_and_symbols(spark):
    df = spark.createDataFrame([("a/b", "../c"), ("", "../c"), ("", "./x//y"), (None, "x")], "base string, rel string")
    assert [r[0] for r in df.select(P.joined_path(F.col("base"), F.col("rel"))).collect()] == ["a/c", None, "x/y", None]
    s = spark.createDataFrame([("cargo x 1 a/B#run().",), ("local 3",), ("p m v a/`x y`#",), ("p m v f().(arg)",), (None,)], "s string")
    assert [r[0] for r in s.select(P.symbol_name(F.col("s"))).collect()] == ["run", None, "x y", "arg", None]


def test_workspace(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1", "node_modules/b.js": "no", ".git/c.py": "no", "conf.toml": "k = 1", "d.bin": "?"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "big.rs").write_text("/" * (3 << 20))
    got = {r.path: r for r in scan_workspace(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "conf.toml", "big.rs"}
    assert got["src/a.py"].text == "x = 1" and got["conf.toml"].kind == "text" and got["big.rs"].text is None and got["big.rs"].status != "ok"
