"""The pipeline over awkward rows."""

from collections import Counter

import corpus_pipeline
from arborlight.llm import mixing
from arborlight.llm.queries import queries


def test_stages(spark, docs, none, tmp_path):
    first = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (first, none.select(first.columns)):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            path = f"{tmp_path}/{name}-{start.count()}"
            out.write.mode("overwrite").parquet(path)
            after = spark.read.parquet(path)
            if name == "language_id" and table is first:
                assert {300, 301, 302}.isdisjoint(r.doc_id for r in after.collect())
            if name == "minhash_near_dedup" and start is first:
                ids = [r.doc_id for r in after.collect()]
                assert sum(i is not None and 100 <= i <= 200 for i in ids) == 1
            if name != "bpe":
                assert after.columns == first.columns
            table = after
        assert set(table.columns) >= {"doc_id", "n_tokens"}


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries()] == [f"op{n}" for n in range(1, 11)]


def test_mixture_takes_each_row_as_often_as_planned(spark):
    text = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    rows = [(None, text("a", 120), "en", "s0", 1), (None, text("b", 120), "en", "s0", 1), (None, text("c", 50), "en", None, 1)]
    rows += [(7, text(f"r{k}", 90), "en", f"s{k % 2}", 1) for k in range(6)] + [(8, text("same", 40), "en", "s1", 1)] * 3 + [(9, None, "en", "s1", 1), (10, text("z", 2000), "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    taken = Counter()
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        words = r.text.split(" ")
        taken[r.doc_id, words[0].split("x")[0], r.source] += len(words)
    plan, most = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.source] += r.taken
    for i, t, _, source, _ in rows:
        if t:
            most[i, t.split("x")[0], source] += 3 * len(t.split(" "))
    got = Counter()
    for (i, _, source), n in taken.items():
        got[i, source] += n
    assert got == +plan and got[None, "s0"] > 0 and got[None, None] > 0
    assert all(n <= most[k] for k, n in taken.items())


def test_language_keeps_texts_without_evidence(spark):
    rows = [(i, f"the {w} and that", "en", "s", 1) for i, w in enumerate(["cat", "dog", "house", "tree"])] + [(10 + i, f"der {w} und das", "de", "s", 1) for i, w in enumerate(["Hund", "Baum", "Tisch", "Wagen"])]
    rows += [(20, "A.", "en", "s", 1), (21, "Qxz", None, "s", 1), (22, "the cat and that", None, "s", 1), (23, "!!", "en", "s", 1), (24, None, "en", "s", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert got == {i: lang for i, _, lang, *_ in rows if i < 20} | {20: "en", 21: None, 22: "en"}


def test_one_row_of_each_group_stays(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "a"), (None, "c"), (None, "c"), (None, "d"), (None, "e"), (9, "e"), (5, "f"), (4, "f")]
    rows = [(i, text(t), "en", "s", 1) for i, t in rows] + [(None, "", "en", "s", 1)] * 2 + [(6, None, "en", "s", 1)] * 2
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "").collect()
    got = Counter((r.doc_id, (r.text or "-")[0]) for r in out if r.text)
    assert got == Counter([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (9, "e"), (4, "f")])
    assert Counter(r.text for r in out if not r.text) == {"": 2, None: 2}
