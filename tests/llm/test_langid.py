"""Language filters against counts by hand, long texts cut into runs, and held-out accuracy on the shipped documents."""

import random
from collections import Counter

import numpy as np

from arborlight.llm import langid
from arborlight.llm.queries import queries

SF = "/root/testdata/sf0.01"


def grams_by_hand(text, n):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = " " + " ".join(clean.split(" ")) + " " if clean.strip() else ""
    while "  " in clean:
        clean = clean.replace("  ", " ")
    clean = clean + " " * (n - len(clean)) if clean else ""
    return [clean[i : i + n] for i in range(len(clean) - n + 1)]


def test_runs_are_the_whole_texts_ngrams():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab1 é.\n日") for _ in range(rng.randint(0, 40)))
        for n in (1, 3, 4):
            whole = langid.ngrams(text, n)
            by_hand = grams_by_hand(text, n)
            assert (0 if whole is None else len(whole)) == len(by_hand), (text, n)
            for run in (1, 2, 7):
                parts = list(langid.gram_runs(text, n, run))
                assert (whole is None and not parts) or (np.concatenate(parts) == whole).all()
            if whole is not None:  # equal n-grams, equal hashes
                assert len(set(whole.tolist())) == len(set(by_hand))


def test_filters_hold_every_ngram_of_every_language(spark):
    rng = random.Random(2)
    letters = {"aa": "abcd", "bb": "abce", "cc": "abcf", "dd": "abcg"}
    rows = [(i, "".join(rng.choice(letters[lang] + " ") for _ in range(50)), lang) for i in range(40) for lang in letters]
    rows += [(99, None, "aa"), (98, "", "bb"), (97, "123", "cc"), (96, "abcd", None)]
    learnt = langid.learn_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {lang: Counter(g for _, t, x in rows if x == lang for g in grams_by_hand(t or "", 4)) for lang in letters}
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    exact, more = 0, 0
    for gram in set().union(*seen.values()):
        hashed = np.array([h for h, g in zip(langid.ngrams(gram, 4), grams_by_hand(gram, 4), strict=True) if g == gram], np.uint64)[:1]
        if not len(hashed):
            continue
        got, want = set(learnt.containing(hashed)), {lang for lang in letters if gram in seen[lang]}
        assert want <= got  # no false negatives, however many languages share it
        exact, more = exact + 1, more + len(got - want)
        most = max(seen[lang][gram] / total[lang] for lang in letters)
        planes = learnt.popcounts(hashed).reshape(-1, learnt.planes)
        for lang in want:
            rate = seen[lang][gram] / total[lang]
            assert all(planes[learnt.languages.index(lang)][k] for k, p in enumerate(langid.PLANES) if rate >= p * most)
    assert exact > 100 and more <= exact * 0.01


def test_small_holds_give_the_same_filter(spark, monkeypatch):
    rows = [(i, f"the quick brown fox {i} jumps über den Zaun", "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.learn_filter(df)
    monkeypatch.setattr(langid, "HELD", 50)
    cut = langid.learn_filter(df)
    assert whole.languages == cut.languages and (whole.table == cut.table).all()


def test_held_out_accuracy_on_shipped_documents(spark):
    out = queries()["op9_language_id"](spark, SF)
    known = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(known) > 200 and sum(r.lang == r.lang_pred for r in known) / len(known) >= 0.98
