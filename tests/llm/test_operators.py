"""Each operator against a brute-force version of its definition, over awkward rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arborlight.llm import bpe, embedding_dedup, langid, licenses, maxscore, minhash_dedup, mixing, quality, secrets, warc
from arborlight.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_license_scan(docs, rows, none):
    got = licenses.license_scan(docs).collect()
    assert licenses.license_scan(none).collect() == []
    want = []
    for doc_id, text, *_ in rows:
        words = ALNUM.findall((text or "").translate(ASCII))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        labels, score = {x for _, x in places}, 1.0 if places else 0.0
        for label, t in licenses.TEMPLATES:
            need = ALNUM.findall(t.translate(ASCII))
            width = max(8, 1 << (len(need) - 1).bit_length())
            for s in range(0, max(1, len(words)), width):
                c = len(set(need) & set(words[s : s + 2 * width])) / len(set(need))
                if c >= 0.8:
                    labels.add(label)
                    score = max(score, c)
        want.append((doc_id, len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:8] for r in got], key=key) == sorted(want, key=key)


def test_license_blocks_meet_the_threshold_exactly():
    words = [x.encode() for x in "see licensed under cc by nc 4 here".split()]
    index = licenses.TemplateIndex([("t", "Licensed under CC BY-NC 4.0")], {b"cc": 1, b"under": 9}, 0.8)
    assert [m[3] for m in index.matches(words)] == [6 / 7]
    assert index.matches(words[:5]) == []


SIBLINGS = {
    "Licensed under CC BY-NC 4.0": {"cc-by-nc"},
    "Licensed under CC BY-SA 4.0": {"cc-by-sa"},
    "Licensed under CC BY-NC 3.0": {"cc-by-nc"},
    "it under the terms of the GNU General Public License as published by the Free Software Foundation": set(),
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": {"lgpl"},
    "under the terms of the GNU Affero General Public License as published by the Free Software Foundation": {"agpl"},
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": set(),
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": {"gpl"},
    "This work is licensed under the Mozilla Public License, version 3": set(),
    "Released under the BSD License": set(),
    "Released under the MIT License": {"mit"},
    "Licensed under the Mozilla License, Version 2.0": set(),
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": set(),
    "This work is licensed under a Creative Commons Attribution 4.0 International License": {"cc-by"},
}


def test_license_siblings_are_told_apart(spark):
    df = spark.createDataFrame(list(enumerate(SIBLINGS)), "doc_id int, text string")
    got = {r.doc_id: {b.label for b in r.blocks} for r in licenses.license_scan(df).collect()}
    assert got == dict(enumerate(SIBLINGS.values()))


def test_license_siblings_of_own_templates():
    templates = [("one", "may be used freely by anyone in the north at will"), ("two", "may be used freely by anyone in the south at will")]
    index = licenses.TemplateIndex(templates, {}, 0.8)
    for t, (_, text) in enumerate(templates):
        assert {m[0] for m in index.matches(text.encode().split())} == {t}


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(160):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0.01, 0.25, 0.9])
        rows.append((i, [float(np.float32(x)) for x in v], [1, 2, None][i % 3], "x", 1))
    rows += [(200 + i, rows[3][1], rows[3][2], "x", 1) for i in range(30)]
    rows += [(300, None, 1, "", 0), (301, [0.0] * 16, 1, "", 0), (302, [float("nan")] * 16, 1, "", 0), (303, [None] * 16, 1, "", 0), (304, [], 1, "", 0), (305, [1.0, 2.0], 1, "", 0), (306, [2.0, 4.0], 1, "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string, n long")
    for chunk in (1024, 7):
        got = {r.vec_id: r for r in embedding_dedup.embedding_duplicates(df, chunk=chunk).collect()}
        good = [(r[0], np.array(r[1], float), r[2]) for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
        links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93]
        degree, comp = Counter(x for p in links for x in p), components([r[0] for r in rows], links)
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {r[0]: (degree[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}
    assert embedding_dedup.embedding_duplicates(df.limit(0)).collect() == []


def test_quality_learns_from_positives_and_unlabelled(spark, docs, none):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + (rng.choice(["%%%", "&&&"]) if bad and rng.random() < 0.5 else "") for _ in range(40))
    rows = [(i, text(i % 5 == 0), i % 5 != 0) for i in range(600)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, int(c)) for a, _, c in rows if a % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(df, labels, "id % 3 <> 0").collect()}
    held = [(got[a].predicted == int(c)) for a, _, c in rows if a % 3 == 0]
    assert sum(held) / len(held) > 0.95 and not got[3].learnt and got[4].learnt
    odd = quality.quality_scores(docs, labels, "id % 3 <> 0").collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.quality_scores(none, labels, "true").collect() == []
    assert {r.score for r in quality.quality_scores(df, labels.limit(0), "true").collect()} == {0.5}


def test_warc_revisits(spark):
    rng = random.Random(2)
    urls = ["http://www.A.com/x/?b=2&a=1&utm_source=q#f", "https://a.com/x?a=1&b=2", "http://b.org:80/", None]
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "other", None])
        rows.append((i, rng.choice(urls), rng.choice([None, *range(0, 3000, 7)]), kind, rng.choice(['"1"', 'W/"1"', '"2"', None]), rng.choice(["d", "e", None]), rng.choice([None, {"etag": "z", "date": str(i), "server": "s"}]), "extra"))
    df = spark.createDataFrame(rows, "rec_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, stretch string")
    key = {urls[0]: "a.com/x?a=1&b=2", urls[1]: "a.com/x?a=1&b=2", urls[2]: "b.org", None: None}
    for stretch in (10**6, 100):
        got = {r.rec_id: r for r in warc.resolve_revisits(df, stretch).collect()}
        assert len(got) == sum(r[3] == "revisit" for r in rows)
        for i, url, ts, kind, tag, date, headers, _ in rows:
            if kind != "revisit":
                continue
            earlier = [] if url is None or ts is None else [r for r in rows if r[3] == "response" and r[2] is not None and key[r[1]] == key[url] and r[2] < ts]
            o = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            bare = lambda x: x.removeprefix("W/")
            if o is None:
                status = "missing"
            elif tag and o[4]:
                status = "resolved" if bare(tag) == bare(o[4]) else "mismatch"
            elif date and o[5]:
                status = "resolved" if date == o[5] else "mismatch"
            else:
                status = "unvalidated"
            merged = {**(o[6] or {}), **{k: v for k, v in (headers or {}).items() if k in warc.PERMITTED}} if status == "resolved" else headers
            assert (got[i].url_key, got[i].original_id, got[i].status, got[i].headers) == (key[url], o and o[0], status, merged)
    assert warc.resolve_revisits(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [3, 9000, 10**17])
def test_exact_top_k(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.randint(-size, size) for _ in range(12)], "c") for i in range(90)]
    rows += [(200 + i, rows[5][1], "c") for i in range(9)] + [(500, None, ""), (None, rows[0][1], ""), (501, [None] * 12, ""), (502, [], "")]
    df = spark.createDataFrame(rows, "id long, terms array<long>, shard string")
    if size > 10**9:
        rows = [(i, v and [x and x // 10**9 for x in v], c) for i, v, c in rows]
        df = spark.createDataFrame(rows, "id long, terms array<long>, shard string")
    got = maxscore.exact_top_k(df.where("id % 10 = 0"), df, k=5, shard_rows=16, query_block=4).collect()
    usable = [(i, v) for i, v, _ in rows if i is not None and v and None not in v]
    want = []
    for q, w in usable:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in usable if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert maxscore.exact_top_k(df.limit(0), df).collect() == [] and maxscore.exact_top_k(df, df.limit(0)).collect() == []


def test_bpe_is_the_library(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    odd = ["It's 12 o'CLOCK; ΑΣ Σ İ ﬁ é", "<|startoftext|>a <|endoftext|>b<|endoftext", "\x1c\x85 a b", "!" * 300, "ab" * 500, "日本語テキスト🙂👍🏽", "՘Ᲊ"]
    vocabulary = bpe.Vocabulary.load(tokenizer_path())
    codec = bpe.Codec(vocabulary, bpe.Lexicon(bpe.Lexicon.compile([])), most=5)
    for text in odd + [r[1] for r in rows if r[1] and len(r[1]) < 5000]:
        e = library.encode(text, add_special_tokens=False)
        ids, decoded = codec.encode(text)
        assert list(map(int, ids.split())) == e.ids and decoded == library.decode(e.ids, skip_special_tokens=False) == codec.decode(e.ids)
    for words in (0, 50):
        got = sorted(bpe.encode_documents(docs, tokenizer_path(), lexicon_words=words, keep_tokens=True).collect(), key=str)
        want = []
        for r in rows:
            e = library.encode(r[1] or "", add_special_tokens=False)
            text = library.decode(e.ids, skip_special_tokens=False)
            want.append((r[0], len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted([tuple(g)[:4] for g in got], key=str) == sorted(want, key=str)
    assert bpe.encode_documents(none, tokenizer_path()).collect() == []


def test_lexicon_is_minimal_and_exact():
    words = sorted({a + b for a in ("re", "un", "walk", "talk", "é") for b in ("ing", "ed", "er", "", "s")} - {""})
    entries = [(w.encode(), [i, i + 7]) for i, w in enumerate(sorted(words, key=str.encode))]
    block = bpe.Lexicon.compile(entries)
    for lexicon in (bpe.Lexicon(block), bpe.Lexicon.mapped(block)):
        assert all(lexicon.get(w) == ids for w, ids in entries)
        assert lexicon.get(b"walkingly") is None and lexicon.get(b"wal") is None and lexicon.get(b"zzz") is None
    right = lambda s, w: frozenset(x[len(s) :] for x in w if x.startswith(s))
    encoded = [w for w, _ in entries]
    residuals = {right(w[:i], encoded) for w in encoded for i in range(len(w) + 1)}
    assert bpe.Lexicon._HEAD.unpack_from(block)[0] == len(residuals)  # as many states as there are residual languages


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, none, k):
    for chunk in (256, 3):
        got = minhash_dedup.near_duplicates(docs, shingle=k, chunk=chunk).collect()
        sets = []
        for r in rows:
            w = WORD.findall((r[1] or "").translate(ASCII))
            sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        comp = components(range(len(rows)), links)
        least = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
        want = [(r[0], len(sets[i]), least.get(comp[i]), least.get(comp[i]) == r[0]) for i, r in enumerate(rows)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert minhash_dedup.near_duplicates(none).collect() == []


def test_loose_members_are_found_across_chunks(spark):
    """A chain whose ends are far from its pivot: links between chunks that the pivot doesn't reach."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, shingle=4, chunk=4).collect()}
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for _, t in rows]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == components(range(60), links)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    mul, add = minhash_dedup._seeds(1024, 1)
    a, b = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b[:2400] = a[:2400]
    ra, rb = (minhash_dedup.registers(x, mul, add) for x in (a, b))
    assert (minhash_dedup.merge_registers(ra, rb) == minhash_dedup.registers(np.union1d(a, b), mul, add)).all()
    assert abs(minhash_dedup.estimate(ra, rb, 3000, 3000) - 2400 / 3600) < 0.05


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secret_scan(spark, docs, rows, none):
    rng = random.Random(9)
    bits = ["token", "PASSWORD", "api_key", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "\n", "é🙂", "secret", "x" * 12, "user: bob_1", "https://h.example.com/p", "A1b2" * 9]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["token = abcdefghijkl " * 300, "token: token = abcdefghijklmnop"]
    df = spark.createDataFrame([*enumerate(texts), *[(1000 + i, r[1]) for i, r in enumerate(rows)]], "doc_id long, text string")
    want = {i: t or "" for i, t in [*enumerate(texts), *[(1000 + i, r[1]) for i, r in enumerate(rows)]]}
    for r in secrets.secret_report(df).collect():
        spans = base_spans(want[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == n for x in spans) for n in range(3))
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
    assert secrets.secret_report(none).collect() == []


def test_weak_candidates_need_their_complement(spark):
    opaque = "Zz9" * 12
    texts = [opaque, f"login: bob_1 then {opaque}", f"login: bob_1 {'pad ' * 100} {opaque}", f"login: bob_1\n\n{opaque}", f"db postgres://h/x login=bob_1 password=abcdefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [p.kind for p in r.secret_parts] for r in secrets.secret_parts(df).collect()}
    assert kinds == {0: [], 1: ["login", "opaque"], 2: [], 3: [], 4: ["endpoint", "login", "assign"]}
    found = secrets.secret_parts(df).withColumn("clean", secrets.redacted("text", "secret_parts"))
    clean = {r.doc_id: r.clean for r in found.collect()}
    assert clean[0] == opaque and clean[1] == "[SECRET] then [SECRET]" and clean[4] == "db [SECRET] [SECRET] [SECRET]"


def test_weak_candidates_meet_over_the_whole_scope(spark):
    opaque, late = "Zz9" * 12, "Ab" * 40 + "7" + "x" * 9
    texts = [f"login: bob_1 {'pad ' * 400} {opaque}", f"login: bob_1\n\n{'pad ' * 400} {opaque}", f"login: bob_1 {late}", f"{opaque}\n\nuser: bob_1 {'pad ' * 99} password=abcdefghijkl db postgres://h/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [p.kind for p in r.secret_parts] for r in secrets.secret_parts(df, reach=None).collect()}
    assert kinds == {0: ["login", "opaque"], 1: [], 2: ["login", "opaque"], 3: ["login", "assign", "endpoint"]}
    assert [p.kind for p in secrets.secret_parts(df.where("doc_id = 2")).first().secret_parts] == ["login", "opaque"]
    import corpus_pipeline

    spans = corpus_pipeline.secret_spans(spark, df.withColumn("n_chars", df["doc_id"]), "").where("doc_id = 0").first()
    assert spans.text.startswith("[SECRET] pad") and spans.text.endswith("pad  [SECRET]")


def test_language_id(spark, docs, none):
    rng = random.Random(4)
    parts = {"aa": ["thi", "ing", "ed"], "bb": ["sch", "ung", "ei"], "cc": ["éau", "ion", "oi"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(lang := "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = langid.learn_filter(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.identify(df, learnt).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.6 for i, _, lang in rows)
    odd = {r.doc_id: r for r in langid.identify(docs, learnt).collect()}
    assert [odd[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and odd[304].lang_pred in parts
    assert langid.identify(none, learnt).collect() == []
    empty = langid.learn_filter(none)
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    # bit slices hold no false negatives: each typical n-gram names its language
    grams = langid.ngrams(rows[0][1], learnt.n)
    assert learnt.hits(grams)[learnt.languages.index("aa")] >= 0.9 * len(grams)
    many = langid.LanguageFilter([f"l{i}" for i in range(70)], np.zeros((2, 1 << 8), np.int64), 3, 2)
    many.table[1, :] = 1 << 6
    many.false[:] = 0
    assert many.decide("abc def")[0] == "l69"


def test_language_slots_grow_with_the_typical_ngrams(spark):
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "abcdefgi"), ("cc", "abcdefgj"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i in range(150) for lang in words]
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    learnt = langid.learn_filter(df, slot_bits=6)
    assert learnt.table.shape[1] > 64 and max(learnt.false) <= langid.FILL**learnt.hashes * 1.1
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, learnt).collect()}
    assert all(got[k] == lang for k, (_, _, lang) in enumerate(rows))
    assert langid.fitting_bits(11_000, 20, 2) == 20 and langid.fitting_bits(1_000_000, 20, 2) == 23
    with pytest.raises(ValueError):
        langid.fitting_bits(50_000_000, 20, 2)


def test_targets_fill_up_to_three_times(spark):
    cases = [[(10, 1), (1000, 2), (50, 3), (0, 1)], [(5, 1)], [(0, 1), (0, 2)], [(100, 1), (100, 2), (100, 3)]]
    for case in cases:
        df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(case)], "source string, source_size long, weight int")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        total, target, open_ = sum(s for s, _ in case), {}, set(range(len(case)))
        while open_:
            left = total - sum(target.values())
            share = {i: left * case[i][1] / sum(case[j][1] for j in open_) for i in open_}
            over = {i for i in open_ if share[i] > 3 * case[i][0] + 1e-9}
            target |= {i: 3 * case[i][0] for i in over} if over else share
            open_ -= over or open_
        assert all(abs(got[f"s{i}"] - t) < 1e-6 * max(1, total) for i, t in target.items())


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(8)
    for seats in (0, 1, 7, 100, 101):
        votes = [rng.choice([0, 1, 5, 5, 80, 1000]) for _ in range(9)]
        df = spark.createDataFrame(list(enumerate(votes)), "k int, v long").selectExpr("*", f"{seats} as n")
        got = {r.k: r.seats for r in mixing._apportion(df, df["v"], df["n"], [], "k").collect()}
        quotients = sorted(((-v / (2 * s + 1), k) for k, v in enumerate(votes) if v for s in range(seats)))[:seats]
        want = Counter(k for _, k in quotients)
        assert got == {k: want[k] for k in range(9)} or not any(votes)


def test_mix(spark, docs, rows, none):
    for shard_rows in (4096, 5):
        got = mixing.mix(docs, shard_rows=shard_rows).collect()
        assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), shard_rows=shard_rows).collect()))
        taken, target, sizes = Counter(), {}, Counter()
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.passes * r["size"] + r.length + r.wrapped
            taken[r.source] += r.taken
            target[r.source] = r.target
            sizes[r.source] += r["size"]
        assert sizes == Counter({s: sum(len(WORD.findall(x[1] or "")) for x in rows if x[3] == s) for s in {x[3] for x in rows}})
        for s, t in target.items():
            assert abs(taken[s] - t) <= 0.05 * t + 60, (s, taken[s], t)
    assert mixing.mix(none).collect() == []
