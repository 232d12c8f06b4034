"""All six kinds of parts against brute force, with and without a reach; parts that a caller takes apart."""

import random
import re

from pyspark.sql import functions as F

from arborlight.llm import secrets

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}")
LOGIN = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]+", re.A)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def by_hand(text, reach):
    found = {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12], "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]}
    found["hex"] = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    base = [s for k in ("assign", "access", "hex") for s in found[k]]
    found["opaque"] = [(s, e) for s, e in (m.span() for m in OPAQUE.finditer(text)) if not any(a < e and s < b for a, b in base)]
    found["login"] = [m.span() for m in LOGIN.finditer(text)]
    found["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    ends = [m.end() for m in re.finditer(r"\n[ \t]*\n", text)]
    scope = lambda p: sum(e <= p[0] for e in ends)

    def meets(p, kinds):
        return any(scope(q) == scope(p) and (reach is None or (q[0] <= p[1] + reach and q[1] + reach >= p[0])) for k in kinds for q in found[k])

    who, what = ("access", "login"), ("assign", "hex", "opaque")
    need = {"opaque": (who,), "login": (what,), "endpoint": (who, what)}
    out = [(s, i, e, k) for i, k in enumerate(secrets.KINDS) for s, e in found[k] if all(meets((s, e), n) for n in need.get(k, ()))]
    return sorted(out)


def texts():
    rng = random.Random(12)
    bits = ["password=", "token: ", "abcdefghijklmn", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01", " ", "\n", "\n \n", "\n\n", "é🙂", "user: bob_1 ", "login=x", "client_id=abc.def ", "https://h.example.com/p ", "postgres://h/x ", "A1b2" * 9 + " ", "Zz9" * 14, "pad " * 5, "="]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, ""]


def test_every_kind_is_linked_as_by_hand(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for reach in (None, 5, 40):
        got = {r.doc_id: [tuple(p) for p in r.secret_parts] for r in secrets.secret_parts(df, reach=reach).collect()}
        want = {i: by_hand(t or "", reach) for i, t in rows}
        assert got == want
    kinds = {p[3] for parts in want.values() for p in parts}
    assert kinds == set(secrets.KINDS)


def test_callers_can_take_the_parts_apart(spark):
    rows = [(7, t, f"c{i}", i, "x") for i, t in enumerate(texts()[:60])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_parts string, n_hex int, rid string").repartition(3)
    found = secrets.secret_parts(df, reach=None)
    assert found.columns == ["doc_id", "text", "rid", "secret_parts", "n_assign", "n_access", "n_hex"]
    flat = found.select(F.explode("secret_parts").alias("p")).where("p.kind_no < 3").count()
    assert flat == sum(p[1] < 3 for _, t, *_ in rows for p in by_hand(t or "", None)) and found.count() == len(rows)
    empty = secrets.secret_parts(df.limit(0))
    assert empty.collect() == [] and empty.withColumn("text", secrets.redacted("text", "secret_parts")).collect() == []


def test_a_text_of_many_parts(spark):
    text = "token = abcdefghijklmnop user: bob " * 5000
    r = secrets.secret_parts(spark.createDataFrame([(1, text)], "doc_id long, text string"), reach=None).select(F.size("secret_parts").alias("n"), "n_assign").first()
    assert (r.n, r.n_assign) == (10_000, 5000)
