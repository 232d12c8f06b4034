"""Secret scans with multipart credential linking, in SQL functions alone.

Patterns find parts of credentials: assigned secrets, access identifiers, hexadecimal keys (reported always), and weak
candidates: opaque runs, logins and endpoints. Positions come from the pieces that a split at the same pattern leaves
between the matches, summed up in two levels, so that a text with many matches costs little more than its length.

The parts of rows with weak candidates, and the empty lines that end a scope, become rows of their own and are joined as
intervals: sorted by start, one sweep numbers the scopes and drops opaque runs that a reported part covers; a second one,
within each scope, takes along the furthest end of the complementary parts before and the nearest start of those behind.
A weak candidate is reported only where its complementary parts come within ``reach`` code points, or stand in its scope at
all: an opaque run beside an identifier, a login beside a secret, an endpoint beside both. The sweeps are windows of one
text's parts, so their cost is that of sorting them. Texts themselves are not shuffled, but for those with weak candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlight.plans.durable import Scratch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The leftmost run of 18 and 16 or more characters is the run that the shorter pattern finds, if that is long enough.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
OPAQUE = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
LOGIN = r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""\b(?:https?|ftp|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]+"""
BREAK = r"\n[ \t]*\n"
#: Kinds in the order that breaks ties of starts.
KINDS = ["assign", "access", "hex", "opaque", "login", "endpoint"]


def _let(name: str, value: str, body: str) -> str:
    """SQL: the body with a value that is computed once; a value named in a lambda is else computed for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(name: str) -> str:
    """SQL: for the array<int> of this name, the sums of what stands before each element; in blocks of 64."""
    add = "0, (a, x) -> a + x"
    blocks = f"sequence(0, cast(ceil(size({name}) / 64) as int) - 1)"
    sums = f"transform({blocks}, b -> aggregate(slice({name}, b * 64 + 1, 64), {add}))"
    before = f"transform(_sums, (s, b) -> aggregate(slice(_sums, 1, b), {add}))"
    inner = f"flatten(transform(_before, (s, b) -> transform(slice({name}, b * 64 + 1, 64), (x, i) -> s + aggregate(slice({name}, b * 64 + 1, i), {add}))))"
    return f"case when size({name}) = 0 then cast(array() as array<int>) else {_let('_sums', sums, _let('_before', before, inner))} end"


_NONE = "cast(array() as array<string>)"


def _spans(df: DataFrame, out: str, pattern: str, probe: Column, group: int = 0, least: int = 0) -> DataFrame:
    """Adds the array ``out`` of struct(start, end) of all matches, those of a short ``group`` left out."""
    text, p = F.col("_text"), F.lit(pattern)
    none = F.expr(_NONE)
    df = df.withColumns({
        "_m": F.when(probe, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none),
        "_g": F.when(probe, F.regexp_extract_all(text, p, F.lit(group))).otherwise(none) if group else none,
        "_s": F.when(probe, F.split(text, pattern, -1)).otherwise(none),
    })
    df = df.withColumns({"_l": F.expr("transform(_m, (m, i) -> char_length(m) + char_length(_s[i]))")})
    df = df.withColumn("_p", F.expr(_prefix("_l")))
    keep = f"char_length(_g[i]) >= {least}" if group else "true"
    found = f"transform(_m, (m, i) -> struct(_p[i] + char_length(_s[i]) as start, _p[i] + _l[i] as end, {keep} as ok))"
    df = df.withColumn(out, F.expr(f"transform(filter({found}, x -> x.ok), x -> struct(x.start as start, x.end as end))"))
    return df.drop("_m", "_g", "_s", "_l", "_p")


#: Complements of the weak kinds: parts of each of these sets must be near.
_WHO, _WHAT = ("access", "login"), ("assign", "hex", "opaque")
NEEDS = {"opaque": (_WHO,), "login": (_WHAT,), "endpoint": (_WHO, _WHAT)}


def _linked(parts: DataFrame, reach: int | None) -> DataFrame:
    """(rid, linked): the weak candidates of parts(rid, start, end, kind_no, kind) that meet their complements; kind is null for the end of a scope."""
    by_start = Window.partitionBy("rid").orderBy("start", F.col("kind").isNotNull(), "end", "kind_no")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind").isin(*KINDS[:3])
    covered = (F.max(F.when(base, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(after) < F.col("end"))
    p = parts.withColumns({"scope": F.count_if(F.col("kind").isNull()).over(by_start.rowsBetween(Window.unboundedPreceding, 0)), "covered": F.coalesce(covered, F.lit(False))})
    p = p.where(F.col("kind").isNotNull() & ~((F.col("kind") == "opaque") & F.col("covered")))
    in_scope = Window.partitionBy("rid", "scope").orderBy("start", "end", "kind_no")
    before, after = in_scope.rowsBetween(Window.unboundedPreceding, -1), in_scope.rowsBetween(1, Window.unboundedFollowing)

    def near(kinds):
        end, start = (F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(before), F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(after))
        if reach is None:
            return end.isNotNull() | start.isNotNull()
        return F.coalesce(end + reach >= F.col("start"), F.lit(False)) | F.coalesce(start <= F.col("end") + reach, F.lit(False))

    p = p.withColumns({"who": near(_WHO), "what": near(_WHAT)})
    met = [(F.col("kind") == k) & (F.col("who") if _WHO in sets else F.lit(True)) & (F.col("what") if _WHAT in sets else F.lit(True)) for k, sets in NEEDS.items()]
    return p.where(met[0] | met[1] | met[2]).groupBy("rid").agg(F.collect_list(F.struct("start", "kind_no", "end", "kind")).alias("linked"))


def _found(docs: DataFrame, names: list[str], text_col: str, reach: int | None) -> DataFrame:
    """The columns of docs that are named, and secret_parts, n_assign, n_access, n_hex."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    df = _spans(df, "_assign", ASSIGN, text.rlike(ASSIGN), 2, 12)
    df = _spans(df, "_access", ACCESS, text.contains("AKIA"))
    df = _spans(df, "_hex", HEX, text.rlike(HEX))
    df = _spans(df, "_opaque", OPAQUE, text.rlike("[A-Za-z0-9+/]{32}"))
    df = _spans(df, "_login", LOGIN, text.rlike(LOGIN))
    df = _spans(df, "_endpoint", ENDPOINT, text.contains("://"))
    weak = F.expr("size(_opaque) + size(_login) + size(_endpoint) > 0 and size(_assign) + size(_access) + size(_hex) + size(_opaque) + size(_login) > 1")
    df = df.withColumn("_weak", weak)
    df = _spans(df, "_break", BREAK, F.col("_weak") & text.contains("\n"))
    kinds = lambda which: ", ".join(f"transform(_{KINDS[i]}, x -> struct(x.start as start, {i} as kind_no, x.end as end, '{KINDS[i]}' as kind))" for i in which)
    df = df.select(
        "_row", "_weak", F.expr(f"array_sort(concat({kinds(range(3))}))").alias("_base"), F.expr(f"case when _weak then concat({kinds(range(3, 6))}) end").alias("_more"),
        F.expr("case when _weak then transform(_break, x -> x.end) end").alias("_break"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.monotonically_increasing_id().alias("_rid"),
    )
    # written once: the row's number must not change, and what callers do with the parts must not run the patterns again
    df = Scratch(docs.sparkSession, "secrets").save(df)
    parts = df.where("_weak").select(F.col("_rid").alias("rid"), F.inline(F.expr("concat(_base, _more, transform(_break, e -> struct(e as start, -1 as kind_no, e as end, cast(null as string) as kind)))")))
    linked = _linked(parts, reach)
    kept = lambda d, parts: d.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], parts.alias("secret_parts"), *[f"n_{k}" for k in KINDS[:3]])
    with_weak = df.where("_weak").join(linked, F.col("_rid") == F.col("rid"), "left")
    both = F.expr("array_sort(case when linked is null then _base else concat(_base, linked) end)")
    return kept(df.where("not _weak"), F.col("_base")).unionByName(kept(with_weak, both))


def secret_parts(docs: DataFrame, text_col: str = "text", reach: int | None = 200) -> DataFrame:
    """docs with the columns ``secret_parts`` (array of struct(start, kind_no, end, kind): all that is reported, in order) and
    n_assign, n_access, n_hex. Offsets count code points, the end is exclusive.

    Parts are linked over ``reach`` code points of the same scope; None links them over the whole of their scope, whatever its
    length. A null text is an empty one and has no parts; texts are scanned whole; rows don't influence each other, so repeated
    rows repeat results and empty tables stay empty. Columns of docs are kept; those named like a new column are replaced.
    """
    return _found(docs, [c for c in docs.columns if c not in ("secret_parts", "n_assign", "n_access", "n_hex")], text_col, reach)


def span_text(parts: str, base_only: bool) -> Column:
    """kind:start:end of the parts, comma-joined."""
    chosen = f"filter({parts}, x -> x.kind_no < 3)" if base_only else parts
    return F.expr(f"array_join(transform({chosen}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redacted(text: str, parts: str, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of parts that overlap replaced by the mark; null stays null."""
    step = f"struct(greatest(a.pos, x.end) as pos, case when x.start < a.pos then a.out else concat(a.out, substring({text}, a.pos + 1, x.start - a.pos), '{mark}') end as out)"
    whole = f"aggregate({parts}, struct(0 as pos, '' as out), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.pos + 1)))"
    return F.expr(f"case when size({parts}) = 0 then {text} else {whole} end")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = 200) -> DataFrame:
    """One row per input row: id, counts of the base kinds, base_sha256 of the base spans, and all spans. See secret_parts."""
    found = _found(docs, [id_col], text_col, reach)
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(span_text("secret_parts", True), 256).alias("base_sha256"), span_text("secret_parts", False).alias("spans"))
