"""Queries of the core library over the driver's tables, each with its SQL.

The tables hold no code, so adapters shape them as graphs, findings, texts and diffs. An adapter is SQL that Spark and
DuckDB both read; what is computed over it is a DataFrame operator here and plain SQL in the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlight.functions import paths as P
from arborlight.functions import scalar as S
from arborlight.index import files_per_language
from arborlight.operators import deadcode as C
from arborlight.operators import dependencies as N
from arborlight.operators import edges as E
from arborlight.operators import findings as V
from arborlight.operators import graph as G
from arborlight.operators import hosts as H
from arborlight.operators import mapping as M
from arborlight.operators import relations as R
from arborlight.operators import resolve as X
from arborlight.operators import weakening as W
from arborlight.trust import mutation_scores

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An adapter's rows."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def query(oracle: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        _Q[name] = f
        if oracle:
            _O[name] = oracle
        return f

    return add


# ---- graph adapters
D = "cast({} as double)".format
EDGES = f"""
select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, {D(0.8)} as conf from nation
union all select 'c' || c_custkey, 'n' || c_nationkey, {D(0.8)} from customer
union all select 's' || s_suppkey, 'n' || s_nationkey, {D(0.8)} from supplier
union all select 'o' || o_orderkey, 'c' || o_custkey, {D(0.7)} from orders
union all select 'o' || l_orderkey, 'p' || l_partkey, case when l_returnflag = 'R' then {D(0.4)} else {D(0.5)} end from lineitem
union all select 'p' || l_partkey, 's' || l_suppkey, {D(0.5)} from lineitem
"""
CYCLIC = EDGES + f"union all select 'c' || o_custkey, 'o' || max(o_orderkey), {D(0.7)} from orders group by o_custkey"
NODES = """
select 'r' || r_regionkey as id from region union all select 'n' || n_nationkey from nation union all select 'c' || c_custkey from customer
union all select 's' || s_suppkey from supplier union all select 'p' || p_partkey from part union all select 'o' || o_orderkey from orders
"""
ROOTS = "select 'o' || o_orderkey as id from orders where o_orderkey % 97 = 0"
TEST_ROOTS = "select 'o' || o_orderkey as id from orders where o_orderkey % 89 = 1"
_REACH = "reach_{0}(id) as (select id from ({1}) union select e.dst from reach_{0} r join ({2}) e on e.src = r.id)"


@query(f"with recursive {_REACH.format('p', ROOTS, EDGES)} select id from reach_p")
def q_reach_prod(spark, sf_dir):
    return G.reach(rows(spark, sf_dir, EDGES), rows(spark, sf_dir, ROOTS))


@query(f"with recursive {_REACH.format('c', ROOTS, CYCLIC)} select id from reach_c")
def q_reach_cyclic(spark, sf_dir):
    return G.reach(rows(spark, sf_dir, CYCLIC), rows(spark, sf_dir, ROOTS))


CONDITIONAL = "select 'o' || o_orderkey as id, 'c' || o_custkey as needs from orders where o_orderkey % 5 = 0"
PARENTS = "select 'c' || c_custkey as id, 'n' || c_nationkey as parent from customer"
SMALL_EDGES = "select 'o' || o_orderkey as src, 'c' || o_custkey as dst from orders union all select 'o' || l_orderkey, 'p' || l_partkey from lineitem"


@query(f"with recursive e as (select src, dst from ({SMALL_EDGES}) union select id, parent from ({PARENTS}) union select needs, id from ({CONDITIONAL})), "
       f"r(id) as (select id from ({ROOTS}) union select e.dst from r join e on e.src = r.id) select id from r")  # fmt: skip
def q_reach_conditional(spark, sf_dir):
    return G.reach(rows(spark, sf_dir, SMALL_EDGES), rows(spark, sf_dir, ROOTS), rows(spark, sf_dir, PARENTS), rows(spark, sf_dir, CONDITIONAL))


FLAGS = """
select 'p' || p_partkey as id, p_name as name, p_brand as file, p_size as line, p_partkey as pk, p_size % 2 = 0 as private, p_size % 3 = 0 as census_zero, p_size % 5 = 0 as dynamic,
  p_size % 7 = 0 as in_string, p_partkey % 4 = 0 as decorated, p_partkey % 6 = 0 as subclass, p_partkey % 11 = 0 as exported, p_partkey % 13 = 0 as broken from part
"""
_SCORE = f"""round(case when test_only then least(c, 0.85::double) else c end, 2) from (select *, greatest(0::double, least(0.99::double,
  (0.7::double + case when private then 0.1::double else 0 end + case when census_zero then 0.15::double else 0 end) * (1::double - (
  case when dynamic then 0.2::double else 0 end + case when in_string then 0.15::double else 0 end + case when decorated then 0.3::double else 0 end
  + case when subclass then 0.25::double else 0 end + case when exported then 0.1::double else 0 end + case when broken then 0.1::double else 0 end)))) as c"""


@query(f"""with recursive {_REACH.format('p', ROOTS, EDGES)}, {_REACH.format('a', ROOTS + ' union ' + TEST_ROOTS, EDGES)},
f as (select f.*, p.id is null as test_only from ({FLAGS}) f left join reach_a a on a.id = f.id left join reach_p p on p.id = f.id where p.id is null),
g as (select f.*, exists (select 1 from reach_a a where a.id = f.id) as used_by_tests from f),
s as (select *, {_SCORE.split(' from (')[0].replace('test_only', 'used_by_tests')} as confidence from (select *, {_SCORE.split('select *, ')[1]} from g))
select id, name, file, line, case when used_by_tests then 'used-only-by-tests' else 'dead-code' end as rule, confidence,
  case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as level from s where confidence >= 0.3""")
def q_dead_code(spark, sf_dir):
    steps, roots = G.closure_steps(rows(spark, sf_dir, EDGES)), rows(spark, sf_dir, ROOTS)
    reached = G.reach(None, roots, steps=steps)
    prod, every = reached.withColumn("prod", F.lit(True)), G.reach(None, rows(spark, sf_dir, TEST_ROOTS), steps=steps, known=reached).withColumn("any", F.lit(True))
    s = rows(spark, sf_dir, FLAGS).join(prod, "id", "left").where("prod is null").join(every, "id", "left").withColumn("used", F.coalesce("any", F.lit(False)))
    flags = {k: F.col(k) for k in ("private", "census_zero", "dynamic", "in_string", "decorated", "subclass", "exported", "broken")}
    s = s.withColumn("confidence", V.dead_score(flags, F.col("used"))).where("confidence >= 0.3")
    return s.select("id", "name", "file", "line", F.when(F.col("used"), "used-only-by-tests").otherwise("dead-code").alias("rule"), "confidence", S.level(F.col("confidence")).alias("level"))


PR_EDGES = EDGES.replace("as conf", "as weight")


def _pagerank_sql(rounds: int) -> str:
    out = f"with n as ({NODES}), k as (select count(*)::double as k from n), e0 as (select * from ({PR_EDGES}) where src <> dst), t as (select src, sum(weight) as t from e0 group by src), "
    out += "e as (select e0.src, dst, sum(weight) / min(t) as share from e0 join t on t.src = e0.src group by e0.src, dst), r0 as (select id, 1 / k as rank from n, k)"
    for i in range(rounds):
        out += (f", l{i} as (select coalesce(sum(rank), 0) as lost from r{i} left join t on t.src = r{i}.id where t.src is null)"
                f", g{i} as (select dst as id, sum(rank * share) as got from r{i} join e on e.src = r{i}.id group by dst)"
                f", r{i + 1} as (select n.id, 0.15::double / k + 0.85::double * (coalesce(got, 0) + lost / k) as rank from n left join g{i} on g{i}.id = n.id, k, l{i})")  # fmt: skip
    return out + f" select id, round(rank, 9) as rank from r{rounds}"


@query(_pagerank_sql(5))
def q_pagerank_5(spark, sf_dir):
    return G.pagerank(rows(spark, sf_dir, NODES), rows(spark, sf_dir, PR_EDGES), rounds=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query(f"""with b as (select dst as id, src as caller, max(conf) as conf from ({EDGES}) where conf >= 0.4 group by all), s as (select 's' || s_suppkey as id from supplier where s_suppkey % 40 = 1),
l1 as (select caller as id, max(conf) as c from b join s on s.id = b.id where caller not in (select id from s) group by caller),
l2 as (select caller as id, max(l1.c * conf) as c from b join l1 on l1.id = b.id where caller not in (select id from s union select id from l1) and l1.c * conf >= 0.1 group by caller),
l3 as (select caller as id, max(l2.c * conf) as c from b join l2 on l2.id = b.id where caller not in (select id from s union select id from l1 union select id from l2) and l2.c * conf >= 0.1 group by caller)
select id, 1 as distance, round(c, 6) as confidence from l1 union all select id, 2, round(c, 6) from l2 union all select id, 3, round(c, 6) from l3""")
def q_impact_best_path(spark, sf_dir):
    seeds = rows(spark, sf_dir, "select 's' || s_suppkey as id from supplier where s_suppkey % 40 = 1")
    e = rows(spark, sf_dir, EDGES).where("conf >= 0.4")
    return G.best_paths(e, seeds, 3, 0.1).select("id", "distance", F.round("confidence", 6).alias("confidence"))


PACK = "select p_partkey as id, p_retailprice as rank, cast(ceil(length(p_name || p_type || p_brand) / 4.0) as bigint) as cost from part"


@query(f"""with recursive o as (select *, row_number() over (order by rank desc, id) as k from ({PACK})),
g(k, id, cost, used, taken) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint, false union all
  select o.k, o.id, o.cost, case when g.used + o.cost <= 403 then g.used + o.cost else g.used end, g.used + o.cost <= 403 from g join o on o.k = g.k + 1)
select id, cost, cast(row_number() over (order by k) as integer) as place from g where taken""")
def q_pack_budget(spark, sf_dir):
    return G.pack_budget(rows(spark, sf_dir, PACK), [F.desc("rank"), "id"], 403)


@query(f"select dst as id, count(*) filter (where src <> dst) as inbound, count(distinct src) as callers from ({EDGES}) group by dst")
def q_inbound(spark, sf_dir):
    return C.inbound(rows(spark, sf_dir, EDGES).select(F.col("src").alias("src_sym"), F.col("dst").alias("dst_sym"))).withColumnRenamed("sym_id", "id")


# ---- edges
SYMBOLS = "select p_partkey as sym_id, p_partkey % 97 as file_id, p_name || '/' || p_brand as name, case when p_size % 3 = 0 then 'method' else 'function' end as kind from part"
REFS = """select l_orderkey * 10 + l_linenumber as ref_id, l_orderkey % 97 as file_id, case when l_suppkey % 4 = 0 then null else l_suppkey end as src_sym, p_name || '/' || p_brand as name,
  l_linestatus as kind, l_linenumber as line, l_returnflag = 'R' as member from lineitem join part on p_partkey = l_partkey"""
IMPORTS = "select s_suppkey % 97 as file_id, (s_suppkey * 7) % 97 as target_id, case when s_suppkey % 2 = 0 then p_name || '/' || p_brand end as name from supplier join part on p_partkey = s_suppkey * 3"


@query(f"""with s as ({SYMBOLS}), r as ({REFS}), i as ({IMPORTS}), nm as (select name, count(*) as n_all, count(*) filter (where kind <> 'method') as n_plain from s group by name),
c as (select r.*, s.sym_id as dst_sym, s.file_id = r.file_id as same, exists (select 1 from i where i.file_id = r.file_id and i.target_id = s.file_id) as imp,
  exists (select 1 from i where i.file_id = r.file_id and i.name = r.name) as named, not member and n_plain = 0 as only_methods,
  case when not member and n_plain > 0 then n_plain else n_all end as n
  from r join s on s.name = r.name join nm on nm.name = r.name where member or n_plain = 0 or s.kind <> 'method'),
w as (select *, bool_or(same) over (partition by ref_id) as any_same, bool_or(imp) over (partition by ref_id) as any_imp from c),
t as (select *, case when any_same then 0.8::double when any_imp then case when named then 0.85::double else 0.7::double end when n = 1 then 0.5::double else 0.4::double end as base
  from w where case when any_same then same when any_imp then imp else n <= 32 end),
f as (select *, case when only_methods then 0.3::double when member then base - 0.1::double else base end as confidence, case when src_sym is null then file_id end as src_file, any_same or any_imp as resolved from t)
select src_sym, src_file, dst_sym, resolved, kind, arg_min(line, ref_id) as line, round(max(confidence), 6) as confidence from f group by src_sym, src_file, dst_sym, resolved, kind""")
def q_edge_build(spark, sf_dir):
    out = E.build_edges(rows(spark, sf_dir, REFS), rows(spark, sf_dir, SYMBOLS), rows(spark, sf_dir, IMPORTS))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"select name, count(*) as definitions, count(*) <= 32 as kept from ({SYMBOLS.replace(chr(32) + '|| ' + chr(39) + '/' + chr(39) + ' || p_brand', '')}) group by name")
def q_ambiguity_cap(spark, sf_dir):
    return C.name_counts(rows(spark, sf_dir, "select p_name as name from part")).withColumn("kept", F.col("definitions") <= E.AMBIGUOUS)


@query(f"select name, count(*) as refs, count(*) filter (where file_id <> 5) as outside from ({REFS}) group by name")
def q_census_refs(spark, sf_dir):
    return rows(spark, sf_dir, REFS).groupBy("name").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("file_id") != 5).alias("outside"))


T0 = f"select l_orderkey as file, l_linenumber as line, l_returnflag as name, l_partkey as dst, {D(0.5)} as confidence, 't0' as source from lineitem"
PRECISE = "select l_orderkey as file, l_linenumber as line, l_returnflag as name, l_suppkey as dst from lineitem where l_linestatus = 'F' and l_orderkey % 3 = 0"


@query(f"with t as ({T0}), p as ({PRECISE}) select * from t where not exists (select 1 from p where p.file = t.file and p.line = t.line and p.name = t.name) "
       f"union all select file, line, name, dst, 0.97::double, 'precise' from p")  # fmt: skip
def q_scip_overlay(spark, sf_dir):
    p = rows(spark, sf_dir, PRECISE)
    return E.overlay(rows(spark, sf_dir, T0), p, p)


SEARCH = "select p_partkey as sym_id, p_name as name, p_brand as file, p_size as line from part"


@query(f"select sym_id, name, file, line, tier from (select *, case when name = 'small ring' then 0 when lower(name) = 'small ring' then 1 when starts_with(lower(name), 'small ring') then 2 "
       f"when contains(lower(name), 'small ring') then 3 end as tier from ({SEARCH})) where tier is not null order by tier, file, line, sym_id limit 50")  # fmt: skip
def q_find_symbol(spark, sf_dir):
    return R.search(rows(spark, sf_dir, SEARCH), "small ring", 50)


@query(f"select n2.n_name as target, coalesce(c.c_name, '<module level>') as caller, c.c_mktsegment as file, c.c_custkey as line, 0.8::double as confidence, e.src from ({EDGES}) e "
       "join nation n2 on 'n' || n2.n_nationkey = e.dst left join customer c on 'c' || c.c_custkey = e.src where lower(n2.n_name) in ('nation_3', 'nation_7') order by 5 desc, file nulls first, line nulls first, src, target limit 500")  # fmt: skip
def q_refs_enriched(spark, sf_dir):
    sym = rows(spark, sf_dir, "select 'n' || n_nationkey as id, n_name as name, cast(null as string) as file from nation union all select 'c' || c_custkey, c_name, c_mktsegment from customer")
    e = rows(spark, sf_dir, f"select e.*, c_custkey as line from ({EDGES}) e left join customer on 'c' || c_custkey = src")
    return R.incoming(e, sym, ["NATION_3", "nation_7"])


# ---- texts
@query("with t as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}_$]+'))) as token from documents) "
       "select doc_id, count(*) as n_tokens, min(token) as first_token from t where strlen(token) between 3 and 64 and not regexp_matches(token, '^[0-9]') group by doc_id")  # fmt: skip
def q_text_tokens(spark, sf_dir):
    d = rows(spark, sf_dir, "select doc_id, text from documents").select("doc_id", F.explode(S.tokens(F.col("text"))).alias("token"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").alias("first_token"))


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) as est_tokens from documents")
def q_token_est(spark, sf_dir):
    return rows(spark, sf_dir, "select * from documents").select("doc_id", S.est_tokens(F.col("text")).alias("est_tokens"))


@query("select doc_id, case when length(c) > 200 then substring(c, 1, 200) || '…' else c end as clean from (select doc_id, regexp_replace(text, '\\p{Cc}', '', 'g') as c from documents)")
def q_sanitize_200(spark, sf_dir):
    return rows(spark, sf_dir, "select * from documents").select("doc_id", S.sanitize(F.col("text")).alias("clean"))


@query("select doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as digest from documents")
def q_normalise_digits(spark, sf_dir):
    return rows(spark, sf_dir, "select * from documents").select("doc_id", F.md5(S.normalise_digits(F.col("text"))).alias("digest"))


@query("select page_id, regexp_matches(array_to_string((string_split(html, chr(10)))[1:10], chr(10)), '@generated|DO NOT EDIT|Code generated|autogenerated|auto-generated') as generated from pages")
def q_generated_scan(spark, sf_dir):
    return rows(spark, sf_dir, "select page_id, html from pages").select("page_id", S.generated(F.col("html")).alias("generated"))


@query("with t as (select distinct page_id, unnest(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]+')) as name from pages) select name, count(*) as pages from t group by name")
def q_ident_mentions(spark, sf_dir):
    t = rows(spark, sf_dir, "select page_id, html from pages").select("page_id", F.explode(S.identifiers(F.col("html"))).alias("name"))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


@query("select page_id, regexp_matches(url, '^(?:.*/)?en/.*$|^.*\\.html$') as is_test from pages")
def q_test_path_globs(spark, sf_dir):
    return rows(spark, sf_dir, "select page_id, url from pages").select("page_id", S.matches_any(F.col("url"), ["**/en/*", "*.html"]).alias("is_test"))


# ---- paths and names
NAMED_FILES = """select p_partkey as id, 'src/' || p_brand || '/f' || p_partkey || case p_partkey % 14 when 0 then '.cs' when 1 then '.go' when 2 then '.JSX' when 3 then '.pyi'
  when 4 then '.rs' when 5 then '.tsx' when 6 then '.mts' when 7 then '.min.js' when 8 then '.htm' when 9 then '.YAML' when 10 then '.lock' when 11 then '.toml' when 12 then '.java' else '' end as path from part"""
_ENDS = " ".join("when " + " or ".join(f"ends_with(lower(path), '{e}')" for e in ends) + f" then '{name}'" for name, ends in P.LANGUAGES.items())


@query(f"select id, case {_ENDS} end as lang, case when regexp_matches(lower(path), '\\.(html|htm)$') then 'html' when regexp_matches(lower(path), '\\.(json|toml|yaml|yml|cfg|ini)$') then 'text' end as kind from ({NAMED_FILES})")
def q_path_dispatch(spark, sf_dir):
    return rows(spark, sf_dir, NAMED_FILES).select("id", P.language_of(F.col("path")).alias("lang"), P.text_kind(F.col("path")).alias("kind"))


RELATIVE = """select p_partkey as id, p_brand || '/k' as base, case p_partkey % 5 when 0 then '../m' when 1 then './m/n' when 2 then '../../../m' when 3 then 'q/../m' else '..//../m' end as rel, p_partkey % 5 as c, p_brand as b from part"""


@query(f"select id, case c when 0 then b || '/m' when 1 then base || '/m/n' when 2 then null when 3 then base || '/m' else 'm' end as joined from ({RELATIVE})")
def q_joined_paths(spark, sf_dir):
    return rows(spark, sf_dir, RELATIVE).select("id", P.joined_path(F.col("base"), F.col("rel")).alias("joined"))


PACKAGES = """select p_partkey as id, case p_partkey % 4 when 0 then 'pypi' when 1 then 'crates.io' when 2 then 'npm' else 'other' end as eco,
  case p_size % 5 when 0 then lower(p_brand) when 1 then replace(p_brand, '#', '_') when 2 then '@' || p_size || '/x.y' when 3 then '_' || p_size else '' end as name from part"""


@query(f"""select id, case eco when 'pypi' then regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') and length(name) <= 100 when 'crates.io' then regexp_matches(name, '^[A-Za-z][A-Za-z0-9_-]*$') and length(name) <= 64
  when 'npm' then regexp_matches(name, '^(@[A-Za-z0-9~-][A-Za-z0-9._~-]*/)?[A-Za-z0-9~-][A-Za-z0-9._~-]*$') and length(name) <= 214 else false end as valid from ({PACKAGES})""")
def q_package_names(spark, sf_dir):
    return rows(spark, sf_dir, PACKAGES).select("id", P.valid_package(F.col("eco"), F.col("name")).alias("valid"))


@query("select o_custkey as stmt, o_orderpriority as module, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as names from orders group by o_custkey, o_orderpriority")
def q_imports_merged(spark, sf_dir):
    return R.merged_imports(rows(spark, sf_dir, "select o_custkey as stmt, o_orderpriority as module, o_orderstatus as name from orders")).withColumn("names", F.array_join("names", ","))


@query("select user_id, event_type, count(*) as runs, bool_and(value > 5) as caught from events group by user_id, event_type")
def q_caught_in_every_run(spark, sf_dir):
    e = rows(spark, sf_dir, "select user_id, event_type, value > 5 as ok from events")
    caught = mutation_scores(e.select(F.struct("user_id", "event_type").alias("mutant"), F.col("ok").alias("caught")))
    runs = e.groupBy(F.struct("user_id", "event_type").alias("mutant")).agg(F.count(F.lit(1)).alias("runs"))
    return runs.join(caught, "mutant").select("mutant.*", "runs", "caught")


@query("select distinct p_name || p_type as name from part where p_size % 2 = 0 and p_name || p_type not in (select p_name || p_type from part where p_size % 2 = 1)")
def q_deleted_names(spark, sf_dir):
    before, after = (rows(spark, sf_dir, f"select p_name || p_type as name from part where p_size % 2 = {k}") for k in (0, 1))
    return R.missing_names(before, after)


# ---- findings
EVENTS = "select event_id as seq, event_type as category, 'rule' || (event_id % 7) as rule, 'u' || user_id as file, case when event_id % 3 = 0 then 's' || (event_id % 5) end as symbol, props as message, value, event_id % 2 = 0 as is_base, least(value / 100, 1) as confidence from events"
_FP = "substring(sha256(category || chr(0) || rule || chr(0) || file || chr(0) || coalesce(symbol, regexp_replace(message, '[0-9]+', '#', 'g')) || chr(0)), 1, 20)"
_E = f"e as (select *, {_FP} as fp from ({EVENTS})), cur as (select * from e where not is_base), base as (select fp, count(*) as count from e where is_base and seq % 3 <> 1 group by fp), now as (select fp, count(*) as n from cur group by fp)"


def _events(spark, sf_dir):
    e = rows(spark, sf_dir, EVENTS)
    e = e.withColumn("fp", S.fingerprint(*[F.col(c) for c in ("category", "rule", "file", "symbol", "message")]))
    return e, e.where("not is_base"), e.where("is_base and seq % 3 <> 1").groupBy("fp").agg(F.count(F.lit(1)).alias("count"))


@query(f"with {_E} select seq, fp from e")
def q_fingerprint(spark, sf_dir):
    return _events(spark, sf_dir)[0].select("seq", "fp")


@query(f"select seq, sha256(category || chr(0) || rule || chr(0) || file || chr(0) || seq || chr(0) || coalesce(symbol, '') || chr(0) || message || chr(0)) as fp from ({EVENTS})")
def q_full_fingerprint(spark, sf_dir):
    return rows(spark, sf_dir, EVENTS).select("seq", S.full_fingerprint(*[F.col(c) for c in ("category", "rule", "file", "seq", "symbol", "message")]).alias("fp"))


@query(f"with {_E}, k as (select *, row_number() over (partition by fp order by seq) as nth from cur) select k.seq, k.fp from k left join base b on b.fp = k.fp where nth > coalesce(count, 0)")
def q_baseline_new(spark, sf_dir):
    _, cur, base = _events(spark, sf_dir)
    return V.new_findings(cur, base).select("seq", "fp")


@query(f"with {_E} select base.fp, count - coalesce(n, 0) as fixed from base left join now on now.fp = base.fp where count > coalesce(n, 0)")
def q_baseline_fixed(spark, sf_dir):
    _, cur, base = _events(spark, sf_dir)
    return V.fixed_findings(cur, base)


@query(f"with {_E} select * from (select coalesce(base.fp, now.fp) as fp, greatest(coalesce(n, 0), case when coalesce(base.fp, now.fp) < '8' then 0 else coalesce(count, 0) end) as count from base full join now on now.fp = base.fp) where count > 0")
def q_baseline_retained(spark, sf_dir):
    _, cur, base = _events(spark, sf_dir)
    return V.retained_baseline(cur, base, F.col("fp") < "8")


@query(f"""with {_E}, r as (select category, case when confidence >= 0.9 then 2 when confidence >= 0.7 then 1 else 0 end as l from cur),
a as (select count(*) filter (where category = 'click' and l >= 2) as tripped, count(*) filter (where category = 'error' and l >= 1) as weakening_tripped from r)
select *, case when weakening_tripped > 0 then 'fail' when tripped > 0 then 'fail' else 'pass' end as verdict from a""")
def q_verdict(spark, sf_dir):
    _, cur, _ = _events(spark, sf_dir)
    ranked = cur.withColumn("level_rank", S.rank_of(S.level(F.col("confidence")), S.LEVELS))
    return V.verdict(ranked, {"click": "high", "error": "medium"}, weakening="error")


@query(f"select count(*) filter (where confidence >= 0.9) as high, count(*) filter (where confidence >= 0.7 and confidence < 0.9) as medium, count(*) filter (where confidence < 0.7) as low from ({EVENTS})")
def q_summary_levels(spark, sf_dir):
    return V.summary(rows(spark, sf_dir, EVENTS))


@query(f"select seq, category, rule, confidence from ({EVENTS}) order by confidence desc, seq limit 100")
def q_findings_topn(spark, sf_dir):
    return V.top(rows(spark, sf_dir, EVENTS), 100).select("seq", "category", "rule", "confidence")


DIAG = "select file, cast(floor(value) as bigint) as line, seq % 2 as col, rule, category as message, seq from ({})".format(EVENTS)


@query(f"select file, line, col, rule, message, min(seq) as seq from ({DIAG}) group by all")
def q_diag_dedup(spark, sf_dir):
    d = rows(spark, sf_dir, DIAG)
    return V.merge_reports(d.where("seq % 3 = 0"), d.where("seq % 3 <> 0"))


@query(f"select seq, round(case when category = 'view' then 0.75 when category = 'error' then 0.98::double else 0.98::double - 0.05::double end, 2)::double as confidence from ({EVENTS})")
def q_diag_normalise(spark, sf_dir):
    from arborlight.sources.reports import confidence

    severity = F.when(F.col("category") == "view", "info").when(F.col("category") == "error", "error").otherwise("warning")
    return rows(spark, sf_dir, EVENTS).withColumns({"kind": F.lit("compiler"), "severity": severity}).select("seq", F.round(confidence(), 2).alias("confidence"))


# ---- diffs
LINES = "select 'c' || (conv_id % 40) as path, case when turn % 2 = 0 then '-' else '+' end as sign, turn as line, lower(text) as text, conv_id * 1000 + turn - turn % 2 as hunk, conv_id * 1000 + turn as pos, false as deleted from conversations"
_RULES = ("(?:^|\\s)(the\\w*)", "\\bwith", "\\bth\\w+", "xxxx", "\\bin", "\\bof\\b")


@query(f"""with x as (select *, regexp_matches(text, 'with') as skips, regexp_matches(text, 'th') as asserts, regexp_matches(text, 'of') as strict, regexp_matches(text, 'in') as loose from ({LINES})),
n as (select path, count(*) filter (where sign = '-') as r, count(*) filter (where sign = '+') as a, arg_min(line, pos) filter (where sign = '-') as line from x where asserts group by path),
w as (select *, bool_or(sign = '-' and asserts and strict) over (partition by path, hunk) as was from x)
select path, 'added-skip' as rule, line, 0.95::double as confidence from x where sign = '+' and skips
union all select path, 'assertions-reduced', line, case when r - a >= 3 then 0.65::double else 0.55::double end from n where r > a
union all select path, 'assertion-loosened', line, 0.6::double from w where sign = '+' and loose and not strict and was""")
def q_weakening(spark, sf_dir):
    from arborlight.operators.weakening import Rules, analyze

    rules = Rules("^(nothing)$", "with", "th", "nothing at all", "in", "of")
    return analyze(rows(spark, sf_dir, LINES), rules).select("path", "rule", "line", "confidence")


@query(f"""with x as (select *, regexp_extract(text, '^(\\w+)', 1) as name from ({LINES})) select path, line, name from x where sign = '-' and name <> '' and name not in (select name from x where sign = '+')""")
def q_weak_deleted(spark, sf_dir):
    from arborlight.operators.weakening import Rules, analyze

    out = analyze(rows(spark, sf_dir, LINES), Rules("^([A-Za-z0-9_]+)", "nothing at all", "nothing at all", "nothing at all", "nothing at all", "nothing at all"))
    return out.where("rule = 'deleted-test'").select("path", "line", F.col("symbol").alias("name"))


ATTR = "select 'o' || (o_custkey % 50) as path, o_orderkey as pos, o_orderkey - o_orderkey % 6 as hunk, o_orderstatus = 'F' as flag from orders"


@query(f"select path, pos, coalesce(max(case when flag then hunk end) over (partition by path order by pos rows between 4 preceding and 1 preceding) = hunk, false) as attr from ({ATTR})")
def q_weak_attr_window(spark, sf_dir):
    return R.within_previous(rows(spark, sf_dir, ATTR), "flag", 4, "attr").select("path", "pos", "attr")


# ---- imports, manifests, intervals, snapshots
PATHS = "select page_id as id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as path from pages"
MODULES = "select page_id as id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') as module from pages"


@query(f"with f as ({PATHS}), m as ({MODULES}) select m.id, m.module, min(f.path) as resolved from m left join f on f.path = m.module or suffix(f.path, '/' || m.module) group by m.id, m.module")
def q_import_resolve_suffix(spark, sf_dir):
    return R.resolve_by_suffix(rows(spark, sf_dir, MODULES), rows(spark, sf_dir, PATHS))


BASES = "select id, regexp_replace(path, '[.]html$', '') as base from ({})".format(PATHS)


@query(f"with f as ({PATHS}), b as ({BASES}) select b.id, b.base, coalesce((select min(path) from f where path = b.base || '.html'), (select min(path) from f where path = b.base), (select min(path) from f where path = b.base || '/1')) as resolved from b")
def q_import_candidates(spark, sf_dir):
    return R.resolve_by_candidates(rows(spark, sf_dir, BASES), rows(spark, sf_dir, PATHS), [".html", "", "/1"])


DEP_IMPORTS = "select distinct (l_orderkey * 100000 + l_partkey * 10 + l_linenumber) * 5 + l_suppkey % 5 as id, 'r' || (l_suppkey % 5) || '/d' || (l_partkey % 7) || '/f' as file, 'eco' || (l_linenumber % 2) as eco, 'Pkg_' || (l_partkey % 60) as package from lineitem"
DEPS = "select 'eco' || (p_partkey % 2) as eco, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then 'r' || (p_size % 5) else 'r' || (p_size % 5) || '/d' || (p_partkey % 7) end as dir, 'pkg-' || (p_partkey % 90) as name, case when p_size % 2 = 0 then 'dev' else 'main' end as section from part where p_partkey <= 60"
_DECL = f"""i as ({DEP_IMPORTS}), d as ({DEPS}), j as (select i.*, bool_and(d.section = 'dev') as dev from i left join d on d.eco = i.eco and replace(replace(lower(i.package), '_', '-'), '.', '-') = d.name
  and (d.dir = '' or starts_with(i.file, d.dir || '/')) group by i.id, i.file, i.eco, i.package), q as (select id, file, eco, package, dev is not null as declared, coalesce(dev, false) as dev_only from j)"""


@query(f"with {_DECL} select * from q")
def q_deps_declared(spark, sf_dir):
    return R.declared_imports(rows(spark, sf_dir, DEP_IMPORTS), rows(spark, sf_dir, DEPS))


REGISTRY = "select distinct 'eco' || (p_partkey % 2) as eco, 'Pkg_' || (p_partkey % 60) as package, (p_partkey % 60) % 3 <> 0 as exists from part where p_partkey % 60 < 45"


@query(f"""with {_DECL}, g as ({REGISTRY.replace(' as exists', ' as there')}), x as (select q.*, g.there, file like 'r1/%' as is_test, id % 5 = 0 as optional from q left join g on g.eco = q.eco and g.package = q.package),
r as (select *, case when not declared and not there then 'nonexistent-package' when not declared then 'undeclared-dependency' when dev_only and not is_test then 'dev-dependency-in-source' end as rule from x)
select id, rule, case when rule = 'dev-dependency-in-source' then 0.5::double else least(case when rule = 'nonexistent-package' then 0.9::double else 0.8::double end, case when optional then 0.35::double else 1 end) end as confidence
from r where rule is not null""")
def q_deps_registry(spark, sf_dir):
    i = R.declared_imports(rows(spark, sf_dir, DEP_IMPORTS), rows(spark, sf_dir, DEPS))
    i = i.withColumns({"is_test": F.col("file").like("r1/%"), "optional": F.col("id") % 5 == 0, "has_manifest": F.lit(True)})
    return R.dependency_findings(i, rows(spark, sf_dir, REGISTRY.replace("as exists", "as `exists`")))


# The two queries above read 60 declarations at every size, as their SQL says; these read all of part, of whose names half are few and common.
IMPORTS_WHOLE = DEP_IMPORTS.replace("(l_partkey % 60)", "(case when l_linenumber % 3 = 0 then l_partkey else l_partkey % 120 end)")
DEPS_WHOLE = "select 'eco' || (p_partkey % 2) as eco, case when p_partkey % 3 = 1 then '' when p_partkey % 3 = 0 then 'r' || (p_partkey % 4) else 'r' || (p_size % 5) || '/d' || (p_partkey % 7) end as dir, 'pkg-' || (case when p_partkey % 4 < 2 then p_partkey % 90 else p_partkey end) as name, case when p_partkey % 5 = 0 or p_size % 2 = 0 then 'dev' else 'main' end as section from part"
_DECL_WHOLE = _DECL.replace(DEP_IMPORTS, IMPORTS_WHOLE).replace(DEPS, DEPS_WHOLE)


@query(f"with {_DECL_WHOLE} select * from q")
def q_deps_declared_whole(spark, sf_dir):
    return R.declared_imports(rows(spark, sf_dir, IMPORTS_WHOLE), rows(spark, sf_dir, DEPS_WHOLE))


@query(_O["deps_registry"].replace(_DECL, _DECL_WHOLE))
def q_deps_registry_whole(spark, sf_dir):
    i = R.declared_imports(rows(spark, sf_dir, IMPORTS_WHOLE), rows(spark, sf_dir, DEPS_WHOLE))
    i = i.withColumns({"is_test": F.col("file").like("r1/%"), "optional": F.col("id") % 5 == 0, "has_manifest": F.lit(True)})
    return R.dependency_findings(i, rows(spark, sf_dir, REGISTRY.replace("as exists", "as `exists`")))


POINTS = "select distinct l_suppkey as k, (l_orderkey * 10 + l_linenumber) * 1000 + cast(l_quantity as bigint) as point_id, cast(l_quantity * 20 as bigint) as at from lineitem"
SPANS = "select p_partkey % 100 + 1 as k, p_partkey as span_id, p_size * 17 as lo, p_size * 17 + p_partkey % 300 as hi from part"


@query(f"select p.k, p.point_id, p.at, (select s.span_id from ({SPANS}) s where s.k = p.k and p.at between s.lo and s.hi order by s.lo desc, s.hi, s.span_id desc limit 1) as span_id from ({POINTS}) p")
def q_interval_innermost(spark, sf_dir):
    return R.innermost(rows(spark, sf_dir, POINTS), rows(spark, sf_dir, SPANS), "k")


RANGES = "select o_custkey % 100 + 1 as k, o_orderkey as range_id, o_orderkey % 900 as lo, o_orderkey % 900 + o_orderkey % 50 as hi from orders"


@query(f"select r.k, range_id, span_id from ({RANGES}) r join ({SPANS}) s on s.k = r.k and r.lo <= s.hi and r.hi >= s.lo")
def q_interval_overlap(spark, sf_dir):
    return R.overlapping(rows(spark, sf_dir, RANGES), rows(spark, sf_dir, SPANS).withColumnsRenamed({"lo": "start", "hi": "end"}), "k")


SEEDS = "select c_nationkey as file, c_custkey as id, case when c_custkey % 3 = 0 then c_custkey - 25 end as parent from customer where c_custkey % 4 <> 1"


@query(f"with s as ({SEEDS}) select * from s where not exists (select 1 from s c where c.file = s.file and c.parent = s.id)")
def q_impact_seeds(spark, sf_dir):
    return R.without_containers(rows(spark, sf_dir, SEEDS))


BEFORE = "select 'd' || doc_id as path, md5(text) as hash from documents where doc_id % 10 <> 3"
AFTER = "select 'd' || doc_id as path, md5(case when doc_id % 7 = 0 then text || '.' else text end) as hash from documents where doc_id % 10 <> 4"


@query(f"with b as ({BEFORE}), a as ({AFTER}) select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' else 'modified' end as change from b full join a on a.path = b.path where a.hash is distinct from b.hash")
def q_changed_files(spark, sf_dir):
    return R.changed(rows(spark, sf_dir, BEFORE), rows(spark, sf_dir, AFTER))


@query("select lang, count(*) as files, cast(sum(n_chars) as bigint) as size from documents group by lang")
def q_files_per_language(spark, sf_dir):
    return files_per_language(rows(spark, sf_dir, "select lang, n_chars as size from documents"))


@query("select doc_id, sha256('9' || lang || text) as hash from documents")
def q_content_hash(spark, sf_dir):
    return rows(spark, sf_dir, "select * from documents").select("doc_id", S.content_hash("9", F.col("lang"), F.encode("text", "utf-8")).alias("hash"))


# ---- code-graph operators over adapters
SPANNED = SYMBOLS.replace("as kind from part", "as kind, p_size % 4 + 1 as start_line, p_size % 4 + 3 as end_line from part")


@query(f"""with s as ({SPANNED}), r as ({REFS}), t as (select name, count(*) as n from r group by name)
select s.sym_id, coalesce(t.n, 0) - (select count(*) from r where r.name = s.name and r.file_id = s.file_id and r.line between s.start_line and s.end_line) as other_refs from s left join t on t.name = s.name""")
def q_census_own_span(spark, sf_dir):
    return C.census(rows(spark, sf_dir, SPANNED), rows(spark, sf_dir, REFS)).select("sym_id", "other_refs")


ECO_IMPORTS = """select distinct ((l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber) * 10000 + l_suppkey as import_id, 'r' || (l_suppkey % 5) || '/d' || (l_partkey % 7) || '/f' as file, case l_linenumber % 3 when 0 then 'pypi' when 1 then 'npm' else 'crates.io' end as eco,
  case when l_partkey % 5 = 0 then 'yaml' when l_partkey % 5 = 1 then 'Some.Pkg_' || (l_partkey % 30) else 'Pkg-' || (l_partkey % 60) end as package, l_suppkey % 7 = 0 as is_test, l_partkey % 11 = 0 as optional from lineitem"""
ECO_DEPS = """select case p_partkey % 3 when 0 then 'pypi' when 1 then 'npm' else 'crates.io' end as eco, case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'r' || (p_size % 4) else 'r' || (p_size % 4) || '/d' || (p_partkey % 7) end as dir,
  case when p_partkey % 4 = 0 then 'PyYAML' when p_partkey % 4 = 1 then 'python-some-pkg-' || (p_partkey % 30) when p_partkey % 4 = 2 then 'pkg_' || (p_partkey % 60) else 'Pkg-' || (p_partkey % 60) end as name,
  case when p_size % 5 = 0 then 'main' else 'dev' end as section from part where p_brand <> 'none'"""
ECO_ANSWERS = "select 'Pkg-' || (p_partkey % 60) as reg_name, min(p_partkey % 60) % 3 <> 0 as there from part group by 1"
_NORM = "case eco when 'pypi' then replace(replace(lower({0}), '_', '-'), '.', '-') when 'crates.io' then replace(lower({0}), '-', '_') else {0} end"


@query(f"""with i as (select *, {_NORM.format('package')} as want, case when eco = 'pypi' and package = 'yaml' then 'pyyaml' end as mapped from ({ECO_IMPORTS})),
d as (select eco, dir, section = 'dev' as dev, {_NORM.format('name')} as dn from ({ECO_DEPS})), e as (select *, case when eco = 'pypi' then regexp_replace(dn, '^python-', '') end as loose from d),
h as (select i.*, exists (select 1 from e where e.eco = i.eco and (e.dir = '' or starts_with(i.file, e.dir || '/'))) as has,
  (select bool_and(dev) from e where e.eco = i.eco and (e.dir = '' or starts_with(i.file, e.dir || '/')) and (dn = want or dn = mapped or loose = want)) as all_dev from i),
g as ({ECO_ANSWERS}), x as (select h.*, g.there is not null and not g.there as absent from h left join g on g.reg_name = coalesce(mapped, package)),
y as (select *, all_dev is not null as declared, coalesce(all_dev, false) and not is_test as dev_only from x),
z as (select *, case when absent then case when eco = 'pypi' and mapped is null then 0.7::double when eco = 'pypi' then 0.85::double else 0.9::double end
  when eco = 'pypi' and mapped is null then 0.55::double when eco = 'pypi' then 0.7::double else 0.8::double end as base from y)
select import_id, declared, dev_only, case when not declared then least(base, case when has then 1 else 0.45::double end, case when optional then 0.35::double else 1 end) end as confidence from z""")
def q_deps_by_ecosystem(spark, sf_dir):
    deps = rows(spark, sf_dir, ECO_DEPS)
    x = N.declared(rows(spark, sf_dir, ECO_IMPORTS), deps, deps).join(rows(spark, sf_dir, ECO_ANSWERS), "reg_name", "left")
    conf = N.import_confidence(F.coalesce(~F.col("there"), F.lit(False)), F.col("eco"), F.col("mapped"), F.col("has_manifest"), F.col("optional"))
    return x.select("import_id", "declared", "dev_only", F.when(~F.col("declared"), conf).alias("confidence"))


ALLOW = """[[allow]]
symbol = "small*"
path = "Brand#1*"
reason = "first"
[[allow]]
path = "Brand#2?"
[[allow]]
symbol = "*ring"
reason = "third"
"""


@query("select p_partkey as id, case when starts_with(p_name, 'small') and starts_with(p_brand, 'Brand#1') then 'first' when regexp_full_match(p_brand, 'Brand#2.') then 'allow-listed' when suffix(p_name, 'ring') then 'third' end as reason from part")
def q_allow_list(spark, sf_dir):
    return rows(spark, sf_dir, "select * from part").select(F.col("p_partkey").alias("id"), C.AllowList.parse(ALLOW).reason(F.col("p_name"), F.col("p_name"), F.col("p_brand")).alias("reason"))


NAMES = """select p_partkey as id, case p_partkey % 3 when 0 then 'pypi' when 1 then 'npm' else 'crates.io' end as eco, case p_size % 4 when 0 then 'python-py-' when 1 then 'python-python-' when 2 then 'Py_' else '' end || replace(p_type, ' ', '_') || case p_size % 3 when 0 then '-python' when 1 then '-py-py' else '.x' end as name from part"""


@query(f"select id, {_NORM.format('name')} as norm, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^(python-)+', ''), '^(py-)+', ''), '(-python)+$', ''), '(-py)+$', '') as loose from ({NAMES})")
def q_package_norms(spark, sf_dir):
    return rows(spark, sf_dir, NAMES).select("id", N.norm_for(F.col("eco"), F.col("name")).alias("norm"), N.relaxed(F.col("name")).alias("loose"))


DIFF_PATHS = """select p_partkey as id, case p_size % 6 when 0 then 'src/' when 1 then 'a/Tests/' when 2 then 'src/test/' when 3 then 'x/spec/' when 4 then 'P.Tests/' else '' end || case p_partkey % 5 when 0 then 'test_' else '' end || 'f' || p_partkey
  || case p_partkey % 4 when 0 then '_test' when 1 then '.spec' when 2 then 'Test' else '' end as stem from part"""


@query(f"""with p as (select id, lower(stem) as s, lower(regexp_extract(stem, '([^/]*)$', 1)) as b, regexp_matches('/' || lower(stem), '/(tests|test|__tests__|spec|specs)/') as inside from ({DIFF_PATHS}))
select id, inside or starts_with(b, 'test_') or suffix(b, '_test') as py, inside or contains(b || '.ts', '.spec.') or contains(b || '.ts', '.test.') as js, inside or suffix(b, '_test') as rs, suffix(b, '_test') as go,
  contains(s, '/src/test/') or starts_with(s, 'src/test/') or suffix(b, 'test') as java, suffix(b, 'test') or regexp_matches('/' || s, '/([^/]*[.]tests?|tests)/') as cs from p""")
def q_weak_test_files(spark, sf_dir):
    of = lambda ending, rules, name: W.test_file(F.concat("stem", F.lit(ending)), rules).alias(name)
    return rows(spark, sf_dir, DIFF_PATHS).select("id", of(".py", W.PYTHON, "py"), of(".ts", W.JAVASCRIPT, "js"), of(".rs", W.RUST, "rs"), of(".go", W.GO, "go"), of(".java", W.JAVA, "java"), of(".cs", W.CSHARP, "cs"))


CODE_FILES = "select distinct p_partkey % 97 as file_id, 'f' || (p_partkey % 97) as path, (p_partkey % 97) % 13 = 0 as is_test from part"
CODE_SYMBOLS = "select p_partkey as sym_id, p_partkey % 97 as file_id, p_name || p_partkey as name, p_name || p_partkey as qname, p_size as start_line, p_partkey % 11 = 0 as is_test, 'function' as kind from part"
CODE_EDGES = f"""select case when l_suppkey % 4 = 0 then null else ps.p_partkey end as src_sym, l_orderkey % 97 as src_file, l_partkey as dst_sym, case when l_returnflag = 'R' then {D(0.4)} else {D(0.5)} end as confidence, 't0' as source
  from lineitem left join part ps on ps.p_partkey = (l_partkey * 7 + l_suppkey) % 1000 + 1"""
_IMPACT = f"""e as ({CODE_EDGES}), s as (select sym_id as id from ({CODE_SYMBOLS}) where sym_id % 500 = 1),
l1 as (select src_sym as id, max(confidence) as c from e join s on s.id = e.dst_sym where src_sym is not null and src_sym not in (select id from s) group by src_sym),
l2 as (select src_sym as id, max(c * confidence) as c from e join l1 on l1.id = e.dst_sym where src_sym is not null and src_sym not in (select id from s union select id from l1) and c * confidence >= 0.1 group by src_sym),
r as (select id, 1 as distance, c from l1 union all select id, 2, c from l2), m as (select distinct src_file as file_id from e join (select id from s union select id from l1) x on x.id = e.dst_sym where src_sym is null)"""


def _impact(spark, sf_dir):
    graph = {"files": rows(spark, sf_dir, CODE_FILES), "symbols": rows(spark, sf_dir, CODE_SYMBOLS), "edges": rows(spark, sf_dir, CODE_EDGES)}
    return M.impact(graph, graph["symbols"].where("sym_id % 500 = 1").select(F.col("sym_id").alias("id")), 2, 0.1)


@query(f"with {_IMPACT} select id as sym_id, distance, round(c, 2) as confidence from r join ({CODE_SYMBOLS}) y on y.sym_id = r.id join ({CODE_FILES}) f on f.file_id = y.file_id")
def q_impact_callers(spark, sf_dir):
    return _impact(spark, sf_dir)[0].select("sym_id", "distance", "confidence")


@query(f"""with {_IMPACT}, a as (select f.path as file, y.is_test or f.is_test as t from r join ({CODE_SYMBOLS}) y on y.sym_id = r.id join ({CODE_FILES}) f on f.file_id = y.file_id
  union all select f.path, f.is_test from m join ({CODE_FILES}) f on f.file_id = m.file_id) select file, bool_or(t) as is_test from a group by file""")
def q_impact_affected(spark, sf_dir):
    return _impact(spark, sf_dir)[2]


@query("select p_brand as path, round(sum(p_retailprice), 4) as rank from part group by p_brand")
def q_file_ranks(spark, sf_dir):
    return M.file_ranks(rows(spark, sf_dir, "select p_brand as path, p_retailprice as rank from part")).withColumn("rank", F.round("rank", 4))


HOST_PARTS = "select p_partkey as id, 'C' || (p_partkey % 500) as qname, case when p_size = 1 and p_partkey % 3 = 0 then 'Engine' end as engine, case when p_partkey % 2 = 0 then 'C' || ((p_partkey * 7) % 560) else 'IFace' end as base from part"


@query(f"""with recursive p as ({HOST_PARTS}), b as (select distinct p.qname, p.base, k.qname as target from p left join (select distinct qname from p) k on k.qname = p.base where p.base <> 'IFace'),
proven(q) as (select distinct qname from p where engine is not null union select b.qname from proven join b on b.target = proven.q),
lost(q) as (select distinct qname from b where target is null union select b.qname from lost join b on b.target = lost.q)
select id, qname in (select q from proven) as live, qname not in (select q from proven) and qname in (select q from lost) as undecided from p where qname in (select q from proven) or qname in (select q from lost)""")
def q_partial_merge(spark, sf_dir):
    p = rows(spark, sf_dir, HOST_PARTS)
    unity = F.concat_ws(" ", F.lit("partial"), F.concat(F.lit("base-unity:"), "engine"), F.concat(F.lit("bases:"), "base"))
    none = F.lit(None).cast("int")
    classes = p.select((F.col("id") * 2).alias("sym_id"), F.col("id").alias("file_id"), F.lit(0).alias("idx"), none.alias("parent_idx"), F.lit("class").alias("kind"), F.col("qname").alias("name"), "qname", unity.alias("unity"))
    calls = p.select((F.col("id") * 2 + 1).alias("sym_id"), F.col("id").alias("file_id"), F.lit(1).alias("idx"), F.lit(0).alias("parent_idx"), F.lit("method").alias("kind"), F.lit("Update").alias("name"), F.concat("qname", F.lit(".Update")).alias("qname"), F.lit("msg").alias("unity"))
    graph = {"symbols": classes.unionByName(calls), "files": p.select(F.col("id").alias("file_id"), F.concat(F.lit("Assets/f"), F.col("id").cast("string")).alias("path"))}
    out = H.merged_hosts(graph).where("sym_id % 2 = 1")
    return out.select(F.expr("sym_id div 2").alias("id"), "live", F.col("unresolved_base").isNotNull().alias("undecided"))


PY_FILES = "select 'src/p' || p_size || '/m' || p_partkey || case when p_partkey % 9 = 0 then '.pyi' else '.py' end as path, 'python' as lang from part"
PY_IMPORTS = """select o_orderkey as import_id, 'src/p' || (o_custkey % 50 + 1) || '/z.py' as file, 'python' as lang, case o_orderkey % 4 when 0 then 'p' || (o_custkey % 50 + 1) || '.m' || (o_orderkey % 2000 + 1) when 1 then '.m' || (o_orderkey % 2000 + 1) when 2 then 'json.decoder' else 'ext' || (o_orderkey % 9) || '.sub' end as module,
  cast(null as string) as names, cast(o_custkey as bigint) as line, 'import' as kind from orders"""


@query(f"""with f as (select path, regexp_replace(path, '[.]pyi?$', '') as stem from ({PY_FILES})), i as ({PY_IMPORTS}), m as (select i.*, case when module like '.m%' then (select path from f where stem = regexp_replace(i.file, '/z.py$', '') || '/' || substring(i.module, 2))
  when module like 'p%' then (select min(path) from f where suffix('/' || stem, '/' || replace(i.module, '.', '/'))) end as hit from i)
select import_id, case when hit is not null then 'local' when module like '.%' then 'unresolved' when module = 'json.decoder' then 'stdlib' else 'external' end as class, coalesce(hit, '') as resolved,
  case when hit is null and module not like '.%' and module <> 'json.decoder' then regexp_extract(module, '^[^.]*', 0) end as package from m""")
def q_import_resolution(spark, sf_dir):
    i = rows(spark, sf_dir, PY_IMPORTS).withColumn("names", F.array().cast("array<string>"))
    out = X.resolve_imports(i, rows(spark, sf_dir, PY_FILES), spark.createDataFrame([], "eco string, name string"))
    return out.select("import_id", "class", F.array_join("resolved_files", ",").alias("resolved"), "package")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
