"""Near-duplicate documents by SetSketch registers.

1. One pass turns each text into its set of word shingles, the set's key, and a SetSketch: m registers, each
   the exponentially spaced, truncated minimum ``floor(1 - log_b(min of exponentials))`` over the set. Registers
   of a union are the greater ones (mergeable), and agree between sets with a probability close to their Jaccard
   similarity (locality-sensitive). Texts with equal sets form a class; its least id stands for it from here on.
2. Bands of registers are hashed; classes that share a band's value are candidates. With 40 bands of 5 a pair at
   similarity 0.8 is missed with a probability of 1.2e-7, one above with less.
3. In each bucket the class that meets most others over all its bands is the hub, and every other member is compared with
   it. The registers of a pair give the joint likelihood of its similarity (the sets' sizes are known); a pair for
   which every similarity from the threshold on is e^18 times less likely than the best is set aside. All others are
   verified on their full sets.
4. Buckets whose members the verified links don't yet connect hold pairs that no hub has seen. They are gathered by their
   main component, so that members meet once and not in each band; those of other components are compared with all, in
   tiles of bounded size: registers first, then full sets, pairs that the tile has connected no more. A tile returns
   links that connect, not pairs.
5. Components of the verified links give each document's least reachable id.

Nothing is closed transitively before it is verified, so chance collisions don't grow into one cluster. No pair is made
within a class, a hub with a third of all rows is verified by many tasks of a chunk each, and what is sent is a
sketch for each document plus the sets of candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import HashCache, Union, arrow_out, bloom_filter, bloom_has, grouped_arrow, shingle_set, slices, space_words, tidied
from arborlight.plans.components import connected_components, splittable
from arborlight.plans.durable import Scratch

#: Base of the registers' exponential spacing, rate, and largest value (16-bit registers).
BASE, RATE, LIMIT = 1.001, 20.0, 65535
_LOG_BASE = np.log(BASE)


def _seeds(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, m, dtype=np.uint64)


def registers(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(len(mul), np.uint16)
    least = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 2048):
        part = shingles[s : s + 2048, None] * mul[None, :]
        part += add[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(e) / _LOG_BASE), 0, LIMIT).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE


def log_likelihood(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of similarity j for sets of n_u and n_v elements whose registers are so often greater, less and equal."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    tiny = 1e-12
    up, down = np.maximum(_p(u - v * j), tiny), np.maximum(_p(v - u * j), tiny)
    same = np.maximum(1 - up - down, tiny)
    return greater * np.log(up) + less * np.log(down) + equal * np.log(same)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """The similarity of greatest joint likelihood, from registers and sizes."""
    grid = np.linspace(0, min(n_a / n_b, n_b / n_a), 201)
    return float(grid[np.argmax(log_likelihood((a > b).sum(), (a < b).sum(), (a == b).sum(), n_a, n_b, grid))])


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float = 18.0) -> np.ndarray:
    """Which rows of registers a, b may reach the threshold together: size ratio, and likelihood at or over the threshold."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    top = np.minimum(n_a / n_b, n_b / n_a)
    greater, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - greater - less
    steps = np.linspace(0, 1, 41)[None, :]
    of = lambda j: log_likelihood(greater, less, equal, n_a[:, None], n_b[:, None], j).max(axis=1)
    best, high = of(steps * top[:, None]), of(threshold + steps * np.maximum(top - threshold, 0)[:, None])
    return (top >= threshold - 1e-12) & (high >= best - slack)


def _regs(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in column])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    shared = both - len(np.union1d(a, b))
    return 100 * shared >= percent * (both - shared)


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): keys of the pairs (x, y) of class numbers that their registers let pass."""
    named = lambda n: classes.select(F.concat(F.col("num").cast("string"), F.lit("")).alias(f"_{n}"), *[F.col(c).alias(f"{n}_{c}") for c in ("set_key", "n", "regs")])
    met = pairs.join(named("x"), splittable("x") == F.col("_x")).join(named("y"), splittable("y") == F.col("_y"))

    def check(batches):
        for t in batches:
            for s in range(0, t.num_rows, 2000):
                b = t.slice(s, 2000)
                ok = plausible(_regs(b.column("x_regs")), _regs(b.column("y_regs")), b.column("x_n").to_numpy(), b.column("y_n").to_numpy(), percent / 100)
                yield pa.RecordBatch.from_arrays([b.column("x_set_key"), b.column("y_set_key")], ["a", "b"]).filter(pa.array(ok))

    return met.select("x_set_key", "y_set_key", "x_n", "y_n", "x_regs", "y_regs").mapInArrow(check, "a string, b string")


def _verified(pairs: DataFrame, pool: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets of the pool (key, shingles) reach the threshold; pairs of one b go by chunks, with b's set once in each."""
    loads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    dealt = pairs.join(loads.select(F.concat("b", F.lit("")).alias("_b"), "parts"), splittable("b") == F.col("_b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    sets = pool.select(F.concat("key", F.lit("")).alias("_k"), "shingles")
    members = dealt.join(sets, splittable("a") == F.col("_k")).select("b", "part", F.col("a").alias("key"), "shingles")
    hubs = loads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets, splittable("b") == F.col("_k")).select("b", "part", F.lit(None).cast("string").alias("key"), "shingles")
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def check(groups):
        out: tuple[list, list] = ([], [])
        for t in groups:
            keys, sets = t.column("key").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            hub = sets[keys.index(None)]
            near = [k for k, x in zip(keys, sets, strict=True) if k is not None and _linked(hub, x, percent)]
            out[0].extend(near)
            out[1].extend([t.column("b")[0].as_py()] * len(near))
            if len(out[0]) > 10_000:
                yield arrow_out(schema, {"a": out[0], "b": out[1]})
                out = ([], [])
        yield arrow_out(schema, {"a": out[0], "b": out[1]})

    return grouped_arrow(members.unionByName(hubs), ["b", "part"], check, "a string, b string")


def _open_links(open_: DataFrame, classes: DataFrame, pool: DataFrame, percent: int, tile: int) -> DataFrame:
    """(a, b): links between different roots in the buckets open_(band, num, root), enough to connect what is linked.

    A bucket's most frequent root is its main one, and buckets of one main root are one group. Its rows of other roots are compared
    with all of its rows, in tiles of at most two times ``tile`` rows.
    """
    roots = open_.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    main = roots.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main")).select(F.concat(F.col("band").cast("string"), F.lit("")).alias("_b"), "main")
    rows = open_.join(main, splittable("band") == F.col("_b")).select("main", "num", "root").distinct()
    sizes = rows.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("p"), F.ceil(F.count_if(F.col("root") != F.col("main")) / tile).cast("int").alias("q"))
    rows = rows.join(sizes.where("q > 0").select(F.concat("main", F.lit("")).alias("_m"), "p", "q"), splittable("main") == F.col("_m"))
    keys = classes.select(F.concat(F.col("num").cast("string"), F.lit("")).alias("_n"), "set_key", "regs")
    rows = rows.join(keys, splittable("num") == F.col("_n")).join(pool.select(F.concat("key", F.lit("")).alias("_k"), "shingles"), splittable("set_key") == F.col("_k"))
    rows = rows.select("main", "root", "set_key", "regs", "shingles", "p", "q", F.pmod(F.xxhash64("set_key"), F.col("p")).cast("int").alias("y"), F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("q")).cast("int").alias("x"))
    columns = ["main", "x", "y", "side", "root", "set_key", "regs", "shingles"]
    left = rows.where("root <> main").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("side", F.lit(0)).select(columns)
    right = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).withColumn("side", F.lit(1)).select(columns)
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def compare(groups):
        for t in groups:
            side, root = t.column("side").to_numpy(), t.column("root").to_pylist()
            keys, sets = t.column("set_key").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            regs, n = _regs(t.column("regs")), np.array([len(x) for x in sets])
            uf, by_root = Union(t.num_rows), {}
            for i, r in enumerate(root):
                uf.join(by_root.setdefault(r, i), i)
            right, links = np.flatnonzero(side == 1), []
            for i in np.flatnonzero(side == 0):
                mine = uf.find(i)
                js = np.array([j for j in right.tolist() if uf.find(j) != mine], int)
                if len(js):
                    js = js[plausible(np.broadcast_to(regs[i], regs[js].shape), regs[js], np.full(len(js), n[i]), n[js], percent / 100)]
                for j in js.tolist():
                    if uf.find(j) != uf.find(i) and _linked(sets[i], sets[j], percent):
                        uf.join(int(i), j)
                        links.append((keys[i], keys[j]))
            if links:
                yield arrow_out(schema, {"a": [x[0] for x in links], "b": [x[1] for x in links]})

    return grouped_arrow(left.unionByName(right), ["main", "x", "y"], compare, "a string, b string")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 40, rows: int = 5, chunk: int = 256, seed: int = 7, name: str = "neardup",
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links of similarity >= percent/100), kept.

    Null or empty texts have no shingles and link with nothing. A repeated id counts as one document of each of its
    texts. A row with a null id shares the component of rows with an equal set that have ids; without such rows it links with
    nothing, component_id is null and kept is true. Very long texts are sketched whole. An empty table gives an empty result. Other columns
    of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    m = bands * rows
    base_schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("bands", pa.list_(pa.int64())), ("regs", pa.binary())])

    def sketch(batches):
        mul, add = _seeds(m, seed)
        cache = HashCache()
        turn = np.random.default_rng(seed + 1).integers(1, 1 << 62, (rows,), dtype=np.uint64) | np.uint64(1)
        salt = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(52)
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            n, keys, band, regs = [], [], [], []
            for i, x in zip(ids, batch.column(1), strict=True):
                s = shingle_set(space_words(x.as_py()), shingle, cache)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else f"none-{i}")
                if len(s):
                    r = registers(s, mul, add)
                    regs.append(r.tobytes())
                    r = r.reshape(bands, rows).astype(np.uint64) + np.uint64(1)
                    h = (r * turn).sum(axis=1, dtype=np.uint64)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + salt
                    band.append((h ^ (h >> np.uint64(32))).view(np.int64))
                else:
                    band.append(None)
                    regs.append(None)
            yield arrow_out(base_schema, {"id": ids, "n_shingles": n, "set_key": keys, "bands": band, "regs": regs})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = scratch.save(source.mapInArrow(tidied(sketch), "id long, n_shingles long, set_key string, bands array<long>, regs binary"))
    classes = base.groupBy("set_key").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("regs").alias("regs"))
    classes = scratch.save(classes.where("rep is not null").withColumn("num", F.xxhash64("set_key")))
    # from here on tables are dropped as soon as nothing reads them: sketches are wide, and sets wider
    whole, base = base, scratch.save(base.select("id", "n_shingles", "set_key"))
    scratch.drop(whole)

    # Buckets go by a hash of the set's key: should two keys ever share one, both are candidates, and no link changes.
    banded = classes.where("n > 0").select("num", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("num").alias("least"), F.max("num").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most")
    met = scratch.save(banded.join(shared.select(F.concat(F.col("band").cast("string"), F.lit("")).alias("_k"), "size"), splittable("band") == F.col("_k")).select("band", "num", "size"))
    if met.isEmpty():
        return _result(base, classes, spark.createDataFrame([], "id string, component string"), id_col)
    weight = met.groupBy("num").agg(F.sum("size").alias("weight"))
    hub = met.join(weight, "num").groupBy("band").agg(F.max_by("num", F.struct("weight", "num")).alias("hub"))
    stars = met.join(hub.select(F.concat(F.col("band").cast("string"), F.lit("")).alias("_k"), "hub"), splittable("band") == F.col("_k")).select("band", "num", "hub")
    stars = scratch.save(stars.where("num <> hub"))
    member = scratch.save(classes.join(weight.select("num"), "num", "left_semi").select("num", "set_key", "rep", "n", "regs"))
    whole, classes = classes, scratch.save(classes.select("set_key", "rep"))
    scratch.drop(whole)
    scratch.drop(met)

    bits = bloom_filter(member, "rep", bits=1 << min(28, max(16, (12 * member.count()).bit_length())))
    set_schema = pa.schema([("key", pa.string()), ("shingles", pa.binary())])

    def sets(batches):
        cache = HashCache()
        for batch in slices(batches):
            found = [shingle_set(space_words(x.as_py()), shingle, cache) for x in batch.column(1)]
            found = [s for s in found if len(s)]
            yield arrow_out(set_schema, {"key": [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in found], "shingles": [s.tobytes() for s in found]})

    payload = bloom_has(source.where("id is not null"), "id", bits, then=sets, schema="key string, shingles binary").join(member.select(F.col("set_key").alias("key")), "key", "left_semi")
    pool = scratch.save(payload.groupBy("key").agg(F.any_value("shingles").alias("shingles")))
    pairs = scratch.save(_plausible_pairs(stars.select(F.col("num").alias("x"), F.col("hub").alias("y")).distinct(), member, percent))
    found = scratch.save(_verified(pairs, pool, percent, chunk))
    scratch.drop(pairs)
    comps = connected_components(found, scratch)

    # what no hub has seen: pairs of different components in buckets that the links leave apart
    root = member.join(comps, F.col("set_key") == F.col("id"), "left").select(F.concat(F.col("num").cast("string"), F.lit("")).alias("_n"), F.coalesce("component", "set_key").alias("root"))
    rooted = stars.join(root, splittable("num") == F.col("_n")).select("band", "num", "root")
    apart = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.concat(F.col("band").cast("string"), F.lit("")).alias("_k"))
    open_ = scratch.save(rooted.join(apart, splittable("band") == F.col("_k")).select("band", "num", "root"))
    scratch.drop(stars)
    if open_.isEmpty():
        return _result(base, classes, comps, id_col)
    more = scratch.save(_open_links(open_, member, pool, percent, 2 * chunk))
    for table in (open_, member, pool):
        scratch.drop(table)
    if not more.isEmpty():
        comps = connected_components(found.unionByName(more), scratch)
    return _result(base, classes, comps, id_col)


def _result(base: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Each row with the least id of its class's component."""
    rep = classes.select("set_key", "rep").join(links, F.col("set_key") == F.col("id"), "left").select("set_key", "rep", "component")
    least = rep.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    rep = rep.join(least.withColumnRenamed("component", "c"), F.concat("component", F.lit("")) == F.concat("c", F.lit("")), "left")
    rep = rep.select(F.concat("set_key", F.lit("")).alias("_k"), F.coalesce("least", "rep").alias("component_id"))
    out = base.join(rep, splittable("set_key") == F.col("_k"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.expr("id <=> component_id").alias("kept"))
