"""From documents to tokens: five stages, each an operator of the llm subpackage.

Each stage reads what its predecessor wrote, works on all of it, and returns the columns of documents; the last returns
the tokens' counts and digests. A stage's result is written before the next one starts, which then drops the
intermediate tables behind it. Repeated rows, null and empty texts pass as each operator's docstring says.
"""

from __future__ import annotations

import functools
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.llm import bpe, langid, minhash_dedup, mixing, secrets
from arborlight.llm.common import SPACE_WORD, bloom_filter, bloom_has
from arborlight.llm.queries import tokenizer_path
from arborlight.plans.durable import Scratch, scratches

#: A text must owe this share of its most telling n-grams to one language; with fewer its languages contradict each other.
LANGUAGE_SHARE = 0.25
ORACLE_SQL = None


_BEHIND: list[Scratch] = []


def stage(work):
    """A stage: drops the tables behind the last stage's written result, and runs with Arrow batches of 1,000 rows, as the usual
    10,000 whole texts are held several times over by the JVM and by each worker."""

    @functools.wraps(work)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _BEHIND:
            _BEHIND.pop().clear()
        # shuffles that no plan refers to are removed when the driver collects its garbage
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        with scratches() as made:
            out = work(spark, docs, sf_dir)
        _BEHIND.extend(made)
        return out

    return begin


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the rows that name theirs; rejects texts without a letter, and those whose hits are spread over
    languages; fills in languages that are missing. A text with letters and no hit at all (score 0) says nothing against
    itself: it stays with the language that it has, null included."""
    names = docs.columns
    seen = langid.with_language(docs, langid.learn_filter(docs))
    silent = F.col("lang_score") == 0
    kept = seen.where((F.col("lang_pred") != langid.UNKNOWN) & (silent | (F.col("lang_score") >= LANGUAGE_SHARE)))
    return kept.withColumn("lang", F.coalesce("lang", F.when(~silent, F.col("lang_pred")))).select(names)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that share five-word shingles at a similarity of 0.8 or more, one stays: that with the least id, null
    last; of equal ids, the one with the least hash of its text. Rows with a null or a repeated id are documents of their own,
    so a row goes only if its own text is a duplicate. Texts without words all stay."""
    names = docs.columns
    scratch = Scratch(spark, "pipeline-neardup")
    docs = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = minhash_dedup.near_duplicates(docs, id_col="_row", shingle=5, percent=80).where("component_id is not null")
    keys = docs.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("_order"))
    found = scratch.save(found.join(keys, "_row").select("_row", "component_id", "_order"))
    first = found.groupBy("component_id").agg(F.min("_order").alias("_least")).select(F.col("_least._row").alias("_stays"))
    gone = scratch.save(found.join(first, F.col("_row") == F.col("_stays"), "left_anti").select(F.col("_row").alias("gone")))
    words = bloom_filter(gone, "gone", bits=1 << min(28, max(16, (12 * gone.count()).bit_length())))
    # only rows that the filter can't clear are joined, so kept texts aren't shuffled
    suspects = bloom_has(docs, "_row", words).join(gone, F.col("_row") == F.col("gone"), "left_anti")
    clear = bloom_has(docs, "_row", words, keep=False)
    return clear.select(names).unionByName(suspects.select(names))


@stage
def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark; texts without one stay as they are."""
    found = secrets.secret_parts(docs, reach=None)
    found = found.withColumn("text", secrets.redacted("text", "secret_parts"))
    return found.withColumn("n_chars", F.when(F.size("secret_parts") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole, and once more with the words of the rest; rows with a null or a repeated id are
    documents of their own. Rows without words, and those that the mix takes nothing of, go."""
    names = docs.columns
    # ids may be null or repeated, so the plan is joined back by a key of the written row; equal ids are told apart by their texts first
    docs = Scratch(spark, "pipeline-mix").save(docs.withColumn("_row", F.struct(F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("n"))))
    plan = mixing.mix(docs, row_col="_row").where("taken > 0").select(F.col("_row").alias("_key"), F.col("size").alias("_size"), "passes", "first", F.col("length").alias("_length"), "wrapped")
    rows = docs.join(plan, F.col("_row") == F.col("_key"))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    part = F.array_join(F.concat(F.slice(words, F.col("first").cast("int") + 1, F.col("_length").cast("int")), F.slice(words, F.lit(1), F.col("wrapped").cast("int"))), " ")
    rest = F.col("_length") + F.col("wrapped")
    whole = rows.where("passes > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))).select(names)
    cut = rows.where(rest > 0).withColumn("text", F.when(rest == F.col("_size"), F.col("text")).otherwise(part)).withColumn("n_chars", F.char_length("text").cast("long"))
    return whole.unionByName(cut.select(names))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secret_spans),
    ("source_mixing", mixture),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES[:-1]:
        docs = scratch.save(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
