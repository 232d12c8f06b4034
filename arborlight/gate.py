"""The gate before a change is submitted: steps, baseline, policy, verdict."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.functions.scalar import LEVELS, fingerprint, rank_of
from arborlight.operators import findings as V
from arborlight.plans.durable import Scratch
from arborlight.sources.changes import run_git, safe_path, safe_revision

FINDING = "category string, rule string, file string, line long, symbol string, col long, kind string, severity string, confidence double, level string, source string, message string, evidence array<string>, fp_risks array<string>"
BASELINE = "fp string, count long, category string, rule string, file string, what string"
BASELINE_VERSION = 1
_COMMIT = re.compile(r"^[0-9a-f]{40}$")


@dataclass
class Step:
    """What a step came to: ran, skipped, failed, timeout or incomplete."""

    name: str
    status: str
    detail: str = ""


@dataclass
class Policy:
    """The least level that trips, by category; categories that aren't named don't."""

    thresholds: dict[str, str] = field(default_factory=lambda: {"deps": "high", "weakening": "medium", "diagnostic": "high", "rule": "high"})
    #: Whether saved reports alone are too old to pass on.
    fresh: bool = False


def run_steps(spark: SparkSession, steps: dict[str, Callable[[], DataFrame] | None]) -> tuple[DataFrame, list[Step]]:
    """(findings with seq, steps): each step's findings, written; one that raises is a failed step and no error, None is skipped."""
    scratch, parts, said = Scratch(spark, "verify"), [], []
    names = [c.split()[0] for c in FINDING.split(", ")]
    for number, (name, work) in enumerate(steps.items()):
        if work is None:
            said.append(Step(name, "skipped"))
            continue
        try:
            parts.append(scratch.save(work().select(*names).withColumn("seq", F.lit(number << 40) + F.monotonically_increasing_id())))
            said.append(Step(name, "ran"))
        except TimeoutError as e:
            said.append(Step(name, "timeout", str(e)[:300]))
        except Exception as e:  # noqa: BLE001 - whatever a step fails by is its result
            said.append(Step(name, "failed", f"{type(e).__name__}: {e}"[:300]))
    empty = spark.createDataFrame([], f"{FINDING}, seq long")
    return reduce(DataFrame.unionByName, parts, empty), said


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fp", fingerprint(*[F.col(c) for c in ("category", "rule", "file", "symbol", "message")]))


def parse_baseline(spark: SparkSession, text: str) -> DataFrame:
    """(fp, count, category, rule, file, what) of a baseline's JSON; ValueError for another version or counts below one."""
    d = json.loads(text)
    if not isinstance(d, dict) or d.get("version") != BASELINE_VERSION or not isinstance(d.get("entries"), dict):
        raise ValueError(f"a baseline of version {BASELINE_VERSION} is needed")
    rows = []
    for fp, e in d["entries"].items():
        if not isinstance(e.get("count"), int) or e["count"] < 1:
            raise ValueError(f"the baseline counts {fp} {e.get('count')!r} times")
        rows.append((fp, e["count"], e.get("category"), e.get("rule"), e.get("file"), e.get("what")))
    return spark.createDataFrame(rows, BASELINE)


def read_baseline(spark: SparkSession, root: str, path: str = "baseline.json", commit: str | None = None) -> DataFrame:
    """A baseline of the working tree, or pinned to a full commit id, so that a change can't bring its own. A missing one is empty."""
    full = safe_path(root, path)
    if commit is not None:
        if not _COMMIT.match(commit):
            raise ValueError("a trusted baseline is named by a full commit id")
        return parse_baseline(spark, run_git(root, "show", f"{commit}:{path}"))
    if not os.path.exists(full):
        return spark.createDataFrame([], BASELINE)
    with open(full, encoding="utf-8") as f:
        return parse_baseline(spark, f.read())


def same_as_in(root: str, path: str, commit: str) -> bool:
    """Whether a file (an allow-list) is byte for byte what it is in a commit; both missing is the same."""
    full = safe_path(root, path)
    here = open(full, "rb").read() if os.path.exists(full) else None  # noqa: SIM115
    try:
        there = run_git(root, "show", f"{safe_revision(commit)}:{path}").encode()
    except ValueError:
        there = None
    return here == there


def write_baseline(entries: DataFrame, root: str, path: str = "baseline.json") -> None:
    """entries (fp, count, category, rule, file, what) as JSON, written beside the old file, flushed, and moved onto it."""
    full = safe_path(root, path)
    rows = {r.fp: {"count": r["count"], "category": r.category, "rule": r.rule, "file": r.file, "what": r.what} for r in entries.orderBy("fp").toLocalIterator()}
    os.makedirs(os.path.dirname(full), exist_ok=True)
    handle, new = tempfile.mkstemp(dir=os.path.dirname(full), prefix=".baseline-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump({"version": BASELINE_VERSION, "entries": rows}, f, indent=2, sort_keys=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, full)


def baseline_entries(current: DataFrame, baseline: DataFrame, observed: list[str]) -> DataFrame:
    """What a new baseline holds: counts of now; entries of categories that weren't observed stay at the greater count."""
    kept = V.retained_baseline(current, baseline, F.col("category").isin(observed)) if "category" not in current.columns else V.retained_baseline(current.select("fp"), baseline, F.col("category").isin(observed))
    told = current.groupBy("fp").agg(F.first("category").alias("category"), F.first("rule").alias("rule"), F.first("file").alias("file"), F.first(F.coalesce("symbol", "message")).alias("what"))
    old = baseline.select("fp", *[F.col(c).alias(f"_{c}") for c in ("category", "rule", "file", "what")])
    out = kept.join(told, "fp", "left").join(old, "fp", "left")
    return out.select("fp", "count", *[F.coalesce(c, f"_{c}").alias(c) for c in ("category", "rule", "file", "what")])


@dataclass
class Report:
    """The gate's answer: verdict, new findings (level first, then file and line), counts, steps, notes."""

    verdict: str
    new: DataFrame
    counts: dict
    steps: list[Step]
    notes: list[str]


def verify(
    spark: SparkSession, steps: dict[str, Callable[[], DataFrame] | None], baseline: DataFrame | None = None, policy: Policy | None = None, update: Callable[[DataFrame], None] | None = None,
    diff_steps: tuple[str, ...] = ("weakening",), saved_only: bool = False,
) -> Report:
    """Run the steps, set their findings against the baseline, and judge what is new.

    Findings of diff_steps are about the change itself and are never in a baseline. update writes the new baseline; it is called only
    if all steps ran and no test was weakened. Incomplete goes before all: a step that failed proves nothing.
    """
    policy = policy or Policy()
    baseline = baseline if baseline is not None else spark.createDataFrame([], BASELINE)
    found, said = run_steps(spark, steps)
    scratch = Scratch(spark, "gate")
    found = scratch.save(with_fingerprint(found))
    of_diff = F.col("category").isin(*diff_steps)
    current = found.where(~of_diff)
    new = V.new_findings(current, baseline).select(*found.columns).unionByName(found.where(of_diff))
    new = scratch.save(new.withColumn("level_rank", rank_of(F.col("level"), LEVELS)))
    failed = any(s.status in ("failed", "timeout", "incomplete") for s in said)
    row = V.verdict(new, policy.thresholds, step_failed=failed, fresh_blocked=policy.fresh and saved_only, update=update is not None).first()
    known = {"dead-code": "dead", "check-deps": "deps", "diagnostics": "diagnostic", "rules": "rule"}
    observed = [known.get(s.name, s.name) for s in said if s.status == "ran"]
    gone = V.fixed_findings(current, baseline).join(baseline.select("fp", "category"), "fp")
    total = gone.agg(F.coalesce(F.sum(F.when(F.col("category").isin(observed), F.col("fixed"))), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.when(~F.col("category").isin(observed), F.col("fixed"))), F.lit(0)).alias("unobserved")).first()
    if update is not None and row.verdict != "incomplete" and row.weakening_tripped == 0:
        update(baseline_entries(current, baseline, observed))
    notes = [f"{s.name}: {s.status} {s.detail}".strip() for s in said if s.status != "ran"]
    notes += [f"{total.unobserved} baseline findings belong to steps that did not run"] if total.unobserved else []
    counts = {"new": new.count(), "tripped": row.tripped, "weakening_tripped": row.weakening_tripped, "fixed": total.fixed, "unobserved": total.unobserved}
    return Report(row.verdict, new.drop("level_rank").orderBy(F.desc(rank_of(F.col("level"), LEVELS)), "file", "line", "seq"), counts, said, notes)
