"""Signed scenarios: manifests and receipts under Ed25519, snapshots of the files that they are about, and dual grading.

Keys and signatures are those of the JVM; all else is plain data. A scenario whose signature isn't verified is never graded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.sources.changes import safe_path

VERDICTS = ("incomplete", "gate-untrusted", "fail", "pass")


def canonical(payload: dict) -> bytes:
    """One form for one payload: keys in order, no white space."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def utc(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


# What stands before a raw Ed25519 key in the JVM's encodings.
_PUBLIC, _PRIVATE = bytes.fromhex("302a300506032b6570032100"), bytes.fromhex("302e020100300506032b657004220420")


class Signer:
    """Ed25519 by the JVM of a session."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.factory = self.jvm.java.security.KeyFactory.getInstance("Ed25519")

    def sign(self, payload: dict, private: bytes, public: bytes) -> dict:
        key = self.factory.generatePrivate(self.jvm.java.security.spec.PKCS8EncodedKeySpec(_PRIVATE + private))
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(key)
        s.update(canonical(payload))
        return {"payload": payload, "signature": bytes(s.sign()).hex(), "public_key": public.hex()}

    def verify(self, signed: dict) -> dict:
        """The payload; ValueError for another version, no destinations, malformed hex, or a signature that doesn't hold."""
        payload = signed["payload"]
        if payload.get("version") != 1 or not payload.get("destinations"):
            raise ValueError("a manifest of version 1 with destinations is needed")
        signature, public = bytes.fromhex(signed["signature"]), bytes.fromhex(signed["public_key"])
        if len(signature) != 64 or len(public) != 32:
            raise ValueError("a signature of 64 bytes and a key of 32 are needed")
        if not self.holds(canonical(payload), signature, public):
            raise ValueError("the signature does not hold")
        return payload

    def holds(self, data: bytes, signature: bytes, public: bytes) -> bool:
        key = self.factory.generatePublic(self.jvm.java.security.spec.X509EncodedKeySpec(_PUBLIC + public))
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(key)
        s.update(data)
        return bool(s.verify(signature))

    def keys(self) -> tuple[bytes, bytes]:
        """(private, public) of a new pair."""
        pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
        spec = lambda key, name: bytes(self.factory.getKeySpec(key, self.jvm.java.lang.Class.forName(f"java.security.spec.{name}")).getEncoded())[-32:]
        return spec(pair.getPrivate(), "PKCS8EncodedKeySpec"), spec(pair.getPublic(), "X509EncodedKeySpec")


def snapshot(root: str, paths: list[str]) -> tuple[dict[str, str], str]:
    """({path: sha256 of its bytes}, hash of the tree); ValueError for paths that lead out, links, and files that are missing."""
    out = {}
    for path in sorted(set(paths)):
        full = safe_path(root, path)
        if os.path.islink(os.path.join(root, path)) or not os.path.isfile(full):
            raise ValueError(f"{path!r} is no plain file")
        with open(full, "rb") as f:
            out[path] = hashlib.file_digest(f, "sha256").hexdigest()
    return out, hashlib.sha256("".join(f"{p}\0{h}\0" for p, h in out.items()).encode()).hexdigest()


class EvidenceProvider(Protocol):
    """Gives findings of a tree by one way of looking at it."""

    name: str

    def findings(self, root: str) -> DataFrame: ...


@dataclass
class Policy:
    """Floors that a scenario may raise but not lower: least mutation score, least coverage, runs."""

    mutation_score: float = 0.8
    coverage: float = 0.0
    runs: int = 2

    def raised(self, asked: dict) -> Policy:
        return Policy(max(self.mutation_score, asked.get("mutation_score", 0)), max(self.coverage, asked.get("coverage", 0)), max(self.runs, asked.get("runs", 0)))


def grade(spark: SparkSession, root: str, expected: dict[str, str], providers: list[EvidenceProvider], blocking: Callable[[DataFrame], DataFrame], complete: bool = True) -> tuple[str, bool]:
    """(verdict, whether the graders disagree) of a tree by two or more providers; a missing step, or files that differ from the
    snapshot, is incomplete before it can fail; graders that disagree make the gate untrusted."""
    try:
        same = snapshot(root, list(expected))[0] == expected
    except ValueError:
        same = False
    if not complete or not same or len(providers) < 2:
        return "incomplete", False
    said = [not blocking(p.findings(root)).isEmpty() for p in providers]
    if len(set(said)) > 1:
        return "gate-untrusted", True
    return ("fail" if said[0] else "pass"), False


def mutation_scores(runs: DataFrame) -> DataFrame:
    """(mutant, caught) of runs(run, mutant, caught): caught only if it was in every run."""
    return runs.groupBy("mutant").agg(F.bool_and("caught").alias("caught"))


def self_test(spark: SparkSession, mutants: dict[str, Callable[[], bool]], runs: int = 2) -> tuple[float, DataFrame]:
    """(share of mutants that each run caught, (mutant, caught)); a mutant's call answers whether the gate caught it, and one that
    raises counts as missed. Without mutants the score is 0."""
    rows = []
    for run in range(runs):
        for name, caught in mutants.items():
            try:
                rows.append((run, name, bool(caught())))
            except Exception:  # noqa: BLE001 - a gate that breaks has caught nothing
                rows.append((run, name, False))
    table = mutation_scores(spark.createDataFrame(rows, "run int, mutant string, caught boolean"))
    score = table.agg(F.avg(F.col("caught").cast("double"))).first()[0]
    return score or 0.0, table


def receipt(signer: Signer, verdict: str, manifest: dict, tree: str, score: float, policy: Policy, findings: list[str], at: int, private: bytes, public: bytes) -> dict:
    """A signed receipt: the verdict with hashes of all that it rests on. A score under the policy's floor makes it untrusted."""
    if verdict == "pass" and score < policy.mutation_score:
        verdict = "gate-untrusted"
    payload = {
        "version": 1, "destinations": manifest["payload"]["destinations"], "verdict": verdict, "manifest_hash": hashlib.sha256(canonical(manifest["payload"])).hexdigest(), "tree_hash": tree,
        "mutation_score": round(score, 6), "policy_hash": hashlib.sha256(canonical(vars(policy))).hexdigest(), "findings": sorted(findings), "at": utc(at),
    }
    return signer.sign(payload, private, public)


def armoured(data: bytes) -> str:
    return base64.b64encode(data).decode()
