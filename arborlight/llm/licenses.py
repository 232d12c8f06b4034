"""License scans: an exact set-similarity join of text blocks with license templates.

A template of n words is sought in blocks of 2c words that start every c words, c being the least power of two of at
least n: each passage as long as the template lies whole in some block. Tokens of all templates are numbered by their
frequency over all documents, the rarest first; tokens outside the templates can't be shared, so a block's set is its
template tokens. A block meets a template if it contains the share ``threshold`` of the template's tokens, at least
``need`` of them. Only pairs that share a token among the first |T| - need + 1 of the template and the first
|B| - need + 1 of the block are looked at (prefix filter), if the block holds ``need`` tokens (length filter) and what
follows the shared token suffices (positional filter). All others can't meet the threshold, so the join is exact.

Sibling templates differ in a word or two, which the threshold lets pass. So a pair counts only if the block also tells the
template from its siblings: for each template of another label that would itself meet this one, some token that the other
lacks must be in the block; and where the template's own words hold the mark of its label (``MARKS``), so must the block's.

The templates' index goes to the executors with the scan; its size is bounded and checked.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import alnum_words, arrow_out, slices

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: What tells a license from those with nearly the same words, as a pattern over words in lower case with a space between.
MARKS = {
    "mit": r"\b(?:the|under|an?) mit\b|\bmit licen[cs]e\b",
    "apache": r"\bapache\b",
    "gpl": r"(?<!\blesser )(?<!\blibrary )(?<!\baffero )\bgeneral public\b",
    "lgpl": r"\b(?:lesser|library) general public\b",
    "agpl": r"\baffero general public\b",
    "mpl": r"\bmozilla public\b",
    "cc-by-nc": r"\bby nc\b",
    "cc-by-sa": r"\bby sa\b",
    "cc-by": r"\bcreative commons attribution\b(?! (?:non ?commercial|share ?alike|no ?deriv))",
}


class TemplateIndex:
    """Postings of the templates' prefixes, over tokens numbered from the rarest."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float, marks: dict[str, str] | None = None):
        words = [alnum_words(t) for _, t in templates]
        order = sorted({w for ws in words for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in words]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.width = [max(8, 1 << (len(ws) - 1).bit_length()) if ws else 0 for ws in words]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, s in enumerate(self.sets):
            for i, r in enumerate(s[: len(s) - self.need[t] + 1]):
                self.postings.setdefault(self.width[t], {}).setdefault(r, []).append((t, i))
        self.apart = self._apart()
        patterns = {label: re.compile(p.encode()) for label, p in (MARKS if marks is None else marks).items()}
        self.marks = [p if (p := patterns.get(label)) and p.search(b" ".join(ws)) else None for label, ws in zip(self.labels, words, strict=True)]
        self.least = {w: min(self.need[t] for t in range(len(self.sets)) if self.width[t] == w and self.sets[t]) for w in self.postings}
        self.prefix_words = frozenset(order[r] for p in self.postings.values() for r in p)

    def _apart(self) -> list[list[frozenset[int]]]:
        """For each template, what it has over each template of another label that meets it; none where that holds all of it."""
        holders: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            for r in s:
                holders.setdefault(r, []).append(t)
        out = []
        for t, s in enumerate(self.sets):
            near = {u for r in s[: len(s) - self.need[t] + 1] for u in holders[r] if self.labels[u] != self.labels[t]}
            over = {frozenset(s).difference(self.sets[u]) for u in near}
            out.append([x for x in over if x and len(s) - len(x) >= self.need[t]])
        return out

    def _told_apart(self, t: int, tokens: set[int], block: bytes) -> bool:
        return not any(x.isdisjoint(tokens) for x in self.apart[t]) and (self.marks[t] is None or self.marks[t].search(block) is not None)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word of the block, its end, containment) of all block and template pairs over the threshold that no sibling explains."""
        if self.prefix_words.isdisjoint(words):
            return []
        rank, out = self.rank, []
        at = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
        for width, postings in self.postings.items():
            starts = {k for i, r in at if r in postings for k in (i // width, i // width - 1) if k >= 0}
            inside: dict[int, set[int]] = {k: set() for k in starts}
            for i, r in at:
                for k in (i // width, i // width - 1):
                    if k in inside:
                        inside[k].add(r)
            for k, tokens in inside.items():
                if len(tokens) < self.least[width]:
                    continue
                block, seen = sorted(tokens), set()
                for j, r in enumerate(block[: len(block) - self.least[width] + 1]):
                    for t, i in postings.get(r, ()):
                        need = self.need[t]
                        if t in seen or j > len(block) - need:
                            continue
                        seen.add(t)
                        if 1 + min(len(self.sets[t]) - i, len(block) - j) - 1 < need:
                            continue
                        shared = sum(x in tokens for x in self.sets[t])
                        if shared >= need and self._told_apart(t, tokens, b" ".join(words[k * width : (k + 2) * width])):
                            out.append((t, k * width, min(len(words), (k + 2) * width), shared / len(self.sets[t])))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Starts of the phrases, as places in the words."""
    out = []
    for phrase, label in phrases:
        if not phrase:
            continue
        at, last = -1, phrase[-1]
        while True:  # the last word is the rarest of ours
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            s = at - len(phrase) + 1
            if s >= 0 and words[s : at + 1] == phrase:
                out.append((s, label))
    return out


def token_frequency(docs: DataFrame, text_col: str, tokens: set[bytes]) -> dict[bytes, int]:
    """Of all documents, how many hold each token; one row for each token comes to the driver."""

    def count(batches):
        seen: dict[bytes, int] = dict.fromkeys(tokens, 0)
        for batch in batches:
            for x in batch.column(0):
                for w in tokens.intersection(alnum_words(x.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    rows = docs.select(text_col).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None, threshold: float = 0.8, most: int = 200_000,
    marks: dict[str, str] | None = None,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks are the matching blocks: label, first word, end, containment. score is the greatest containment, 1 where a
    phrase stands. Null and empty texts have no words, no labels ('') and score 0. Repeated rows give repeated results,
    empty tables empty ones, and texts of any length are scanned whole. Other columns are not read. Templates are
    parameters on the driver, of ``most`` words in all (else ValueError: split them and scan once for each part).
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    listed = [(alnum_words(p), label) for p, label in phrases.items()]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if sum(len(alnum_words(t)) for _, t in templates) > most:
        raise ValueError(f"templates of more than {most} words")
    frequency = token_frequency(source, "text", {w for _, t in templates for w in alnum_words(t)})
    kind = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first:long,end:long,containment:double>>"
    block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(block))])

    def run(batches):
        index = TemplateIndex(templates, frequency, threshold, marks)
        for batch in slices(batches):
            rows = {f.name: [] for f in schema}
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = alnum_words(x.as_py())
                base = phrase_places(words, listed)
                found = [(index.labels[t], s, e, c) for t, s, e, c in index.matches(words)]
                base_labels = {label for _, label in base}
                values = (
                    i, len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None), ",".join(sorted(base_labels)),
                    ",".join(sorted(base_labels | {f[0] for f in found})), 1.0 if base else max((f[3] for f in found), default=0.0),
                    [{"label": f[0], "first": f[1], "end": f[2], "containment": f[3]} for f in sorted(found)],
                )
                for name, v in zip(rows, values, strict=True):
                    rows[name].append(v)
            yield arrow_out(schema, rows)

    return source.mapInArrow(run, kind).withColumnRenamed("id", id_col)
