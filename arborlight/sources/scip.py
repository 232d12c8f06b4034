"""Code indexes in the SCIP protobuf format: occurrences of symbols as rows. The wire format is decoded here; no classes are needed."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCES = "tool string, path string, symbol string, line long, is_def boolean, is_import boolean"
MOST_BYTES = 512 << 20
PLACES = ("index.scip", ".index/index.scip", ".index/scip/*.scip")


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def fields(data: memoryview):
    """(number, value) of a message: ints, or views of what is length-delimited; ValueError where it is cut off."""
    at = 0
    try:
        while at < len(data):
            key, at = _varint(data, at)
            number, kind = key >> 3, key & 7
            if kind == 0:
                value, at = _varint(data, at)
            elif kind == 2:
                size, at = _varint(data, at)
                if at + size > len(data):
                    raise ValueError("a field that is cut off")
                value, at = data[at : at + size], at + size
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
                value, at = bytes(data[at : at + size]), at + size
            else:
                raise ValueError(f"a field of unknown kind {kind}")
            yield number, value
    except IndexError as e:
        raise ValueError("a message that is cut off") from e


def parse_index(data: bytes):
    """(tool, path, symbol, line from 1, is definition, is import) of each occurrence that has a range and a symbol."""
    if len(data) > MOST_BYTES:
        raise ValueError(f"an index of more than {MOST_BYTES} bytes")
    tool, documents = None, []
    for number, value in fields(memoryview(data)):
        if number == 1:
            for n, v in fields(value):
                if n == 2:
                    tool = next((bytes(x).decode("utf-8", "replace") for k, x in fields(v) if k == 1), None)
        elif number == 2:
            documents.append(value)
    for document in documents:
        path, occurrences = "", []
        for n, v in fields(document):
            if n == 1:
                path = bytes(v).decode("utf-8", "replace")
            elif n == 2:
                occurrences.append(v)
        for o in occurrences:
            start, symbol, roles = None, "", 0
            for n, v in fields(o):
                if n == 1 and start is None:
                    start = v if isinstance(v, int) else _varint(v, 0)[0] if len(v) else None
                elif n == 2:
                    symbol = bytes(v).decode("utf-8", "replace")
                elif n == 3:
                    roles = v
            if start is not None and symbol:
                yield tool, path, symbol, start + 1, bool(roles & 1), bool(roles & 2)


def discover(root: str) -> list[str]:
    """Index files of a project, in order."""
    return [p for place in PLACES for p in sorted(glob.glob(os.path.join(root, place)))]


def read_scip(spark: SparkSession, *paths: str) -> DataFrame:
    """Occurrences of index files, each decoded by one task, with the index's time (mtime); a malformed one raises."""
    schema = pa.schema([("tool", pa.string()), ("path", pa.string()), ("symbol", pa.string()), ("line", pa.int64()), ("is_def", pa.bool_()), ("is_import", pa.bool_()), ("mtime", pa.int64())])

    def decode(batches):
        for b in batches:
            for content, mtime in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in parse_index(content.as_py()):
                    rows.append((*r, mtime))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("content", F.unix_millis("modificationTime").alias("mtime")).mapInArrow(decode, f"{OCCURRENCES}, mtime long")
