"""URL filters on a sorted digest array.

Rules are pairs of host and path start.  Their strings are hashed to 64 bits, and the hashes sorted
into one array that every executor maps into memory from a file.  A URL gives one candidate string
for each shape (labels of the host, characters of the path) that occurs among the rules; a batch of
candidates is looked up by one vectorised binary search, and a hit counts only if the stored string
is the same.  Of all rules that fit, the longest wins.

Defined results: null URLs and those without ``://`` have empty host and path and fit no rule.
Repeated rows are judged alike.  An empty table, or no rules, gives no matches.  Other columns are
kept; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.llm.common import lower_ascii
from glossaflow.session import shared_folder

HOST, PATH = r"(?s)://([^/?#]*)", r"(?s)://[^/?#]*([^?#]*)"
_PARTS = ("keys", "starts", "strings", "shapes", "verdicts")
_KIND = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def index_arrays(rules: Iterable[tuple[str, str, str]]) -> dict[str, np.ndarray]:
    """The arrays of an index over (verdict, host, path): sorted keys and what they stand for."""
    distinct = {host + path: (host, path, verdict) for verdict, host, path in rules}
    strings = sorted(distinct, key=lambda s: xxhash.xxh64_intdigest(s))
    encoded = [s.encode() for s in strings]
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in distinct.values()})
    return {
        "keys": np.array([xxhash.xxh64_intdigest(e) for e in encoded], "<u8"),
        "starts": np.cumsum([0, *map(len, encoded)]),
        "strings": np.frombuffer(b"".join(encoded), np.uint8),
        "shapes": np.array(shapes, np.int64).reshape(-1, 2),
        "verdicts": np.array([distinct[s][2] == "block" for s in strings], bool),
    }


@lru_cache(maxsize=4)
def _mapped(name: str) -> dict[str, np.ndarray]:
    def mapped(part):
        # An empty file cannot be mapped.
        path = SparkFiles.get(f"{name}-{part}.npy")
        return np.load(path, mmap_mode="r" if np.load(path).size else None)

    return {part: mapped(part) for part in _PARTS}


def probe(index: dict[str, np.ndarray], strings: list[str | None]) -> np.ndarray:
    """Position in the index of each string, or -1."""
    encoded = [None if s is None else s.encode() for s in strings]
    keys, found = index["keys"], np.full(len(encoded), -1, np.int64)
    asked = np.array([0 if e is None else xxhash.xxh64_intdigest(e) for e in encoded], "<u8")
    first, last = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    for i in np.flatnonzero(first < last):
        for k in range(first[i], last[i]):
            stored = index["strings"][index["starts"][k] : index["starts"][k + 1]].tobytes()
            if encoded[i] is not None and stored == encoded[i]:
                found[i] = k
                break
    return found


def match(index: dict[str, np.ndarray], hosts: list[str], paths: list[str]) -> np.ndarray:
    """Position of the longest rule that fits each URL, or -1."""
    best, length = np.full(len(hosts), -1, np.int64), np.full(len(hosts), -1, np.int64)
    labels = [h.split(".") for h in hosts]
    for count, size in index["shapes"].tolist():
        asked = [
            ".".join(x[-count:]) + p[:size] if len(x) >= count and len(p) >= size else None
            for x, p in zip(labels, paths)
        ]
        found = probe(index, asked)
        own = np.array([-1 if a is None else len(a) for a in asked], np.int64)
        better = (found >= 0) & (own > length)
        best[better], length[better] = found[better], own[better]
    return best


def publish(frame: DataFrame, rules: Iterable[tuple[str, str, str]]) -> str:
    """Hand the index to all executors as files, by way of the shared folder; returns its name."""
    spark, name = frame.sparkSession, f"urls-{uuid.uuid4().hex}"
    root = shared_folder(spark, "urls")
    files, base = pafs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    for part, values in index_arrays(rules).items():
        content = io.BytesIO()
        np.save(content, values)
        with files.open_output_stream(f"{base}/{name}-{part}.npy") as out:
            out.write(content.getvalue())
        spark.sparkContext.addFile(f"{root}/{name}-{part}.npy")
    return name


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """The rows with host, path, rule (null if none fits) and verdict.

    ``rules`` are (verdict, host, path), verdict being block or allow.
    """
    name = publish(pages, rules)

    @F.arrow_udf(_KIND)
    def looked_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        index = _mapped(name)
        rule, verdict = [], []
        for k in match(index, hosts.to_pylist(), paths.to_pylist()).tolist():
            stored = index["strings"][index["starts"][k] : index["starts"][k + 1]] if k >= 0 else None
            rule.append(None if k < 0 else stored.tobytes().decode())
            verdict.append(default if k < 0 else "block" if index["verdicts"][k] else "allow")
        return pa.StructArray.from_arrays(
            [pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"]
        )

    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return (
        pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("_found", looked_up("host", "path"))
        .select(*rest, "host", "path", "_found.rule", "_found.verdict")
    )
