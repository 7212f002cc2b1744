"""Owners of files by a trie of path segments: a file walks it once and the last rule that matches wins.

A rule file is read within a bound of bytes, so its trie is small enough for every task; files of any number are walked where
they lie, and no file meets every rule. Edges are literal segments, patterns of one segment, and two stars, which stay where
they are for any number of segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.readers import OWNERS_BYTES

RULE = "rule_no int, glob string, below boolean, owners string"
#: Owners of one rule, and diagnostics of one file, that are kept.
MAX_OWNERS, MAX_DIAGNOSTICS = 64, 50


class Node:
    __slots__ = ("below", "deep", "ends", "exact", "patterns", "rest")

    def __init__(self) -> None:
        self.exact: dict[str, Node] = {}
        self.patterns: dict[str, tuple[re.Pattern, Node]] = {}
        self.deep: Node | None = None
        #: Last rule that ends here, that takes all below and this, and that takes something below.
        self.ends = self.below = self.rest = -1


def segment_pattern(segment: str) -> re.Pattern:
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in segment), re.S)


class OwnerTrie:
    def __init__(self, rules: list[tuple[int, str, bool]]):
        """``rules`` are (number, glob, whether what is below a match belongs to it)."""
        self.root = Node()
        for number, glob, below in rules:
            node, segments = self.root, glob.split("/")
            for i, segment in enumerate(segments):
                if segment == "**" and i == len(segments) - 1:
                    node.rest = max(node.rest, number)
                    break
                if segment == "**":
                    node.deep = node.deep or Node()
                    node = node.deep
                elif "*" in segment or "?" in segment:
                    node = node.patterns.setdefault(segment, (segment_pattern(segment), Node()))[1]
                else:
                    node = node.exact.setdefault(segment, Node())
            else:
                if below:
                    node.below = max(node.below, number)
                else:
                    node.ends = max(node.ends, number)

    def match(self, path: str) -> int:
        """The number of the last rule that matches, or -1."""
        segments, best = path.split("/"), -1
        states = self._opened({self.root})
        for i in range(len(segments) + 1):
            for node in states:
                best = max(best, node.below, node.rest if i < len(segments) else node.ends)
            if i == len(segments):
                break
            after = {node for node in states if node in self._stays}
            for node in states:
                if found := node.exact.get(segments[i]):
                    after.add(found)
                after |= {to for pattern, to in node.patterns.values() if pattern.fullmatch(segments[i])}
            states = self._opened(after)
            if not states:
                break
        return best

    def _opened(self, states: set[Node]) -> set[Node]:
        """With the nodes behind two stars, which may take no segment and stay for more."""
        if not hasattr(self, "_stays"):
            self._stays: set[Node] = set()
        todo, out = list(states), set(states)
        while todo:
            deep = todo.pop().deep
            if deep is not None:
                self._stays.add(deep)
                if deep not in out:
                    out.add(deep)
                    todo.append(deep)
        return out


def owner_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, diagnostics) of an owners file: (rule_no, glob, below, owners) and (line, code).

    A name without a slash before its end matches at any depth; what is named also covers all below it, unless it ends in a
    star. Patterns with brackets or an exclamation mark are no rules, and come back as diagnostics with their line, as does a rule with
    more owners than are kept; a file at or above the bound of bytes is an error.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]
    if size >= OWNERS_BYTES:
        raise ValueError(f"{size} bytes of owners, less than {OWNERS_BYTES} may be")
    text = spark.read.text(path, wholetext=True).collect()[0][0] if size else ""
    rules, diagnostics = [], []
    for no, line in enumerate(text.removeprefix("﻿").split("\n")):
        words = line.split("#")[0].split()
        if not words:
            continue
        named, owners = words[0], sorted(words[1:])
        if any(c in named for c in "[]!") or not named.strip("/"):
            diagnostics.append((no + 1, "invalid_codeowner_pattern"))
            continue
        if len(owners) > MAX_OWNERS:
            diagnostics.append((no + 1, "codeowner_owner_limit"))
        anchored = named.startswith("/") or "/" in named.rstrip("/")
        glob = named.lstrip("/") if anchored else "**/" + named
        below = not glob.endswith(("/", "*"))
        glob += "**" if glob.endswith("/") else ""
        rules.append((no, glob, below, ",".join(owners[:MAX_OWNERS])))
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(diagnostics[:MAX_DIAGNOSTICS], "line int, code string")


def resolve_owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owners, rule_no) of ``files`` (path); both null where no rule matches. ``rules`` come of one bounded file."""
    held = [(r["rule_no"], r["glob"], r["below"], r["owners"]) for r in rules.collect()]
    schema = pa.schema([("path", pa.string()), ("owners", pa.string()), ("rule_no", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, owners = OwnerTrie([r[:3] for r in held]), {r[0]: r[3] for r in held}
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [-1 if p is None else trie.match(p) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([owners.get(n) for n in found], pa.string()), pa.array([None if n < 0 else n for n in found], pa.int32())], schema=schema)

    return files.select("path").mapInArrow(run, "path string, owners string, rule_no int")
