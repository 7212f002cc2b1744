"""Exact dedup by Patricia-trie owners.

1. Each input task inserts the normalised bytes of its rows into a compressed radix trie, so a text that
   a task sees a million times leaves it once (a hot group of copies costs one row a task).
2. Length and content hash deal the surviving byte strings to owner partitions; there they arrive in byte
   order and the owner inserts them into its own trie. Terminals hold the smallest identifier and the count.
3. Both tries hold at most ``budget`` bytes: labels, and ``NODE_BYTES`` for each node. Beyond it subtrees are
   spilled: the input side sends its heaviest ones on (their terminals are partial, the owners add them up). On
   the owner side strings come in byte order, so before a new one all that the trie holds lies left of it and is complete;
   there every subtree is emitted and the trie starts anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, carried, parts, quoted, text_of

#: Bytes of labels that one trie may hold.
TRIE_BYTES = 48 << 20
#: What a node with a table of its children takes beside its label, as measured.
NODE_BYTES = 400
BATCH_BYTES = 4 << 20


class Node:
    __slots__ = ("count", "kids", "label", "least")

    def __init__(self, label: bytes):
        self.label, self.kids, self.count, self.least = label, {}, 0, None


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Byte strings by compressed edges. A terminal holds how often its string came and its smallest identifier."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, least: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(kid.label) + NODE_BYTES
                at = len(key)
            elif key.startswith(kid.label, at):
                at += len(kid.label)
            else:
                n = shared(kid.label, key, at)
                fork = node.kids[key[at]] = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                self.size += NODE_BYTES
                kid, at = fork, at + n
            node = kid
        node.count += count
        if least is not None and (node.least is None or least < node.least):
            node.least = least

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            key = before + at.label
            if at.count:
                yield key, at.least, at.count
            stack.extend((kid, key) for kid in at.kids.values())

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            at = stack.pop()
            total += len(at.label) + NODE_BYTES
            stack.extend(at.kids.values())
        return total

    def spill(self, keep: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the heaviest subtrees until at most ``keep`` bytes of labels are left."""
        while self.size > keep and self.root.kids:
            node, prefix = self.root, b""
            weights = {b: self.weight(kid) for b, kid in node.kids.items()}
            for b in sorted(weights, key=weights.get, reverse=True):
                yield from self.terminals(node.kids.pop(b), prefix)
                self.size -= weights[b]
                if self.size <= keep:
                    return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def gather(budget: int):
    """Input side: (body, least, count) of each distinct string of a task, partial where the trie has spilled."""
    schema = pa.schema([("body", pa.binary()), ("least", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            trie = RadixTrie()
            for body, ident in _rows(batches, ["body", "ident"]):
                trie.insert(body, ident, 1)
                if trie.size > budget:
                    yield from trie.spill(budget // 2)
            yield from trie.terminals()

        yield from _batches(out(), schema)

    return run


def own(budget: int):
    """Owner side: strings come in byte order, so what lies left of the last one is complete."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            trie, last = RadixTrie(), None
            for body, least, count in _rows(batches, ["body", "least", "count"]):
                if trie.size > budget and body != last:
                    for key, low, n in trie.terminals():
                        yield hashlib.sha256(key).hexdigest(), low, n
                    trie = RadixTrie()
                trie.insert(body, least, count)
                last = body
            for key, low, n in trie.terminals():
                yield hashlib.sha256(key).hexdigest(), low, n

        yield from _batches(out(), schema)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 beside its own columns, every row included.

    Texts are equal when they are after each run of white space has become one space; a null text is empty.
    keep_id is the smallest identifier of the group. Null identifiers never win; a group that has no other
    has keep_id null and keeps its rows. Repeated rows count in group_size and share the verdict of their
    identifier. Columns of ``docs`` named like one of the four are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    body = F.regexp_replace(text_of(text_col), SPACE, " ")
    found = (
        docs.select(F.col(quoted(id_col)).cast("long").alias("ident"), body.cast("binary").alias("body"))
        .mapInArrow(gather(budget), "body binary, least long, count long")
        .select("*", F.length("body").alias("n_bytes"), F.xxhash64("body").alias("content_hash"))
        .repartition(parts(spark), "n_bytes", "content_hash")
        .sortWithinPartitions("body")
        .select("body", "least", "count")
        .mapInArrow(own(budget), "text_sha256 string, keep_id long, group_size long")
    )
    own_columns, back = carried(docs, "keep_id", "group_size", "kept", "text_sha256")
    ident = F.col(quoted(id_col)).cast("long")
    rows = docs.select(*own_columns, ident.alias("ident"), F.sha2(body, 256).alias("text_sha256"))
    return rows.join(found, "text_sha256").select(*back, "keep_id", "group_size", F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
