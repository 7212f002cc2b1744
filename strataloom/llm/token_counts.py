"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, n_tokens). Documents are reduced to their digests,
the distinct ones that the cache lacks pick one document each, only those texts travel and are encoded, and
their counts are appended. Every document then gets its count by a join with the cache. Content is normalised only
in that no text is an empty text: white space, case and composition all change a text's tokens, so a digest of
anything but the text itself would give one count to texts that have two.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, quoted, text_of, written

#: A longer text is encoded piece by piece, cut where the pre-tokenizer always cuts.
PIECE_CHARS = 1 << 16
CACHE = "content string, tokenizer string, n_tokens long"
SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut before a blank between two ASCII letters: there every word-splitting rule of this tokenizer ends a word."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes as they are, others from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Counts as the library of the file gives them, without added special tokens."""

    def __init__(self, name: str, blob: bytes):
        import tiktoken

        self.fast = None
        spec = json.loads(blob)
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if plain and not spec.get("normalizer") and not spec["model"].get("unk_token") and not spec["model"].get("dropout"):
            letters = _byte_letters()
            special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            if all(t.get("special") and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", ())):
                self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_str(blob.decode())

    def count(self, text: str) -> int:
        if self.fast is None:
            return len(self.exact.encode(text, add_special_tokens=False).ids)
        return sum(len(self.fast.encode(p, allowed_special="all")) for p in pieces(text))


#: Fixed value: the published word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_COUNTERS: dict[str, Counter] = {}


def counter_of(tokenizer: str, packed: bytes) -> Counter:
    """The counter of a worker process, which its tasks share: a vocabulary takes much memory and time to set up."""
    if tokenizer not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[tokenizer] = Counter(tokenizer, base64.b64decode(packed))
    return _COUNTERS[tokenizer]


def encoder(blob: bytes, tokenizer: str):
    schema = pa.schema([("content", pa.string()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])
    packed = base64.b64encode(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = counter_of(tokenizer, packed)
            counts = [counter.count(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([tokenizer] * len(counts), pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return run


def tokenizer_digest(blob: bytes) -> str:
    import tokenizers

    return hashlib.sha256(blob + b"|" + tokenizers.__version__.encode()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens beside its own columns; new counts are appended to the table at ``cache``.

    A null text is empty and has 0 tokens. Repeated rows each get their count; a null identifier does too.
    Texts of any length are encoded whole. Columns of ``docs`` with these names are replaced. ``tokenizer_path``
    is a file on the driver and of a fixed size; it reaches the tasks with their code. Counts that concurrent
    runs have both appended are equal, and one of them is used.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        blob = f.read()
    version = tokenizer_digest(blob)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    text = text_of(text_col)
    content = F.sha2(text, 256)
    chosen = docs.select(content.alias("content"), F.col(quoted(id_col)).cast("string").alias("id")).groupBy("content").agg(F.min("id").alias("id"))
    misses = chosen.join(stored(), "content", "left_anti")
    # one document of each missing digest: only its row finds its identifier and digest among the misses
    texts = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), content.alias("content"), text.alias("text"))
    to_do = texts.join(misses.hint("shuffle_hash"), (texts["id"].eqNullSafe(misses["id"])) & (texts["content"] == misses["content"]), "left_semi")
    to_do.select("content", "text").mapInArrow(encoder(blob, version), CACHE).write.mode("append").parquet(cache)
    own, back = carried(docs, "n_bytes", "n_tokens")
    rows = docs.select(*own, F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content__"))
    # a plain table: only then can a join split the rows of one very common text
    counts = written(stored().withColumnRenamed("content", "content__"), "token-counts")
    return rows.join(counts, "content__").select(*back, "n_bytes", "n_tokens")
