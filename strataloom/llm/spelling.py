"""Spelling variants: words within one edit, from a positional q-gram index with a count filter.

Words are counted inside the tasks first, so a common word costs a row a task. One edit destroys at most q of the q-grams of
a word, so two words within one edit share all but that many, each at a place that differs by at most the difference
in length. Sorted from the rarest gram on, at least two of those shared lie among the first four of each word: such a pair
of grams with their places and the length of the word keys a list of the index. A task goes through its lists one by one:
it keeps the grams of a list's words as postings, merges for each word that asks the postings of its own grams with a heap,
leaving out places too far away, and verifies those words whose count reaches the bound. A list that would be long is cut
into parts, and every part of those who ask meets every part of those who are listed.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts, written

#: What no word holds; grams of two letters, grams that a key is made of and those that it is chosen among.
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
Q, KEYED, FIRST = 2, 2, 4
#: A longer text is read piece by piece, cut outside words; words that a task holds before it gives them on.
PIECE_CHARS, HELD_WORDS = 1 << 20, 1 << 17
#: Words of a list that one part holds, and up to which it is not worth merging.
PART_WORDS, FEW = 2048, 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = OTHER.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def misspelt(word: str, h: int) -> str:
    """The word without the letter that its checksum names."""
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counter(every: int, least: int):
    """(ident, text) to (word, n), summed over what a task holds at once."""
    # a shorter run cannot become a word, for only a letter goes
    run_of = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def rows(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = [w for w in counts if len(w) >= least]
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for ident, text in zip(batch.column("ident").to_pylist(), batch.column("text")):
                head = zlib.crc32(f"{ident}:".encode())
                deletes = every > 0 and ident is not None
                for piece in pieces(text.as_py() or ""):
                    for word, n in Counter(run_of.findall(piece)).items():
                        if not word.islower():
                            word = word.translate(_LOWER)
                        if deletes and not (h := zlib.crc32(word.encode(), head)) % every:
                            word = misspelt(word, h)
                        counts[word] = counts.get(word, 0) + n
                    if len(counts) >= HELD_WORDS:
                        yield from rows(counts)
                        counts.clear()
        yield from rows(counts)

    return run


def grams(word: str) -> list[tuple[str, int]]:
    return [(word[i : i + Q], i) for i in range(len(word) - Q + 1)]


def gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter(g for batch in batches for w in batch.column("word").to_pylist() for g, _ in grams(w))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


LISTED, BOTH, ASKS = 0, 1, 2


def keys(word: str, rarity: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(key, role): the lists that the word stands in, and those of words longer by one that it asks."""
    first = sorted(grams(word), key=lambda x: (rarity[x[0]], x))[:FIRST]
    for pair in combinations(first, KEYED):
        (g, i), (h, j) = sorted(pair, key=lambda x: x[1])
        yield f"{len(word)} {g}{i} {h}{j}", BOTH
    for pair in combinations(first[:-1], KEYED):
        (g, i), (h, j) = sorted(pair, key=lambda x: x[1])
        for x, y in ((i, j), (i, j + 1), (i + 1, j + 1)):
            yield f"{len(word) + 1} {g}{x} {h}{y}", ASKS


def keyer(rarity: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = [(k, role, w) for w in batch.column("word").slice(at, 4096).to_pylist() for k, role in keys(w, rarity)]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["key", "role", "word"])

    return run


def near(a: str, b: str) -> bool:
    """Exactly one edit apart; ``a`` is as long as ``b`` or shorter by one."""
    if a[:3] != b[:3] and a[-3:] != b[-3:]:
        return False  # of six letters or more one edit leaves the first three or the last three
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


class Postings:
    """The grams, with their places, of the words of one list, but for the grams of the list's key, which all share.

    While the words are few they are verified one by one, which costs less than to merge.
    """

    def __init__(self, key: str):
        self.key = key
        self.words: list[str] = []
        self.lists: dict[tuple[str, int], list[int]] = {}

    def add(self, word: str) -> None:
        self.words.append(word)
        if len(self.words) == FEW + 1:
            length, *of = self.key.split(" ")
            self.bound = int(length) - 2 * Q + 1 - KEYED
            self.skipped = {(g[:Q], int(g[Q:])) for g in of}
            for i, w in enumerate(self.words):
                self._post(w, i)
        elif len(self.words) > FEW:
            self._post(word, len(self.words) - 1)

    def _post(self, word: str, number: int) -> None:
        for gram in grams(word):
            if gram not in self.skipped:
                self.lists.setdefault(gram, []).append(number)

    def partners(self, word: str) -> list[str]:
        """Words of the list, as long or longer by one, whose count of shared grams reaches the bound, verified."""
        if not self.lists:
            return [x for x in self.words if near(word, x)]
        shifts = (0,) if len(word) == len(self.words[0]) else (0, 1)
        met = [own for g, i in grams(word) for d in shifts if (own := self.lists.get((g, i + d)))]
        out, last, count = [], -1, 0
        for number in heapq.merge(*met):
            count = count + 1 if number == last else 1
            last = number
            if count == self.bound and near(word, self.words[number]):
                out.append(self.words[number])
        return out


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, role, word), sorted; those that are listed come before those that only ask."""
    at, postings, found = None, None, []
    for batch in batches:
        for key, i, j, role, word in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "role", "word"))):
            if (key, i, j) != at:
                at, postings = (key, i, j), Postings(key)
            if role == ASKS:
                if postings.words:
                    found += [(word, x) for x in postings.partners(word) if len(x) > len(word) or x > word]
            else:
                if role == BOTH and postings.words:
                    found += [(min(word, x), max(word, x)) for x in postings.partners(word)]
                postings.add(word)
        columns = list(zip(*found)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["a", "b"])
        found = []


def counted_words(docs: DataFrame, least: int = 6, often: int = 5, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters of at least ``least`` letters that occur ``often`` times.

    ``every`` above 0 deletes a letter of those runs of a document whose checksum it divides; without identifier none.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("ident"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(counter(every, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of each two words one edit apart, once; the shorter one, or the smaller of two as long, is a.

    ``words`` is a written table of distinct words of at least six letters.
    """
    spark = words.sparkSession
    # pairs of letters: their number is bounded by the alphabet
    seen = words.mapInArrow(gram_counter, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    rarity = {r["gram"]: i for i, r in enumerate(sorted(seen, key=lambda r: (r["n"], r["gram"])))}
    keyed = written(words.select("word").mapInArrow(keyer(rarity), "key string, role int, word string"), "spelling-keys")
    sized = keyed.groupBy("key").agg(F.count(F.when(F.col("role") == BOTH, 1)).alias("listed"), F.count(F.when(F.col("role") == ASKS, 1)).alias("asking"))
    # a word alone in its list meets nobody
    sized = sized.where((F.col("listed") > 0) & (F.col("listed") + F.col("asking") > 1)).select("key", F.ceil(F.col("listed") / PART_WORDS).cast("int").alias("p"), F.ceil((F.col("listed") + F.col("asking")) / PART_WORDS).cast("int").alias("q"))
    rows = keyed.join(sized, "key")
    one, place = (F.col("p") == 1) & (F.col("q") == 1), F.xxhash64(F.lit("part"), "word")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(place, F.col(n)).cast("int")
    whole = rows.where(one).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "role", "word")
    listed = rows.where(~one & (F.col("role") == BOTH)).select("key", own("p").alias("i"), every("q").alias("j"), F.lit(LISTED).alias("role"), "word")
    asking = rows.where(~one).select("key", every("p").alias("i"), own("q").alias("j"), F.lit(ASKS).alias("role"), "word")
    dealt = whole.unionByName(listed).unionByName(asking).repartition(parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return dealt.mapInArrow(merged, "a string, b string").distinct()


def spelling_variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n, root.

    Words are the runs of ASCII and Latin-1 letters of all texts, A-Z lower-cased, of at least ``least`` (6 or more) letters
    and ``often`` occurrences. Two are near if one inserted, deleted or replaced letter makes one the other. A word's
    form is its near word of largest n, the smallest in code-point order of several, if that n is ``ratio`` (2 or more)
    times its own; root follows forms to the last one, and is the word itself if it has none. Null and empty texts have no
    words, repeated rows count again, a null identifier deletes no letter. No other column is read.
    """
    if least < 2 * Q + KEYED or ratio < 2:
        raise ValueError("words need six letters for the bound on shared grams, and forms twice the count for chains to end")
    words = written(counted_words(docs, least, often, every, id_col, text_col), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    sized = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    most = rows.agg(F.max("n")).collect()[0][0] or 1
    rooted = roots(rows.where("form is not null").select("word", "form"), math.log(most, ratio))
    return rows.join(rooted, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(forms: DataFrame, longest: float) -> DataFrame:
    """(word, root) by doubling what a word's pointer spans until it spans the ``longest`` chain."""
    to = forms.withColumnRenamed("form", "root")
    for _ in range(math.ceil(math.log2(longest + 1)) if longest > 0 else 0):
        further = to.select(F.col("word").alias("root"), F.col("root").alias("on"))
        to = written(to.join(further, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "spelling-roots")
    return to
