"""Toxicity by a weighted finite-state grammar over clauses.

An automaton finds the words of a weighted lexicon in a text. Each clause that holds one is read as symbols
(insult, threat, intent, target, copula, negation, report, other). From right to left a transducer marks what a verb of
report follows; from left to right a cascade of five, composed into one, does the rest: negation marks the insults
and threats within its reach, report those behind it, insult tells a predicated one and one heaped on another from one
that stands by itself, target marks those that meet a second or third person, threat joins intent, threat verb and
target. Each mark is an arc with a weight learned from labelled rows; the weights of a clause's arcs add up, and those of
the clauses, with the text's length, give the score by a logistic curve. No word counts but by its arc.

The lexicon is learned from the labelled rows as well: words and word beginnings that toxic texts hold far
more often than others, counted once for each family of near copies.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, parts, quoted, written

#: Labelled rows that a model is fitted on at most, of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2000
#: A lexicon entry: least toxic families that hold it, least lower bound of its log odds, and its length as a word beginning.
SUPPORT, BOUND, BEGINNING = 4, 1.8, range(3, 10)
#: Words after a negation that it reaches.
REACH = 4

# Function words of the grammar in the four languages of the corpus.
INTENT = frozenset("will gonna shall going werde will wird vais va voy vamos va".split())
THREAT = frozenset("kill murder hurt beat destroy stab shoot töten umbringen schlagen tuer frapper matar golpear".split())
TARGET = frozenset("you your youre yourself he she they him her them these those du dich dir ihr euch sie tu toi vous te vos tú ti usted ustedes ellos ella él".split())
NEGATION = frozenset("not no never neither nor isnt arent wasnt dont doesnt nicht kein keine nie niemals pas jamais nunca tampoco jamás".split())
COPULA = frozenset("is are am was were be been being ist bist sind seid bin war waren est suis sont êtes était es eres son sois fue era".split())
REPORT = frozenset("said says say wrote writes called quoted reported claimed sagte sagt schrieb dit écrit dijo dice escribió".split())
#: Words that the grammar reads; none is an entry of the lexicon.
FUNCTION = INTENT | THREAT | TARGET | NEGATION | COPULA | REPORT

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n\r|]+")
QUOTES = re.compile(r"[\"“”«»„]")


class Transducer:
    """Deterministic: (state, symbol) gives (state, symbol); a pair that is not listed keeps the symbol and goes by ``other``."""

    def __init__(self, start, moves: dict, other=None):
        self.start, self.moves, self.other = start, moves, other

    def step(self, state, symbol: str):
        found = self.moves.get((state, symbol))
        if found is None:
            return (self.other(state) if self.other else state), symbol
        return found

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one writes, ``after`` reads."""
        out = Transducer((self.start, after.start), {})

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, last = after.step(state[1], middle)
            return (a, b), last

        out.step = step
        return out


def tabled(t: Transducer, alphabet: str) -> dict:
    """All transitions that can be reached, worked out once: state number and symbol to state number and symbol."""
    numbers, todo, table = {t.start: 0}, [t.start], {}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            to, written = t.step(state, symbol)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            table[numbers[state], symbol] = (numbers[to], written)
    return table


# Symbols read: I insult, T threat verb, W intent, Y target, C copula, N negation, R report or quotation, O other.
# Written besides: n negated insult or threat, r reported one, P predicated insult, H one after another insult,
# J insult that meets a target, K carried-out threat.
ALPHABET = "ITWYCNROr"
INSULTS = "IPHJ"
#: Marks that carry weight, and the weights of their arcs where no labelled row says otherwise.
PRIOR = {"I": 1.0, "P": 1.0, "H": 1.0, "J": 1.0, "n": 0.0, "r": 0.0, "K": 4.0}
MARKS = tuple(PRIOR)


def grammar() -> dict:
    """The cascade from left to right."""
    negation = Transducer(
        0,
        {(k, "N"): (REACH, "N") for k in range(REACH + 1)} | {(k, s): (k - 1, "n") for k in range(1, REACH + 1) for s in "IT"},
        lambda k: max(0, k - 1),
    )
    report = Transducer(0, {(0, "R"): (1, "R"), (1, "R"): (1, "R"), (1, "I"): (1, "r"), (1, "T"): (1, "r")})
    # 0 nothing, 1 to 3 words left that a copula reaches, 4 an insult before
    insult = Transducer(
        0,
        {(k, "C"): (3, "C") for k in range(5)} | {(0, "I"): (4, "I"), (4, "I"): (4, "H")} | {(k, "I"): (4, "P") for k in (1, 2, 3)},
        lambda k: k if k in (0, 4) else k - 1,
    )
    # 0 nothing, 1 a target, 2 an insult; a target after an insult completes it as well
    target = Transducer(0, {(0, "Y"): (1, "Y"), (2, "Y"): (1, "J")} | {(0, s): (2, s) for s in "IPH"} | {(1, s): (1, "J") for s in "IPH"} | {(2, s): (2, s) for s in "IPH"})
    threat = Transducer(0, {(0, "W"): (1, "W"), (1, "T"): (2, "T"), (2, "Y"): (0, "K"), (1, "W"): (1, "W")})
    return tabled(negation.then(report).then(insult).then(target).then(threat), ALPHABET)


def flat() -> dict:
    """The grammar taken away: every insult stands by itself."""
    return tabled(Transducer(0, {}), ALPHABET)


def reported(symbols: list[str]) -> list[str]:
    """From right to left: insults and threats that a verb of report follows within its reach."""
    out, k = list(symbols), 0
    for i in range(len(out) - 1, -1, -1):
        if out[i] == "R":
            k = REACH
        else:
            if k and out[i] in "IT":
                out[i] = "r"
            k = max(0, k - 1)
    return out


@dataclass
class Model:
    """Weights of words and of word beginnings, the arcs' weights for what a text has of them and for their share of
    its length (last: constant), and the grammar's transitions."""

    words: dict[str, float]
    beginnings: dict[str, float]
    curve: np.ndarray
    table: dict = field(default_factory=grammar)

    def ready(self) -> Model:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for entry in {*self.words, *self.beginnings, *THREAT}:
            self.found.add_word(entry, len(entry))
        self.found.make_automaton()
        self.reads = self.table != flat()
        return self

    def weight(self, word: str) -> float:
        if word in FUNCTION:
            return 0.0
        best = self.words.get(word, 0.0)
        for k in BEGINNING:
            if k > len(word):
                break
            best = max(best, self.beginnings.get(word[:k], 0.0))
        return best

    def clause(self, own: list[str], weights: list[float], quoted: bool) -> dict[str, float]:
        """What the arcs of a clause's path carry."""
        state, pending, at = 0, 0.0, ""
        marks = dict.fromkeys(MARKS, 0.0)
        if quoted:
            state, _ = self.table[state, "R"]
        symbols = ["I" if x else "T" if w in THREAT else "N" if w in NEGATION else "R" if w in REPORT else "W" if w in INTENT else "Y" if w in TARGET else "C" if w in COPULA else "O" for w, x in zip(own, weights)]
        for s, x in zip(reported(symbols) if self.reads else symbols, weights):
            state, mark = self.table[state, s]
            if s == "I" and mark in INSULTS:
                marks[mark] += x
                pending, at = (x, mark) if mark != "J" else (0.0, "")
            elif mark == "J" and pending:  # the target came after the insult
                marks[at] -= pending
                marks["J"] += pending
                pending = 0.0
            elif mark in "nr":
                marks[mark] += x or 1.0
            elif mark == "K":
                marks["K"] += 3.0
        return marks

    def features(self, text: str | None) -> np.ndarray:
        """Of each mark, what the text's clauses carry (by its logarithm) and its share of the text's length."""
        out = np.zeros(2 * len(MARKS))
        if not text:
            return out
        low = text.lower()
        for end, size in self.found.iter(low):
            if end == size - 1 or not low[end - size].isalpha():
                break
        else:
            return out
        words, total = 0, np.zeros(len(MARKS))
        for clause in CLAUSE.split(low):
            own = WORD.findall(clause)
            words += len(own)
            weights = [self.weight(w) for w in own]
            if any(weights) or not THREAT.isdisjoint(own):
                marks = self.clause(own, weights, bool(QUOTES.search(clause)))
                total += [marks[m] for m in MARKS]
        total = np.maximum(total, 0)
        return np.concatenate([np.log1p(total), total / math.sqrt(max(1, words))])

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.curve[:-1] + self.curve[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def family(text: str) -> int:
    """Texts with most of their words in common tend to share the smallest hash of five words in a row."""
    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def lexicon(counts: list[tuple[str, int, int]], n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    """Entries with their log odds, from how many toxic and other families hold them. Where a shorter beginning says as
    much as an entry, the entry is left out, but the longest stays of those that are as common as each other."""
    hits, misses = {e: a for e, a, _ in counts}, {e: b for e, _, b in counts}
    odds, bound = {}, {}
    for e, a in hits.items():
        b = misses[e]
        odds[e] = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        bound[e] = odds[e] - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) if a >= SUPPORT else 0.0
    kept: dict[str, float] = {}
    for e in sorted((e for e in odds if bound[e] >= BOUND), key=lambda e: (len(e.rstrip("*")), not e.endswith("*"), e)):
        root = e.rstrip("*")
        over = [o for k in BEGINNING if k < len(root) + (e == root) and (o := root[:k] + "*") in kept]
        same = [o for o in over if hits[o] == hits[e] and misses[o] == misses[e]]
        if any(o not in same and bound[o] >= bound[e] for o in over):
            continue
        for o in same:
            del kept[o]
        kept[e] = odds[e]
    return {e: w for e, w in kept.items() if not e.endswith("*")}, {e[:-1]: w for e, w in kept.items() if e.endswith("*")}


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, shrunk towards the arcs' prior weights; the constant is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*PRIOR.values(), *[0.0] * len(PRIOR), 0.0])
    c = prior.copy()
    shrink = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink, x.T @ (y - p) - shrink @ (c - prior))
        c += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return c


def _families(texts: pa.Array) -> list[int]:
    """The family of each text; near copies fall into one half of the families."""
    return [family(t.as_py() or "") for t in texts]


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, table: dict | None = None) -> Model:
    """Fit on at most ``sample_toxic`` and ``sample_clean`` labelled documents, chosen by a hash of their identifier.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; null labels and identifiers are left out, of
    several labels of one document the larger counts and of several texts the smallest, so repeated rows add nothing.
    Texts stay with the executors: the driver gets counts of the entries that enough toxic families hold and what the
    arcs carry in each row. The lexicon is learned on all rows; the curve sees each row by that of the other half of
    the families. ``table`` is the grammar, other than its own for comparison.
    """
    table = grammar() if table is None else table
    bounded_batches(docs.sparkSession)
    each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = [each.where(F.col("toxic") == y).orderBy(draw, "doc_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = written(rows.repartition(min(16, parts(docs.sparkSession)), "doc_id"), "toxicity-sample")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            words = [sorted(set(WORD.findall((t.as_py() or "").lower())) - FUNCTION) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(_families(texts), pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["family", "toxic", "words"])

    own = written(rows.select("text", "toxic").mapInArrow(read, "family long, toxic int, words array<string>"), "toxicity-words")
    half = F.pmod("family", F.lit(2))
    sizes = {(r["half"], r["toxic"]): r["n"] for r in own.groupBy(half.alias("half"), "toxic").agg(F.countDistinct("family").alias("n")).collect()}
    n_of = lambda y, *halves: sum(sizes.get((h, y), 0) for h in halves)
    if not n_of(0, 0, 1) or not n_of(1, 0, 1):
        n1, n0 = n_of(1, 0, 1), n_of(0, 0, 1)
        rate = (n1 + 0.5) / (n1 + n0 + 1)
        return Model({}, {}, np.array([0.0] * 2 * len(MARKS) + [math.log(rate / (1 - rate))]), table)
    word = F.col("word")
    begins = F.transform(F.sequence(F.lit(BEGINNING[0]), F.least(F.lit(BEGINNING[-1]), F.length(word) - 1)), lambda k: F.concat(F.substr(word, F.lit(1), k), F.lit("*")))
    entries = F.explode(F.concat(F.array(word), F.when(F.length(word) > BEGINNING[0], begins).otherwise(F.array().cast("array<string>")))).alias("entry")
    distinct = own.select("family", "toxic", F.explode("words").alias("word")).distinct().select("family", "toxic", entries).distinct()
    when = lambda y, h: F.count(F.when((F.col("toxic") == y) & (half == h), 1)).alias(f"n{y}{h}")
    counts = distinct.groupBy("entry").agg(*[when(y, h) for y in (1, 0) for h in (0, 1)]).where(F.col("n10") + F.col("n11") >= SUPPORT).collect()
    of = lambda *halves: lexicon([(r["entry"], sum(r[f"n1{h}"] for h in halves), sum(r[f"n0{h}"] for h in halves)) for r in counts], n_of(1, *halves), n_of(0, *halves))
    others = [of(1), of(0)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(*entry, np.zeros(0), table).ready() for entry in others]
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            seen = [models[family(t or "") % 2].features(t).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(seen, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    weighed = sorted(rows.mapInArrow(weigh, "doc_id long, toxic int, x array<double>").collect(), key=lambda r: r["doc_id"])
    return Model(*of(0, 1), curve(np.array([r["x"] for r in weighed]), np.array([float(r["toxic"]) for r in weighed])), table)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on) beside its own columns, every row included.

    Null and empty texts hold no clause and get the score of a text without matches. Long texts are read
    whole. Equal texts get equal scores. Columns of ``docs`` with these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    packed = pickle.dumps((model.words, model.beginnings, model.curve, model.table))

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*pickle.loads(packed)).ready()
        for texts in columns:
            yield pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    own, back = carried(docs, "score", "predicted")
    return docs.select(*own, scored(F.col(quoted(text_col))).alias("score")).select(*back, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
