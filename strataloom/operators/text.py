"""Full-text retrieval over term tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
# Weights of the fields of a symbol.
FIELD_WEIGHTS = {"name": 10, "path": 4, "signature": 2, "documentation": 1}
# Words that carry no weight in a question unless there are no others.
FUNCTION_WORDS = frozenset("a an and are as at by does for from how in is it of on or that the this to what where which with".split())
# Values that stand for a secret without being one, and what the name of a secret ends with.
PLACEHOLDERS = "placeholder redacted changeme change_me change-me dummy fake test none null value todo secret_here token_here password_here api_key_here".split()
PLACEHOLDER_STARTS = ["${", "{{", "<", "example_", "example-", "your_", "your-"]
SECRET_NAMES = "apikey secret token password".split()


def _secret_patterns() -> list[str]:
    """Patterns of a private key, an access key, a bearer and an assigned secret, each within one line."""
    blank, stop = r"[^\S\n]", r"""\s"'`,;)\]}"""
    ends = rf"(?=[{stop}]|$)"
    stands_for = "|".join([*(re.escape(s) for s in PLACEHOLDER_STARTS), rf"(?:{'|'.join(map(re.escape, [*PLACEHOLDERS, 'example']))}){ends}", rf"[x*_.\-]*{ends}"])
    value = rf"(?!{stands_for})[^{stop}]"
    spelt = lambda gap: "|".join(gap.join(w) for w in SECRET_NAMES)
    # before a colon the name is all of the line's beginning, before an equals sign its last word
    of_line, of_word = r"[^A-Za-z0-9\s]*", r"[^A-Za-z0-9\s,;({]*"
    colon = rf"^{blank}*[-*+>`]*{blank}*\S*?(?:{spelt(of_line)}){of_line}{blank}*:"
    equals = rf"(?:^|[\s,;({{])[^\s,;({{]*?(?:{spelt(of_word)}){of_word}{blank}*="
    return [
        r"(?is)-----begin .*private key-----",
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
        rf"""(?im)(?<![a-z0-9_])authorization{blank}*["'`]?{blank}*[:=]{blank}*["'`]*bearer{blank}+{value}""",
        rf"""(?im)(?:{colon}|{equals}){blank}*["'`]*{value}""",
    ]


def tokens(column: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def code_tokens(column: Column) -> Column:
    """Words of identifiers: split at punctuation, camel case, acronyms and digits, with the whole kept beside its parts."""
    spaced = F.regexp_replace(F.regexp_replace(column, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = tokens(F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2"))
    return F.array_distinct(F.concat(tokens(column), parts))


def question_terms(question: str) -> list[str]:
    """Terms of a natural question: function words go unless nothing else is left."""
    words = [w for w in re.split(r"[^\w]+", question.lower()) if w]
    kept = [w for w in words if w not in FUNCTION_WORDS]
    return list(dict.fromkeys(kept or words))


def parse_query(text: str) -> list[tuple[str, list[str]]]:
    """(operator, words) of a query: quoted or hyphenated words are phrases, OR, NOT and a star at the end as usual."""
    out, sign = [], "and"
    for phrase, word in re.findall(r'"([^"]+)"|(\S+)', text):
        if word in ("OR", "NOT", "AND"):
            sign = word.lower()
            continue
        words = [w for w in re.split(r"[^\w]+", (phrase or word).lower()) if w]
        if words:
            out.append((sign + ("*" if word.endswith("*") else ""), words))
        sign = "and"
    return out


def postings(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf, n): the inverted index with document lengths."""
    each = docs.select(key, tokens(F.col(column)).alias("t"))
    rows = each.select(key, F.size("t").alias("n"), F.explode("t").alias("term"))
    return rows.groupBy(key, "term", "n").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, key: str, terms: list[str], n_docs: int, mean: float, need: int | None = None) -> DataFrame:
    """(key, hits, score): documents with at least ``need`` of the terms (all by default), the best the highest."""
    asked = index.where(F.col("term").isin(*terms))
    df = F.broadcast(asked.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    rows = asked.join(df, "term").groupBy(key).agg(F.count_distinct("term").alias("hits"), F.sum(part).alias("score"))
    return rows.where(F.col("hits") >= (len(terms) if need is None else need))


def floors(n: int) -> tuple[int, int]:
    """Least hits of a partial match for ``n`` terms: half of them and two, and the floor for ranking terms."""
    half = max(2, -(-n // 2))
    return half, min(3, half)


def concept(fields: DataFrame, terms: list[str]) -> DataFrame:
    """(id, hits, weight): symbols by distinct terms and weighted occurrences; all terms, or half from three terms on."""
    n = len(terms)
    need = n if n < 3 else floors(n)[0]
    weight = F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))
    rows = fields.where(F.col("term").isin(*terms)).groupBy("id").agg(F.count_distinct("term").alias("hits"), F.sum(weight[F.col("field")] * F.col("tf")).alias("weight"))
    return rows.where(F.col("hits") >= need)


def phrase_docs(docs: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """Documents that hold the words in a row: shifted positions meet."""
    each = docs.select(key, F.posexplode(tokens(F.col(column))).alias("pos", "term")).where(F.col("term").isin(*words))
    table = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(words)), "offset int, term string"))
    rows = each.join(table, "term").select(key, (F.col("pos") - F.col("offset")).alias("start"), "offset").distinct()
    return rows.groupBy(key, "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select(key).distinct()


def redacted(column: Column) -> Column:
    """The text, or null where it shows a secret.

    What a pattern cannot match without is looked for first; bearers and assigned secrets stand in one line with a colon or an
    equals sign, so only such lines are searched for them.
    """
    key, access, bearer, assigned = _secret_patterns()
    lines = F.array_join(F.filter(F.split(column, "\n"), lambda line: line.contains("=") | line.contains(":")), "\n")
    found = (column.contains("-----") & column.rlike(key)) | ((column.contains("AKIA") | column.contains("ASIA")) & column.rlike(access))
    return F.when(~(found | lines.rlike(bearer) | lines.rlike(assigned)), column)


def best_lines(docs: DataFrame, key: str, column: str, terms: list[str], top: int = 1) -> DataFrame:
    """The lines with the most of the terms, the earliest first."""
    lines = docs.select(key, F.posexplode(F.split(column, "\n")).alias("line", "text"))
    hits = F.size(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, terms))))
    w = Window.partitionBy(key).orderBy(F.col("hits").desc(), "line")
    return lines.withColumn("hits", hits).where("hits > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def _measure(stem: str) -> int:
    """Number of vowel runs that a consonant run follows."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return bool(re.search(r"[aeiou]|(?<=[^aeiou])y", stem))


# Suffixes of the published Porter stemmer, steps two to four.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# The same, the longest suffix first, and all of a step's suffixes at once: most words have none of them.
RULES23 = [([tuple(r.split(":")) for r in sorted(step, key=lambda r: -len(r.split(":")[0]))], tuple(r.split(":")[0] for r in step)) for step in (STEP2, STEP3)]
RULES4 = (sorted(STEP4, key=len, reverse=True), tuple(STEP4))


def porter(word: str) -> str:
    """The published Porter stemmer for English."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _measure(w) == 1 and re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in RULES23:
        for end, new in table if w.endswith(ends) else ():
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in RULES4[0] if w.endswith(RULES4[1]) else ():
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else porter(w))

    return run(column)
