"""What commits and people's words tell: style of lines, samples of commits, explicit statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.text import redacted

#: Commits that are read at most, and lines beyond which one is a bulk change.
SAMPLE_CAP, BULK_LINES = 400, 2000

# For each detector what speaks for its claim in a line and what against.
STYLE = {
    "indentation_spaces": (r"^ {2,}\S", r"^\t+\S"),
    "double_quotes": (r'"[^"\']*"', r"(?:^|[\s(=,])'[^'\"]{2,}'"),
    "short_lines": (r"^.{1,100}$", r"^.{101}"),
    "line_comments": (r"^\s*(//|#)\s*\S", r"^\s*/\*"),
    "braces_same_line": (r"\S\s*\{\s*$", r"^\s*\{\s*$"),
    "constants": (r"\b(const|let|val|final)\s+\w", r"\bvar\s+\w"),
    "templates": (r"`[^`]*\$\{|\bf\"[^\"]*\{|\bformat!?\(", r"\"\s*\+\s*\w|\w\s*\+\s*\""),
}


def style_tallies(lines: DataFrame) -> DataFrame:
    """(sha, predicate, yes, no) of added lines (sha, line): how many speak for and against each claim."""
    flag = lambda p, pattern: F.count_if(F.col("line").rlike(pattern)).alias(p)
    wide = lines.groupBy("sha").agg(*(flag(f"{k}__{i}", p) for k, pair in STYLE.items() for i, p in enumerate(pair)))
    each = F.array(*(F.struct(F.lit(k).alias("predicate"), F.col(f"{k}__0").alias("yes"), F.col(f"{k}__1").alias("no")) for k in STYLE))
    return wide.select("sha", F.explode(each).alias("t")).select("sha", "t.predicate", "t.yes", "t.no")


def subject_tallies(subjects: DataFrame) -> DataFrame:
    """The same of (sha, subject, body): a subject in the imperative, short and without a full stop, and whether there is a body."""
    first = F.lower(F.split("subject", r"\s+")[0])
    imperative = (~first.rlike(r"(ed|ing)$")).cast("int")
    plain = (~F.col("subject").endswith(".") & (F.char_length("subject") <= 72)).cast("int")
    body = (F.char_length(F.trim(F.coalesce("body", F.lit("")))) > 0).cast("int")
    each = F.array(*(F.struct(F.lit(k).alias("predicate"), c.alias("yes"), (1 - c).alias("no")) for k, c in (("subject_imperative", imperative), ("subject_plain", plain), ("body", body))))
    return subjects.select("sha", F.explode(each).alias("t")).select("sha", "t.predicate", "t.yes", "t.no")


def sample(commits: DataFrame, cap: int = SAMPLE_CAP, bulk: int = BULK_LINES) -> DataFrame:
    """The commits (sha, at, added) that are read: of each month in turn, the newest month first, the newest commit of
    each first. Commits without added lines and bulk changes are left out."""
    rows = commits.where((F.col("added") > 0) & (F.col("added") <= bulk)).withColumn("month", F.date_format("at", "yyyy-MM"))
    turn = F.row_number().over(Window.partitionBy("month").orderBy(F.col("at").desc(), "sha"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= cap).orderBy("turn", F.col("month").desc()).limit(cap)


# How a statement about oneself begins, by kind, and beginnings of words that tell of work.
CUES = {
    "possible_stated_preference": ("my default is ", "i would rather ", "i value ", "i prefer "),
    "possible_self_report": ("i generally ", "i normally ", "i always ", "i avoid ", "my habit is to ", "i usually "),
    "possible_correction": ("in future replies, ", "for future reviews, ", "from now on, ", "from now on ", "going forward, "),
}
WORK = ("code", "coding", "review", "test", "commit", "repo", "task", "plan", "chang", "output", "document", "workflow", "reply", "repli", "answer", "debug", "clarif")
#: Characters of a statement.
STATEMENT = (8, 300)


def statement_kind(column: Column) -> Column:
    """The kind of an explicit statement: one line that begins with a cue and tells of work, asks nothing and holds no
    secret; null for any other text."""
    low = F.lower(F.trim(column))
    kind = F.lit(None).cast("string")
    for name, cues in reversed(CUES.items()):
        kind = F.when(low.rlike("^(" + "|".join(cues) + ")"), name).otherwise(kind)
    about = low.rlike(r"(?:^|[^\p{L}\p{N}])(" + "|".join(WORK) + ")")
    plain = F.char_length(F.trim(column)).between(*STATEMENT) & ~column.rlike(r"[\p{Cc}?]") & redacted(column).isNotNull()
    return F.when(plain & about, kind)


# Characters that change how text is shown.
UNSAFE = "\\p{Cc}\\x{061c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}"


def shown(column: Column) -> Column:
    """Text without characters that control or turn around what is displayed; null where nothing visible is left."""
    return F.nullif(F.regexp_replace(column, f"[{UNSAFE}]", ""), F.lit(""))


# Names of functions around tests, and marks of tests and of fixtures.
LIFECYCLE = "setup teardown setup_method teardown_method beforeeach aftereach beforeall afterall testinitialize testcleanup".split()
TEST_MARKS = "test tokio::test async_std::test Fact Theory TestMethod TestCase ParameterizedTest".split()
FIXTURE_MARKS = "fixture pytest.fixture SetUp TearDown".split()


def test_symbol(name: Column, decorators: Column, test_path: Column) -> Column:
    """Whether a symbol is a test: by its marks, or by name in a file of tests; what only surrounds tests is none."""
    marks = F.coalesce(decorators, F.lit(""))
    has = lambda words: F.greatest(*(marks.contains(f",{w},") for w in words))
    named = F.lower(name).startswith("test") | F.lower(name).isin("it", "spec")
    return ~F.lower(name).isin(LIFECYCLE) & ~has(FIXTURE_MARKS) & (has(TEST_MARKS) | (test_path & named))
