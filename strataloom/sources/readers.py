"""Readers of evidence formats into the relations that the roll-ups take."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators.text import redacted

#: Largest source file that is read, and how much of it is searched for a zero byte.
MAX_BYTES, SNIFF_BYTES = 5 << 20, 8 << 10
SKIPPED_DIRS = ("/.git/", "/node_modules/", "/target/", "/vendor/", "/dist/", "/build/")


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern over paths from the root, whether it ignores) of an ignore file, in its order."""
    rules = []
    for line in text.split("\n"):
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        glob = line if ignores else line[1:]
        folder, glob = glob.endswith("/"), glob.rstrip("/")
        anchored = "/" in glob
        pattern = paths.glob_regex(glob.lstrip("/"))[1:-1]
        rules.append((f"^{'' if anchored else '(?:.*/)?'}{pattern}{'/.*' if folder else '(?:/.*)?'}$", ignores))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path from the root ignores it."""
    out = F.lit(False)
    for pattern, ignores in rules:
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def source_files(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """(path, mtime, length, language, content_sha256, text) of admitted files: known extension, size, no binary.

    ``ignore`` is the text of an ignore file at the root; what its last matching rule ignores is left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if ignore:
        below = F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1)
        raw = raw.where(~ignored(below, ignore_rules(ignore)))
    rows = raw.where(F.col("length") <= MAX_BYTES).withColumn("language", paths.language_of(F.col("path"))).where("language <> 'unknown'")
    for part in SKIPPED_DIRS:
        rows = rows.where(~F.col("path").contains(part))
    rows = rows.where(F.position(F.lit(b"\x00"), F.substring("content", 1, SNIFF_BYTES)) == 0)
    return rows.select("path", F.col("modificationTime").alias("mtime"), "length", "language", F.sha2("content", 256).alias("content_sha256"), F.decode("content", "UTF-8").alias("text"))


def changed_files(disk: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to read again (new, or another time) and stored paths that are gone."""
    s = stored.select(F.col("path").alias("s_path"), F.col("mtime").alias("s_mtime"))
    again = disk.join(s, F.col("path") == F.col("s_path"), "left").where("not (mtime <=> s_mtime)").drop("s_path", "s_mtime")
    gone = stored.join(disk.select("path"), "path", "left_anti").select("path")
    return again, gone


SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,"
    "results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
)


def sarif(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(tool, rule, severity, path, line, message); a rule by index where its identifier is left out.

    A file is one report, or with ``lines`` each of its lines is.
    """
    runs = spark.read.schema(SARIF).option("multiLine", str(not lines).lower()).json(path).select(F.explode("runs").alias("run"))
    rows = runs.select(F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    at = F.try_element_at(F.col("r.locations"), F.lit(1))["physicalLocation"]
    rule = F.coalesce(F.col("r.ruleId"), F.try_element_at(F.col("rules"), F.col("r.ruleIndex") + 1)["id"])
    return rows.select("tool", rule.alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("severity"), paths.normal_path(at["artifactLocation"]["uri"]).alias("path"), at["region"]["startLine"].alias("line"), F.col("r.message.text").alias("message"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits): one row of text for each record, cut at its end mark."""
    records = spark.read.option("lineSep", "end_of_record").text(path)
    each = records.select(F.regexp_extract("value", r"(?m)^SF:(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^DA:(\d+,-?\d+)"), 1)).alias("da"))
    parts = F.split("da", ",")
    return each.where("path <> ''").select(paths.normal_path(F.trim("path")).alias("path"), parts[0].cast("int").alias("line"), F.greatest(parts[1].cast("long"), F.lit(0)).alias("hits"))


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of the classes of a report."""
    schema = ("_filename string, lines struct<line:array<struct<_number:int,_hits:long>>>")
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    return rows.select(paths.normal_path(F.col("_filename")).alias("path"), F.explode("lines.line").alias("l")).select("path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, status, seconds) of the test cases of a report."""
    schema = ("_name string, _classname string, _file string, _time double, failure string, error string, skipped string")
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(F.coalesce("_file", F.regexp_replace("_classname", r"\.", "/")).alias("path"), F.col("_name").alias("name"), status.alias("status"), F.coalesce("_time", F.lit(0.0)).alias("seconds"))


SPANS = "array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>>"
OTLP = (f"resourceSpans array<struct<scopeSpans:array<struct<spans:{SPANS}>>,instrumentationLibrarySpans:array<struct<spans:{SPANS}>>>>")


def otlp(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, span_id, parent_id, name, file_path) of valid spans; the older key of scopes is read as well."""
    rows = spark.read.schema(OTLP).json(path).select(F.explode("resourceSpans").alias("r"))
    scopes = rows.select(F.explode(F.when(F.size("r.scopeSpans") > 0, F.col("r.scopeSpans")).otherwise(F.col("r.instrumentationLibrarySpans"))).alias("s"))
    s = scopes.select(F.explode("s.spans").alias("s")).select("s.*")
    file = F.try_element_at(F.filter("attributes", lambda a: a["key"].isin("code.filepath", "code.file.path")), F.lit(1))["value"]["stringValue"]
    valid = F.col("traceId").rlike("^[0-9a-fA-F]{32}$") & F.col("spanId").rlike("^[0-9a-fA-F]{16}$")
    return s.where(valid).select(F.lower("traceId").alias("trace_id"), F.lower("spanId").alias("span_id"), F.nullif(F.lower("parentSpanId"), F.lit("")).alias("parent_id"), "name", paths.normal_path(file).alias("file_path"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, path, added, removed, binary) of a log with lines ``commit SHA``, ``author NAME`` and numstat.

    One record a commit, so commits of any number are read in parallel. A record begins with ``commit`` at the beginning
    of a line, where no line of statistics and no author can begin.
    """
    records = spark.read.option("lineSep", "\ncommit ").text(path).select(F.regexp_replace("value", "^commit ", "").alias("value")).where("length(trim(value)) > 0")
    head = records.select(F.regexp_extract("value", r"^([0-9a-f]+)", 1).alias("sha"), F.regexp_extract("value", r"(?m)^author (.*)$", 1).alias("author"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\S+\t\S+\t.+)$"), 1)).alias("stat"))
    p = F.split("stat", "\t")
    number = lambda c: F.try_to_number(c, F.lit("9999999999")).cast("long")
    return head.select("sha", "author", p[2].alias("path"), number(p[0]).alias("added"), number(p[1]).alias("removed"), (p[0] == "-").alias("binary"))


#: Largest owners file.
OWNERS_BYTES = 3 << 20


def codeowners(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, pattern, owners) of an owners file; a bare name matches at any depth, and what is named also all below it.

    One file, whose size is checked before it is read; a larger one is an error.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]
    if size > OWNERS_BYTES:
        raise ValueError(f"{size} bytes of owners, {OWNERS_BYTES} may be")
    rows = []
    for no, line in enumerate(spark.read.text(path, wholetext=True).collect()[0][0].split("\n") if size else []):
        words = line.split("#")[0].split()
        if not words or any(c in words[0] for c in "[]!"):
            continue
        glob = words[0].lstrip("/") if words[0].startswith("/") or "/" in words[0].rstrip("/") else "**/" + words[0]
        pattern = paths.glob_regex(glob + "**" if glob.endswith("/") else glob)
        if not glob.endswith(("/", "*")):
            pattern = pattern[:-1] + "(?:/.*)?$"
        rows.append((no, pattern, ",".join(sorted(words[1:]))))
    return spark.createDataFrame(rows, "rule_no int, pattern string, owners string")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, ts, text): what people wrote, of JSON lines."""
    rows = spark.read.schema("session string, ts timestamp, role string, text string").json(path)
    return rows.where("role = 'user' and text is not null").select("session", "ts", "text")


FACTS = "source_id string, kind string, severity string, path string, line int, body string, sha256 string"


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a row that does not fit the schema, or whose digest is not that of its body, is an error."""
    rows = spark.read.schema(FACTS).option("mode", "FAILFAST").json(path)
    ok = F.sha2(F.col("body"), 256) == F.col("sha256")
    return rows.withColumn("body", F.when(ok, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "source_id"))))


#: Largest document of a history, and how many are read; more are an answer that says so.
HISTORY_BYTES, HISTORY_FILES = 1 << 20, 5_000
# What a document is by its folder or name.
HISTORY_KINDS = {"decision": r"(^|/)(adrs?|decisions?)/|(^|/)adr-", "task": r"(^|/)(tasks?|plans?)/", "postmortem": r"(^|/)(postmortems?|incidents?)/"}


def markdown_history(spark: SparkSession, root: str, cap: int = HISTORY_FILES) -> DataFrame:
    """(path, kind, length, text, skipped, truncated) of the Markdown documents under a folder.

    Larger documents are skipped and counted, and so is text that shows a secret; of more documents than ``cap`` the
    first by path are read, and each row says that this was not all.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rows = raw.select("path", "length", F.when(F.col("length") <= HISTORY_BYTES, redacted(F.decode("content", "UTF-8"))).alias("text"))
    kind = F.lit("document")
    for name, pattern in reversed(HISTORY_KINDS.items()):
        kind = F.when(F.lower("path").rlike(pattern), name).otherwise(kind)
    counted = rows.agg(F.count_if(F.col("text").isNull()).alias("skipped"), F.count("text").alias("n")).collect()[0]
    first = rows.where("text is not null").orderBy("path").limit(cap)
    return first.select("path", kind.alias("kind"), "length", "text", F.lit(counted["skipped"]).alias("skipped"), F.lit(counted["n"] > cap).alias("truncated"))


#: Sections of a document; later ones are folded into the last.
MAX_SECTIONS = 128


def markdown_sections(text: str) -> list[tuple[str, int, int, str]]:
    """(heading chain, first line, last line, body) by ATX headings outside fences and comments."""
    import re

    lines = text.split("\n")
    marks: list[tuple[int, int, str]] = []
    fence, comment = "", False
    for i, line in enumerate(lines):
        found = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if found and found[1][0] == fence[0] and len(found[1]) >= len(fence):
                fence = ""
            continue
        if comment or line.lstrip().startswith("<!--"):
            comment = "-->" not in line
            continue
        if found:
            fence = found[1]
            continue
        head = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)
        if head:
            marks.append((i, len(head[1]), head[2] or ""))
    out, chain = [], []
    if not marks or marks[0][0] > 0:
        marks.insert(0, (0, 0, ""))
    for k, (i, level, title) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        if level:
            chain = [c for c in chain if c[0] < level] + [(level, title)]
        out.append((" > ".join(t for _, t in chain), i + 1, end, "\n".join(lines[i:end])))
    if len(out) > MAX_SECTIONS:
        last = out[MAX_SECTIONS - 1]
        out = out[: MAX_SECTIONS - 1] + [(last[0], last[1], out[-1][2], "\n".join(o[3] for o in out[MAX_SECTIONS - 1 :]))]
    return out


def document_sections(docs: DataFrame) -> DataFrame:
    """(path, id, heading, start_line, end_line, body) of Markdown documents (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, *s) for p, t in zip(part["path"], part["text"]) for s in markdown_sections(t or "")]
            yield pd.DataFrame(rows, columns=["path", "heading", "start_line", "end_line", "body"])

    rows = docs.select("path", "text").mapInPandas(run, "path string, heading string, start_line long, end_line long, body string")
    return rows.select("path", F.sha2(F.concat_ws("\n", "path", "heading", "body"), 256).alias("id"), "heading", "start_line", "end_line", "body")


def decision_claims(sections: DataFrame) -> DataFrame:
    """(path, heading, statement, status): entries of a decision log with exactly one line of each."""
    lines = lambda word: F.regexp_extract_all("body", F.lit(rf"(?m)^\s*[-*]?\s*\**{word}\**:\**[ \t]*(.+?)\s*$"), 1)
    rows = sections.where(F.lower("heading").contains("decision log > ")).withColumn("d", lines("Decision")).withColumn("s", lines("Status"))
    return rows.where("size(d) = 1 and size(s) = 1").select("path", "heading", F.col("d")[0].alias("statement"), F.lower(F.col("s")[0]).alias("status"))
