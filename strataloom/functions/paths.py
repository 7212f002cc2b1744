"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the language each is shown as.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "go": "go", "js": "javascript", "java": "java", "cs": "csharp", "php": "php", "cpp": "cpp", "vue": "vue"}
# Path parts and file names that are not production code.
NOT_PRODUCTION = r"(^|/)(tests?|fixtures?|examples?|generated|vendor)(/|$)|(^|/)test_|_test\.|\.test\.|\.spec\."


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def component(path: Column) -> Column:
    """Text before the first slash, a point where there is none."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def component_at(path: Column, depth: int) -> Column:
    """The first ``depth`` parts of the parent folder."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def production(path: Column) -> Column:
    return ~path.rlike(NOT_PRODUCTION)


def test_like(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?(/|$)|(^|/)test_|_test\.|\.test\.|\.spec\.")


def normal_path(path: Column) -> Column:
    """A repository path out of a URI or a Windows path; null where it climbs out."""
    p = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^file://", ""), r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^([A-Za-z]:)?/+", ""), r"(^|/)(\./)+", "$1")
    return F.when(p.rlike(r"(^|/)\.\.(/|$)") | (p == ""), None).otherwise(p)


def glob_regex(glob: str) -> str:
    """A glob as a pattern over whole paths: one star and a question mark stop at slashes, two stars cross them."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.^$+{}()|[]" else glob[i]), i + 1
    return f"^{out}$"
