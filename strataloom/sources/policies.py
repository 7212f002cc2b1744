"""Policy files: a version and a list of rules, each with one action and the fields that belong to it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from strataloom.functions import paths

# The actions, the fields that each needs and may have besides, and limits of a file.
ACTIONS = {
    "deny_imports": (("from",), ()),
    "max_new_cycles": (("scope",), ()),
    "require_owner": (("when",), ("scope",)),
    "max_blast_radius": (("scope",), ()),
    "require_tests": (("scope",), ()),
    "deny_ownership_crossings": (("scope",), ()),
    "require_workflow": (("critical",), ()),
}
EXACT = {"require_tests": True, "deny_ownership_crossings": True, "require_workflow": "strict", "when": "api_surface_changed"}
GLOBS = ("from", "scope", "critical", "deny_imports")
MAX_BYTES, MAX_RULES = 1 << 20, 100
RULE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    fields: dict

    def pattern(self, name: str) -> str:
        """The regular expression of a glob field; no field means any path."""
        return paths.glob_regex(self.fields[name]) if name in self.fields else "^.*$"


def _value(text: str) -> str | int | bool:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"\d+", text) else text


def parse(text: str) -> list[Rule]:
    """The rules of a file in order of their identifiers; whatever does not fit is an error.

    Of YAML what such a file needs: ``key: value`` lines, and rules as items of one list.
    """
    if not text.strip() or len(text.encode()) > MAX_BYTES:
        raise PolicyError("a policy file has something in it and at most 1 MiB")
    version, items, inside = None, [], False
    for line in text.split("\n"):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line:
            continue
        found = re.fullmatch(r"(\s*)(- )?\s*([a-z_]+):(?:\s+(.*))?", line)
        if not found:
            raise PolicyError(f"not understood: {line.strip()!r}")
        indent, item, key, value = found.groups()
        if not indent and not item:
            inside = key == "rules"
            if key == "version":
                version = _value(value or "")
            elif not inside:
                raise PolicyError(f"unknown key {key!r}")
        elif not inside or (not item and not items):
            raise PolicyError(f"no rule for {key!r}")
        else:
            if item:
                items.append({})
            if key in items[-1]:
                raise PolicyError(f"{key!r} is there twice")
            items[-1][key] = _value(value or "")
    if version != 1:
        raise PolicyError(f"version 1 is known, not {version}")
    if not 1 <= len(items) <= MAX_RULES:
        raise PolicyError(f"1 to {MAX_RULES} rules")
    rules = [_rule(x) for x in items]
    if len({r.id for r in rules}) < len(rules):
        raise PolicyError("a rule's identifier is there twice")
    return sorted(rules, key=lambda r: r.id)


def _rule(item: dict) -> Rule:
    name = str(item.get("id", ""))
    if not RULE_ID.fullmatch(name):
        raise PolicyError(f"not an identifier: {name!r}")
    actions = [a for a in ACTIONS if a in item]
    if len(actions) != 1:
        raise PolicyError(f"{name}: exactly one action")
    needs, may = ACTIONS[actions[0]]
    fields = {k: v for k, v in item.items() if k != "id"}
    if missing := [k for k in needs if k not in fields]:
        raise PolicyError(f"{name}: {missing[0]!r} is missing")
    if strange := [k for k in fields if k not in (actions[0], *needs, *may)]:
        raise PolicyError(f"{name}: {strange[0]!r} does not belong there")
    for k, v in fields.items():
        if k in EXACT and v != EXACT[k]:
            raise PolicyError(f"{name}: {k!r} is {EXACT[k]} or not there")
        if k.startswith("max_") and (isinstance(v, bool) or not isinstance(v, int)):
            raise PolicyError(f"{name}: {k!r} is a number")
        if k in GLOBS and (not isinstance(v, str) or not v):
            raise PolicyError(f"{name}: {k!r} is a glob")
    return Rule(name, actions[0], fields)


def read(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a file; its size is checked before it is read."""
    size = spark.read.format("binaryFile").load(path).selectExpr("coalesce(sum(length), 0) n").collect()[0]["n"]
    if size > MAX_BYTES:
        raise PolicyError("a policy file has at most 1 MiB")
    return parse(spark.read.text(path, wholetext=True).collect()[0][0] if size else "")
