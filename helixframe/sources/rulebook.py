"""Rule catalogues and community profiles as files, held against declared fields before they are used.

A catalogue or profile is one small YAML file (JSON is YAML too). Every problem of a file is a
row (place, field, problem); a file with any is refused with all of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # then only files in JSON can be read
    yaml = None

#: Values that fields may take, mildest level first, and the shapes of ids (fixed values).
LEVELS = ("info", "warning", "error")
LAYERS = ("core", "so", "biology", "fhgff3")
STATUSES = ("implemented", "planned")
REVIEWS = ("pending-SO", "reviewed-SO", "accepted-with-changes", "rejected")
RULE_ID = r"(GFF-(SYN|ATT|DIR|STR)|SO|BIO|HDR)-\d{3}"
PROFILE_ID, PREFIX = r"[a-z][a-z0-9-]{1,31}", r"[A-Z]{2,6}"
FORMAT = 1

SHIPPED = Path(__file__).resolve().parents[1] / "profiles"


@dataclass(frozen=True)
class Field:
    """What a field must be: there, of a kind, one of some values, of a shape, with fields of its own."""

    needed: bool = True
    kind: type | None = None
    among: tuple[Any, ...] = ()
    shape: str = ""
    inner: Mapping[str, Field] | None = None
    items: Mapping[str, Field] | None = None


_OPTIONAL = Field(needed=False)
_TEXT = Field(kind=str)
REFERENCE = {"section": Field(), "anchor": _OPTIONAL}
TOLD = {
    "level": Field(among=LEVELS), "title": _TEXT, "description": _TEXT, "example": Field(), "fix": Field(), "status": Field(among=STATUSES), "notes": _OPTIONAL, "valid": _OPTIONAL,
}
RULE = {"id": Field(shape=RULE_ID), **TOLD, "layer": Field(among=LAYERS), "review": Field(among=REVIEWS), "reference": Field(inner={"source": Field(), **REFERENCE}), "needs_so": _OPTIONAL}
CATALOGUE = {"catalogue_version": Field(), "sources": Field(kind=dict), "rules": Field(items=RULE)}
PROFILE = {
    "profile_format": Field(among=(FORMAT,)), "id": Field(shape=PROFILE_ID), "name": _TEXT, "version": Field(), "description": _TEXT, "review": _TEXT, "prefix": Field(shape=PREFIX),
    "source": Field(inner={"title": Field(), "url": Field(), "license": Field(), "commit": _OPTIONAL, "date": _OPTIONAL}),
    "rules": Field(items={"id": Field(), **TOLD, "reference": Field(inner=REFERENCE)}),
    "levels": Field(needed=False, items={"rule": Field(), "level": Field(among=LEVELS), "reference": Field(inner=REFERENCE), "reason": Field()}),
    "guidance": Field(needed=False, items={"reference": Field(inner=REFERENCE), "recommendation": Field(), "reason": Field(), "covered_by": _OPTIONAL}),
    "checks": _OPTIONAL, "docs": _OPTIONAL,
}


@dataclass(frozen=True)
class Problem:
    place: str
    field: str
    problem: str

    def __str__(self) -> str:
        return ": ".join(filter(None, (self.place, self.field, self.problem)))


class RulebookError(ValueError):
    """A file that cannot be read or used, with all of its problems."""

    def __init__(self, name: str, problems: Iterable[Problem]):
        self.problems = list(problems)
        super().__init__(f"{name}: " + "; ".join(map(str, self.problems)))


def _held(entry: Any, fields: Mapping[str, Field], place: str) -> list[Problem]:
    """An entry's problems by the declared fields."""
    if not isinstance(entry, dict):
        return [Problem(place, "", "is no mapping")]
    out = [Problem(place, str(k), "unknown field") for k in entry if k not in fields]
    for name, f in fields.items():
        if name not in entry:
            out += [Problem(place, name, "missing")] if f.needed else []
            continue
        value = entry[name]
        if f.kind and not isinstance(value, f.kind):
            out.append(Problem(place, name, f"must be a {'mapping' if f.kind is dict else 'text'}"))
        if f.among and value not in f.among:
            out.append(Problem(place, name, f"must be one of {', '.join(map(str, f.among))}"))
        if f.shape and not re.fullmatch(f.shape, str(value)):
            out.append(Problem(place, name, f"does not match {f.shape}"))
        if f.inner is not None:
            out += _held(value, f.inner, f"{place} {name}".strip())
        if f.items is not None:
            if not isinstance(value, list | None):
                out.append(Problem(place, name, "must be a list"))
            for k, x in enumerate(_entries(entry, name), 1):
                own = next((str(x[i]) for i in ("id", "rule") if isinstance(x, dict) and x.get(i)), f"#{k}")
                out += _held(x, f.items, f"{name} {own}")
    return out


def _entries(data: Any, name: str) -> list[Any]:
    found = data.get(name) if isinstance(data, dict) else None
    return found if isinstance(found, list) else []


def _named(data: Any, name: str, key: str) -> list[tuple[str, dict]]:
    return [(str(x[key]), x) for x in _entries(data, name) if isinstance(x, dict) and key in x]


def _twice(ids: list[str], name: str, key: str) -> list[Problem]:
    return [Problem(f"{name} {x}", key, "more than once") for x in sorted({x for x in ids if ids.count(x) > 1})]


def catalogue_problems(data: Any) -> list[Problem]:
    """What is wrong with a catalogue; a rule that is implemented must be known here."""
    from ..plans.engine import RULES

    out = _held(data, CATALOGUE, "")
    rules = _named(data, "rules", "id")
    out += _twice([i for i, _ in rules], "rules", "id")
    sources = data.get("sources") if isinstance(data, dict) else None
    for i, x in rules:
        reference = x.get("reference")
        if isinstance(reference, dict) and "source" in reference and isinstance(sources, dict) and reference["source"] not in sources:
            out.append(Problem(f"rules {i} reference", "source", "is not among the sources"))
        if x.get("status") == "implemented" and re.fullmatch(RULE_ID, i) and (i not in RULES or RULES[i].status != "implemented"):
            out.append(Problem(f"rules {i}", "status", "no query implements it"))
    return out


def profile_problems(data: Any, levels: Mapping[str, str], checks: Mapping[str, Iterable[str]]) -> list[Problem]:
    """What is wrong with a profile, given the levels of core rules and the ids that each module of checks tests."""
    out = _held(data, PROFILE, "")
    if not isinstance(data, dict):
        return out
    module, prefix = data.get("checks"), str(data.get("prefix", ""))
    if module is not None and module not in checks:
        out.append(Problem("", "checks", f"must be one of {', '.join(sorted(checks))}"))
    rules = _named(data, "rules", "id")
    out += _twice([i for i, _ in rules], "rules", "id")
    for i, x in rules:
        if not re.fullmatch(rf"{re.escape(prefix)}-\d{{3}}", i):
            out.append(Problem(f"rules {i}", "id", f"does not match {prefix}-\\d{{3}}"))
        if x.get("status") == "implemented" and (module is None or (module in checks and i not in checks[module])):
            out.append(Problem(f"rules {i}", "status", "no check implements it"))
    changes = _named(data, "levels", "rule")
    out += _twice([i for i, _ in changes], "levels", "rule")
    for i, x in changes:
        if i not in levels:
            out.append(Problem(f"levels {i}", "rule", "is no implemented core rule"))
        elif x.get("level") in LEVELS and LEVELS.index(x["level"]) <= LEVELS.index(levels[i]):
            out.append(Problem(f"levels {i}", "level", f"is not above {levels[i]}, the rule's own"))
    known = set(levels) | {i for i, _ in rules}
    for k, x in enumerate(_entries(data, "guidance"), 1):
        covered = (x.get("covered_by") or []) if isinstance(x, dict) else []
        out += [Problem(f"guidance #{k}", "covered_by", f"{i} is unknown") for i in covered if i not in known]
    return out


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    version: str
    review: str
    source: dict[str, str]
    levels: dict[str, str]  # core rules that it raises
    rules: dict[str, str]  # its own implemented ones
    planned: tuple[str, ...] = ()
    guidance: tuple[dict, ...] = field(default=(), repr=False)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(rule, profile_level, raised): as many rows as the file has rules."""
        rows = [(r, x, True) for r, x in self.levels.items()] + [(r, x, False) for r, x in self.rules.items()]
        return spark.createDataFrame(rows, "rule string, profile_level string, raised boolean")

    def about(self) -> dict[str, Any]:
        return {"id": self.id, "name": self.name, "version": self.version, "review": self.review, "source": self.source}


@dataclass(frozen=True)
class Catalogue:
    version: str
    sources: dict[str, dict]
    rules: dict[str, dict]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(rule, level, title, layer, status) of a catalogue file."""
        rows = [(i, x["level"], x["title"], x["layer"], x["status"]) for i, x in self.rules.items()]
        return spark.createDataFrame(rows, "rule string, level string, title string, layer string, status string")

    def address(self, rule: str) -> str:
        """Where the text that a rule follows can be read."""
        reference = self.rules[rule]["reference"]
        anchor = reference.get("anchor")
        return str(self.sources[reference["source"]].get("url", "")) + (f"#{anchor}" if anchor else "")


def problem_rows(spark: SparkSession, problems: Iterable[Problem]) -> DataFrame:
    return spark.createDataFrame([(p.place, p.field, p.problem) for p in problems], "place string, field string, problem string")


def parsed(text: str, name: str) -> Any:
    try:
        return json.loads(text) if yaml is None else yaml.safe_load(text)
    except ValueError as e:
        raise RulebookError(name, [Problem("", "", f"cannot be parsed{'' if yaml else ' without PyYAML'}: {e}")]) from e
    except Exception as e:
        if yaml is None or not isinstance(e, yaml.YAMLError):
            raise
        raise RulebookError(name, [Problem("", "", f"cannot be parsed: {e}")]) from e


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_catalogue(spark: SparkSession, path: str) -> Catalogue:
    data = parsed(_text(spark, path), path)
    problems = catalogue_problems(data)
    if problems:
        raise RulebookError(path, problems)
    return Catalogue(str(data["catalogue_version"]), data["sources"], {x["id"]: x for x in data["rules"] or ()})


def make_profile(text: str, name: str) -> Profile:
    from ..plans.engine import RULES

    levels = {r.id: r.level for r in RULES.values() if r.status == "implemented" and not r.id.startswith("AGB-")}
    checks = {"community": [r for r in RULES if r.startswith("AGB-")]}
    data = parsed(text, name)
    problems = profile_problems(data, levels, checks)
    if problems:
        raise RulebookError(name, problems)
    own = {x["id"]: x for x in data["rules"] or ()}
    return Profile(
        data["id"], data["name"], str(data["version"]), data["review"], {k: str(v) for k, v in data["source"].items()}, {x["rule"]: x["level"] for x in data.get("levels") or ()},
        {i: x["level"] for i, x in own.items() if x["status"] == "implemented"}, tuple(i for i, x in own.items() if x["status"] != "implemented"), tuple(data.get("guidance") or ()),
    )


def shipped() -> list[str]:
    """The ids of the profiles that come with the package."""
    return sorted(p.stem for p in SHIPPED.glob("*.yaml"))


def read_profile(spark: SparkSession, name: str) -> Profile:
    """A shipped profile by its id, or a profile file by its path."""
    if name in shipped():
        return make_profile((SHIPPED / f"{name}.yaml").read_text(encoding="utf-8"), name)
    if not name.endswith((".yaml", ".yml", ".json")):
        raise RulebookError(name, [Problem("", "", f"is no shipped profile ({', '.join(shipped())}) and no file of one")])
    return make_profile(_text(spark, name), name)
