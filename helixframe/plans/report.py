"""Reports of findings for readers and tools: a self-contained page, and SARIF 2.1.0."""

from __future__ import annotations

import base64
import hashlib
import html
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

from .. import __version__
from .engine import MAX_FINDINGS, RULES, report_data

_STYLE = "body{font:15px sans-serif;margin:2em}td,th{padding:.2em .6em;text-align:left}.error{color:#a00}.warning{color:#850}"
_SARIF_LEVEL = {"error": "error", "warning": "warning", "info": "note"}


def to_html(found: DataFrame, most: int = MAX_FINDINGS, rules: Iterable[str] = (), **judged_by: Any) -> str:
    """One page without scripts; its policy allows only its own style."""
    data = report_data(found, most, rules, **judged_by)
    digest = base64.b64encode(hashlib.sha256(_STYLE.encode()).digest()).decode()
    safe = lambda x: html.escape("" if x is None else str(x))
    told = lambda part: ", ".join(f"{n} {x}" for x, n in part["counts"].items())

    def listed(part: dict, extra: tuple[str, ...] = ()) -> str:
        keys = ("file", "line", "field", "level", *extra, "rule", "message")
        rows = "".join(f"<tr class='{f['level']}'>" + "".join(f"<td>{safe(f[k])}</td>" for k in keys) + "</tr>" for f in part["findings"])
        names = "".join(f"<th>{ {'field': 'column', 'core_level': 'core level'}.get(k, k) }" for k in keys)
        more = f"<p>{part['truncated']} more are not listed.</p>" if part["truncated"] else ""
        return f"{more}<table><tr>{names}</tr>{rows}</table>"

    judged = [("Catalogue", f"{data['catalogue']['version']}, {data['catalogue']['rules']} rules")]
    if "ontology" in data:
        judged.append(("Ontology", ", ".join(str(v) for k, v in data["ontology"].items() if v and k != "bundled")))
    profile = ""
    if "profile" in data:
        p = data["profile"]
        judged.append(("Profile", f"{p['name']} {p['version']}; {p['source']['title']} ({p['source']['license']}); {p['review']}"))
        profile = f"<h2>{safe(p['name'])}: {'' if p['compliant'] else 'not '}compliant</h2><p>{told(p)}. These never change whether a file is valid.</p>{listed(p, ('core_level',))}"
    facts = "".join(f"<dt>{safe(k)}<dd>{safe(v)}" for k, v in judged)
    left = "".join(f"<li>{safe(x['rule'])}: {safe(x['reason'])}" for x in data["not_checked"])
    return (
        f"<!doctype html><meta charset='utf-8'><meta http-equiv='Content-Security-Policy' content=\"default-src 'none'; style-src 'sha256-{digest}'\"><title>Findings</title><style>{_STYLE}</style>"
        f"<h1>{'Valid' if data['valid'] else 'Not valid'}</h1><p>{told(data)}</p><dl>{facts}</dl>{listed(data)}{profile}<h2>Not checked</h2><ul>{left}</ul>\n"
    )


def to_sarif(found: DataFrame, most: int = MAX_FINDINGS, rules: Iterable[str] = (), **judged_by: Any) -> str:
    """A SARIF run; a profile is an extension of the tool, with its findings' own levels and the core ones in properties."""
    data = report_data(found, most, rules, **judged_by)
    p = data.get("profile")

    def described(part: dict) -> list[dict]:
        worst = {f["rule"]: f["level"] for f in part["findings"]}
        return [{"id": r, "shortDescription": {"text": RULES[r].title}, "defaultConfiguration": {"level": _SARIF_LEVEL[worst[r]]}} for r in sorted(worst)]

    def result(f: dict, known: list[dict], extension: bool) -> dict:
        place: dict = {"artifactLocation": {"uri": f["file"]}}
        if f["line"] is not None:
            place["region"] = {"startLine": f["line"]}
        at = next(k for k, x in enumerate(known) if x["id"] == f["rule"])
        rule: dict = {"id": f["rule"], "index": at} | ({"toolComponent": {"name": p["id"], "index": 0}} if extension else {})
        more = {k: v for k, v in (("column", f["field"]), ("coreLevel", f.get("core_level"))) if v is not None}
        out = {"ruleId": f["rule"], "rule": rule, "level": _SARIF_LEVEL[f["level"]], "message": {"text": f["message"]}, "locations": [{"physicalLocation": place}]}
        return out | ({} if extension else {"ruleIndex": at}) | ({"properties": more} if more else {})

    own = described(data)
    tool: dict = {"driver": {"name": "helixframe", "version": __version__, "rules": own}}
    results = [result(f, own, False) for f in data["findings"]]
    about = {k: data[k] for k in ("counts", "truncated", "catalogue", "ontology") if k in data} | {"notChecked": data["not_checked"]}
    if p:
        extra = described(p)
        tool["extensions"] = [{"name": p["id"], "fullName": p["name"], "version": p["version"], "rules": extra}]
        results += [result(f, extra, True) for f in p["findings"]]
        about["profile"] = {k: p[k] for k in ("id", "compliant", "counts", "truncated")}
    skipped = [{"level": "note", "message": {"text": f"{x['rule']} was not checked: {x['reason']}"}} for x in data["not_checked"]]
    run = {"tool": tool, "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": skipped}], "results": results, "properties": about}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})
