"""Rulesets: named lists of rules that build on others, resolved before any plan is made.

A ruleset is a mapping with ``description``, ``extends`` (names, earlier ones overridden by later ones), ``when``
(guards for each of its own rules) and ``rules`` (id to entry). An entry is a level, ``off``, a score, or a
mapping with fact, expect, unique, scope, when, severity, score (a number or the points of a scale), text and linked.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagesift.functions import scoring
from pagesift.operators.rules import KEYWORDS, Rule, glob_pattern

PRESET = "pagesift:"
EVERY = "all"


class ConfigError(ValueError):
    """A ruleset or an option that can't be meant."""


def matches(rule_id: str, pattern: str) -> bool:
    """Whether an id is the pattern, or matches it as a glob whose * crosses slashes."""
    return rule_id == pattern or re.match(glob_pattern(pattern, across=True), rule_id) is not None


def _spec(entry: Any, own: bool) -> dict[str, Any]:
    """An entry as a mapping. A level given by hand pins the rule's score to its band; a bare score leaves the level open."""
    if isinstance(entry, bool) or not isinstance(entry, (str, int, float, Mapping)):
        raise ConfigError(f"no rule entry: {entry!r}")
    if isinstance(entry, (int, float)):
        return {"score": entry, "severity": None, "pinned": None}
    spec = {"severity": entry} if isinstance(entry, str) else dict(entry)
    if spec.get("severity") is not None and "score" not in spec and (isinstance(entry, str) or own):
        spec["pinned"] = True
    return spec


class Rulesets:
    """The caller's rulesets beside the presets that ship. A bare name is the caller's ruleset, else a preset; with the prefix it is the preset."""

    def __init__(self, presets: Mapping[str, Mapping], own: Mapping[str, Mapping] | None = None):
        if EVERY in (own or {}):
            raise ConfigError(f"the name {EVERY} stands for every preset")
        self.presets, self.own = presets, own or {}

    def _find(self, name: str) -> tuple[Mapping | None, bool]:
        if not name.startswith(PRESET) and name in self.own:
            return self.own[name], True
        bare = name.removeprefix(PRESET)
        if bare == EVERY:
            return {"description": "every rule that ships", "extends": [PRESET + p for p in self.presets]}, False
        return self.presets.get(bare), False

    def resolve(self, name: str, through: tuple[str, ...] = ()) -> dict[str, dict[str, Any]]:
        """id to specification: what the ruleset extends, depth first, then its own rules over them.

        A new ``expect`` joins the inherited one keyword by keyword and drops the inherited sentence, which may name
        old bounds. A name that no ruleset has is read as an id or glob over every rule that ships."""
        if name in through:
            raise ConfigError(f"{name} extends itself through {' > '.join(through)}")
        found, own = self._find(name)
        if found is None:
            picked = {i: s for i, s in self.resolve(PRESET + EVERY, (*through, name)).items() if matches(i, name)}
            if not picked:
                raise ConfigError(f"no ruleset and no rule is named {name}")
            return picked
        rules: dict[str, dict[str, Any]] = {}
        for parent in found.get("extends", ()):
            rules |= self.resolve(parent, (*through, name))
        for rule_id, entry in found.get("rules", {}).items():
            old = rules.get(rule_id)
            if old is None and not isinstance(entry, Mapping):
                raise ConfigError(f"{name} sets {rule_id}, which it doesn't define or extend")
            spec = {**(old or {}), **_spec(entry, own)}
            if isinstance(entry, Mapping) and isinstance(entry.get("expect"), Mapping):
                before = (old or {}).get("expect")
                spec["expect"] = {**(before if isinstance(before, Mapping) else {}), **entry["expect"]}
                spec["text"] = entry.get("text", "")
            guards = [found.get("when"), (old or {}).get("when"), entry.get("when") if isinstance(entry, Mapping) else None]
            if any(guards):
                spec["when"] = {k: v for g in guards if g for k, v in g.items()}
            rules[rule_id] = spec
        return rules

    def select(self, names: Iterable[str], exclude: Sequence[str] = (), severity: Mapping[str, str] | None = None) -> dict[str, dict[str, Any]]:
        """The rules of all named rulesets that are on, with excluded ids or globs off and levels overridden by id or glob.

        An option that matches no rule of the names is refused, with the nearest id if it is likely mistyped."""
        chosen: dict[str, dict[str, Any]] = {}
        for name in names:
            chosen |= self.resolve(name)
        severity = severity or {}
        for pattern in [*exclude, *severity]:
            if not any(matches(i, pattern) for i in chosen):
                hint = nearest(pattern, chosen)
                raise ConfigError(f"no rule is named {pattern}" + (f"; {hint} is" if hint else ""))
        on = {}
        for rule_id, spec in chosen.items():
            level = severity.get(rule_id) or next((s for p, s in severity.items() if matches(rule_id, p)), None)
            spec = {**spec, "severity": level, "pinned": True} if level else spec
            if spec.get("severity") != "off" and not any(matches(rule_id, p) for p in exclude):
                on[rule_id] = spec
        return on

    def names(self) -> list[str]:
        return sorted({*self.own, *self.presets, EVERY})


def nearest(pattern: str, known: Iterable[str]) -> str | None:
    """The id or ``folder/*`` nearest to a pattern, if it is within typing errors."""
    known = set(known)
    candidates = sorted(known | {i.split("/")[0] + "/*" for i in known})
    cost, best = min(((_distance(pattern, c), c) for c in candidates), default=(99, None))
    return best if cost <= max(2, len(pattern) // 4) else None


def _distance(a: str, b: str) -> int:
    """Edits from a to b."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def _keywords(schema: Any) -> Iterable[str]:
    """All keywords of a schema, those of its parts too."""
    if isinstance(schema, Mapping):
        for k, v in schema.items():
            yield k
            if k in ("not", "items", "contains", "if", "then", "else"):
                yield from _keywords(v)
            elif k in ("allOf", "anyOf"):
                for s in v:
                    yield from _keywords(s)
            elif k == "properties":
                for s in v.values():
                    yield from _keywords(s)


def compiled(specs: Mapping[str, Mapping[str, Any]]) -> tuple[list[Rule], list[dict[str, Any]]]:
    """Rules over a fact, for ``rules.evaluate``, and the specifications of ``unique`` rules (id, fact, scope, severity, score, when)."""
    rules, unique = [], []
    for rule_id, spec in specs.items():
        score = spec.get("score")
        points = tuple(map(tuple, score)) if isinstance(score, (list, tuple)) else None
        severity = spec.get("severity") or (_level(score) if isinstance(score, (int, float)) else "warning")
        number = float(score) if isinstance(score, (int, float)) else None
        if number is not None and not spec.get("pinned"):
            severity = _level(number)
        if severity not in scoring.BANDS:
            raise ConfigError(f"{rule_id}: no level {severity}")
        if spec.get("unique"):
            unique.append({"id": rule_id, "fact": spec["unique"], "scope": spec.get("scope", "site"), "severity": severity, "score": number if number is not None else scoring.BANDS[severity][2], "when": dict(spec.get("when", {}))})
            continue
        if not spec.get("fact") or spec.get("expect") is None:
            raise ConfigError(f"{rule_id}: needs fact and expect, or unique")
        if unknown := set(_keywords(spec["expect"])) - KEYWORDS:
            raise ConfigError(f"{rule_id}: keywords not known: {sorted(unknown)}")
        rules.append(Rule(rule_id, spec["fact"], spec["expect"], dict(spec.get("when", {})), severity, number, points, spec.get("text", ""), bool(spec.get("linked"))))
    return rules, unique


def _level(score: float) -> str:
    tenths = int(score * 10 + 0.5) / 10
    return next(level for level in scoring.ORDER if tenths >= scoring.BANDS[level][0])


def catalogue(spark: SparkSession, rulesets: Rulesets) -> DataFrame:
    """(rule, scope, severity, score, fact, expect, guards, text, rulesets): every rule that ships; one row each, so it is small."""
    import json

    within: dict[str, list[str]] = {}
    for preset in sorted(rulesets.presets):
        for rule_id in rulesets.resolve(PRESET + preset):
            within.setdefault(rule_id, []).append(preset)
    rows = []
    for rule_id, spec in sorted(rulesets.resolve(PRESET + EVERY).items()):
        score = spec.get("score")
        level = spec.get("severity") or (_level(score) if isinstance(score, (int, float)) else "warning")
        path = spec.get("fact") or spec.get("unique") or ""
        scope = spec.get("scope") or ("site" if spec.get("unique") or path.startswith("site.") else "page")
        number = float(score) if isinstance(score, (int, float)) else scoring.BANDS.get(level, (0, 0, 0.0))[2]
        rows.append((rule_id, scope, level, number, path, json.dumps(spec.get("expect"), sort_keys=True), json.dumps(spec.get("when", {}), sort_keys=True), spec.get("text", ""), within.get(rule_id, [])))
    return spark.createDataFrame(rows, "rule string, scope string, severity string, score double, fact string, expect string, guards string, text string, rulesets array<string>")


def explain(rulesets: Rulesets, pattern: str) -> list[str]:
    """Lines that tell of each rule an id or glob names: what it reads, what it expects, when it applies and where it is on."""
    out = []
    for rule_id, spec in rulesets.resolve(pattern).items():
        out.append(f"{rule_id}: {spec.get('severity') or 'scored'}")
        out += [f"  {k}: {spec[k]}" for k in ("fact", "unique", "expect", "when", "score", "text") if spec.get(k)]
        out.append("  in: " + ", ".join(p for p in sorted(rulesets.presets) if rule_id in rulesets.resolve(PRESET + p)))
    return out


def load(path: str) -> dict[str, Any]:
    """Rulesets from a JSON file, or from a YAML one where the yaml package is there."""
    text = open(path, encoding="utf-8").read()
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs the yaml package; JSON is read without it") from e
    return yaml.safe_load(text)


def exit_status(worst_level: str | None, fail_on: str | float | None, worst_score: float | None = None, complete: bool = True) -> int:
    """0 if nothing is as bad as ``fail_on`` (a level or a score), 1 if something is, 3 where the run is not complete."""
    if not complete:
        return 3
    if fail_on is None or worst_level is None:
        return 0
    if isinstance(fail_on, str):
        if fail_on not in scoring.ORDER:
            raise ConfigError(f"no level {fail_on}")
        return int(scoring.ORDER.index(worst_level) <= scoring.ORDER.index(fail_on))
    return int(worst_score is not None and worst_score >= fail_on)
