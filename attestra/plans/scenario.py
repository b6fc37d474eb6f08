"""The declared use case: columns, gates, estimand, and how claims about columns are vetted."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

import yaml

from attestra.operators.ingest import FieldMeta
from attestra.operators.regression import Estimand

CONFIDENCE_FLOOR = 0.5
#: The words that a declared column may use.
KINDS = ("continuous", "categorical", "binary", "identifier", "datetime")
ROLES = ("feature", "label", "identifier", "ignored")
#: Who may overrule whom, strongest first.
AUTHORITY = ("researcher", "structural", "model")


@dataclass(frozen=True)
class ColumnClaim:
    name: str
    kind: str | None = None
    role: str | None = None
    integer: bool | None = None
    min: float | None = None
    max: float | None = None
    categories: tuple | None = None
    unit: str | None = None
    confidence: float = 1.0
    source: str = "researcher"


@dataclass(frozen=True)
class Gates:
    coverage: float = 0.50
    tvd: float = 0.15
    wasserstein: float = 0.50
    correlation: float = 0.25


@dataclass
class Scenario:
    label: str = ""
    intent: str = ""
    mode: str = "balanced"
    columns: list[ColumnClaim] = field(default_factory=list)
    gates: Gates = field(default_factory=Gates)
    estimand: Estimand | None = None
    privacy: str = "floored"
    delta: float = 0.5
    provenance: dict = field(default_factory=dict)
    verdicts: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        return json.loads(json.dumps(asdict(self), default=list))

    @staticmethod
    def from_dict(d: dict) -> Scenario:
        d = dict(d)
        columns = [ColumnClaim(**{**c, "categories": tuple(c["categories"]) if c.get("categories") is not None else None}) for c in d.pop("columns", None) or []]
        gates = Gates(**(d.pop("gates", None) or {}))
        e = d.pop("estimand", None)
        estimand = Estimand(**{**e, "predictors": tuple(e["predictors"]), "targets": tuple(e.get("targets") or ())}) if e else None
        return Scenario(columns=columns, gates=gates, estimand=estimand, **d)

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    @staticmethod
    def from_yaml(text: str) -> Scenario:
        return Scenario.from_dict(yaml.safe_load(text) or {})


def schema_hash(fields: dict[str, FieldMeta]) -> str:
    """Sixteen hex digits over names and kinds."""
    return hashlib.sha256(json.dumps([[m.name, m.kind] for m in fields.values()]).encode()).hexdigest()[:16]


def structural(m: FieldMeta) -> ColumnClaim:
    """What the data themselves say of a column."""
    kind = "identifier" if m.is_identifier else m.kind
    numeric = m.kind == "continuous" and not m.is_identifier
    return ColumnClaim(m.name, kind, "identifier" if m.is_identifier else "feature", m.is_integer if numeric else None, m.low if numeric else None, m.high if numeric else None, tuple(m.categories) if m.categories else None, source="structural")


def vet(claim: ColumnClaim, m: FieldMeta) -> tuple[ColumnClaim, list[dict]]:
    """The claim as far as the data bear it out, and a verdict for each thing said: low confidence, unknown words, wrong
    wholeness, bounds that leave observed values out and categories that lack some fall back to the data."""
    base, out, verdicts = structural(m), asdict(structural(m)), []

    def say(what: str, accepted: bool, reason: str = "") -> None:
        verdicts.append({"column": m.name, "claim": what, "accepted": accepted, "reason": reason, "source": claim.source})

    if claim.confidence < CONFIDENCE_FLOOR:
        say("all", False, "confidence too low")
        return base, verdicts
    for what, known in (("kind", KINDS), ("role", ROLES)):
        v = getattr(claim, what)
        if v is not None:
            say(what, v in known, "" if v in known else "unknown word")
            if v in known:
                out[what] = v
    if claim.integer is not None:
        ok = not claim.integer or m.is_integer
        say("integer", ok, "" if ok else "fractions observed")
        if ok:
            out["integer"] = claim.integer
    for what, ok in (("min", claim.min is not None and m.low is not None and claim.min <= m.low), ("max", claim.max is not None and m.high is not None and claim.max >= m.high)):
        if getattr(claim, what) is not None:
            say(what, ok, "" if ok else "observed values lie beyond")
            if ok:
                out[what] = getattr(claim, what)
    if claim.categories is not None:
        ok = set(m.categories) <= set(claim.categories)
        say("categories", ok, "" if ok else "observed values are missing")
        if ok:
            out["categories"] = tuple(claim.categories)
    if claim.unit is not None:
        out["unit"] = claim.unit
    out["source"] = claim.source
    return ColumnClaim(**out), verdicts


def resolve(fields: dict[str, FieldMeta], claims: list[ColumnClaim]) -> tuple[list[ColumnClaim], list[dict]]:
    """One vetted claim for each column, the strongest source's word standing; unknown columns are rejected and told."""
    chosen: dict[str, ColumnClaim] = {}
    verdicts = [{"column": c.name, "claim": "column", "accepted": False, "reason": "no such column", "source": c.source} for c in claims if c.name not in fields]
    for name, m in fields.items():
        out = structural(m)
        own = sorted((c for c in claims if c.name == name), key=lambda c: AUTHORITY.index(c.source) if c.source in AUTHORITY else len(AUTHORITY))
        for c in own[:1]:
            out, told = vet(c, m)
            verdicts += told
        chosen[name] = out
    return list(chosen.values()), verdicts


def propose(fields: dict[str, FieldMeta], caller, config: dict | None = None) -> list[ColumnClaim]:
    """Claims of a model, through an injected caller(prompt, payload, config) -> JSON list of objects. The payload has names
    and kinds only, no values. Whatever goes wrong gives no claims; resolve() vets the rest like any others."""
    payload = [{"name": m.name, "kind": m.kind, "integer": m.is_integer, "cardinality": m.cardinality} for m in fields.values()]
    try:
        told = json.loads(caller("Describe each column as JSON: name, kind, role, unit, confidence.", payload, config or {}))
        known = set(ColumnClaim.__dataclass_fields__) - {"source"}
        return [ColumnClaim(**{k: tuple(v) if k == "categories" and v else v for k, v in c.items() if k in known}, source="model") for c in told]
    except Exception:
        return []


def rules(claims: list[ColumnClaim]) -> dict[str, dict]:
    """What conformance() holds a delivered table to."""
    out = {}
    for c in claims:
        if c.kind == "identifier" or c.role == "identifier":
            out[c.name] = {"identifier": True}
        else:
            out[c.name] = {k: v for k, v in (("min", c.min), ("max", c.max), ("integer", c.integer), ("values", list(c.categories) if c.categories else None)) if v not in (None, False)}
    return {k: v for k, v in out.items() if v}
