"""Rule sets: which rules a trace is judged by."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame

from traceframe.functions import lookup
from traceframe.quality import requests, rules
from traceframe.session import stored

PROFILES = {
    "fingerprint": lookup.FINGERPRINT_PROFILE,
    "business-api": lookup.BUSINESS_API_PROFILE,
    "generic-vmp": (),
}


@dataclass(frozen=True)
class RuleSet:
    """Flags of a check. Long API and field lists are passed in, not built in."""

    schema_version: int | None = None
    expected: tuple[str, ...] = ()
    stack_for: tuple[str, ...] = ()
    context_for: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    family_evidence: bool = False
    complete_values: bool = False
    material_refs: bool = False
    arg_fields: DataFrame | None = field(default=None, compare=False)
    form_fields: bool = False
    parameters: tuple[str, ...] = ()
    contract: requests.RequestContract | None = None


def expected_for(profile: str | None, extra=(), catalogue: dict | None = None) -> tuple[str, ...]:
    """APIs of a profile plus an explicit list, each once, in that order.

    ``catalogue`` adds profiles, for instance the long list of reverse-engineering
    APIs, which callers keep as data.
    """
    known = {**PROFILES, **(catalogue or {})}
    base = known[profile] if profile is not None else ()
    return tuple(dict.fromkeys([*base, *extra]))


def strict(base: RuleSet, generic: bool) -> RuleSet:
    """The strict preset: schema 1, complete values, references, family evidence; and
    unless the profile is generic all families and the field checks."""
    out = replace(
        base, schema_version=base.schema_version or 1, complete_values=True, material_refs=True, family_evidence=True
    )
    if generic:
        return out
    return replace(out, families=tuple(dict.fromkeys([*base.families, *lookup.FAMILIES])), form_fields=True)


def check(events: DataFrame, rule_set: RuleSet) -> DataFrame:
    """All violations of a rule set. The leaf table, when needed, is built once."""
    r = rule_set
    if r.schema_version not in (None, 1, 2):
        raise ValueError(f"unsupported schema version: {r.schema_version}")
    needs_leaves = (
        r.complete_values or r.material_refs or r.family_evidence or r.arg_fields is not None or r.form_fields or r.parameters
    )
    leaf_rows = stored(rules.event_leaves(events), "leaves") if needs_leaves else None
    found = []
    if r.schema_version is not None:
        found.append(rules.record_v1(events) if r.schema_version == 1 else rules.record_v2(events))
        found.append(rules.global_sequence(events))
        if r.schema_version == 2:
            found.append(rules.causality(events))
    if r.context_for:
        found.append(rules.context(events, r.context_for))
    if r.complete_values:
        found.append(rules.complete_values(events, leaf_rows))
    if r.material_refs:
        found.append(rules.material_refs(leaf_rows))
    if r.expected:
        found.append(rules.expected_apis(events, r.expected))
    if r.stack_for:
        found.append(rules.stack_presence(events, r.stack_for))
    if r.families or r.family_evidence:
        found.append(rules.families(events, leaf_rows, r.families, r.family_evidence))
    if r.arg_fields is not None:
        found.append(rules.arg_fields(events, leaf_rows, r.arg_fields))
    if r.form_fields:
        found.append(rules.form_branches(events, leaf_rows))
    if r.contract is not None:
        found.append(requests.request_conformance(events, r.contract))
    if r.parameters:
        found.append(requests.parameter_materialisation(events, leaf_rows, r.parameters))
    if not found:
        raise ValueError("empty rule set")
    return reduce(lambda a, b: a.unionByName(b), found)
