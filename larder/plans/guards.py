"""Checks of mapping plans and of enrichment results before they run or are written."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import mapping
from larder.operators.quality import Schema

# Primitives, columns that only rules may fill, most operations, most growth, greatest response, review limits.
PRIMITIVES = ("ADD", "CAST", "FORMAT", "RENAME", "DELETE", "SPLIT", "UNIFY", "DERIVE")
SAFETY = ("allergens", "dietary_tags", "is_organic")
MOST_OPERATIONS, MOST_CHARS = 500, 200_000
REVIEW_OPERATIONS, REVIEW_UNRESOLVED, REVIEW_CONFIDENCE, MOST_BATCH = 15, 5, 0.5, 50


def check_plan(plan: Sequence[dict], source_columns: Sequence[str], schema: Schema) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a plan of primitives."""
    errors, warnings = [], []
    if len(plan) > MOST_OPERATIONS:
        errors.append(f"{len(plan)} operations, at most {MOST_OPERATIONS}")
    protected = {f.name for f in schema.fields if f.computed or f.enrichment} | set(SAFETY)
    targets: list[str] = []
    for i, p in enumerate(plan):
        kind = str(p.get("primitive", "")).upper()
        if kind not in PRIMITIVES:
            errors.append(f"operation {i}: unknown primitive {kind!r}")
        if p.get("action") and p["action"] not in mapping.ACTIONS:
            errors.append(f"operation {i}: unknown action {p['action']!r}")
        for s in [p.get("source"), *p.get("sources", [])]:
            if s and kind != "ADD" and s not in source_columns:
                errors.append(f"operation {i}: no source column {s}")
        t = p.get("target")
        if t in protected and kind != "DELETE":
            errors.append(f"operation {i}: {t} is not to be mapped")
        if t in targets:
            warnings.append(f"operation {i}: {t} is set again")
        if t:
            targets.append(t)
    return errors, warnings


def check_critique(plan: Sequence[dict], revised: object, schema: Schema) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a revised plan: it must be a list that has not grown beyond three times (and twenty), with known
    primitives; unknown targets are warned of."""
    if not isinstance(revised, list):
        return ["not a list"], []
    errors = [f"grown from {len(plan)} to {len(revised)} operations"] if len(revised) > 3 * len(plan) and len(revised) > 20 else []
    errors += [f"operation {i}: unknown primitive" for i, p in enumerate(revised) if str(p.get("primitive", "")).upper() not in PRIMITIVES]
    names = {f.name for f in schema.fields}
    return errors, [f"operation {i}: unknown target {p['target']}" for i, p in enumerate(revised) if p.get("target") and p["target"] not in names]


def check_response(text: str, prompt: str = "") -> tuple[list[str], list[str]]:
    """(errors, warnings) of a raw response: size, JSON or fenced JSON, echo of the prompt."""
    errors, warnings = [], []
    if len(text) > MOST_CHARS:
        errors.append("too long")
    body = m.group(1) if (m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S)) else text
    try:
        json.loads(body)
    except ValueError:
        errors.append("no JSON")
    if prompt and prompt[:200] and prompt[:200] in text:
        warnings.append("echoes the prompt")
    return errors, warnings


def needs_review(operations: int, unresolved: int, confidence: float) -> bool:
    """Whether a person should look at a plan."""
    return operations > REVIEW_OPERATIONS or unresolved > REVIEW_UNRESOLVED or confidence < REVIEW_CONFIDENCE


def check_results(df: DataFrame, rows: int, categories: Sequence[str]) -> DataFrame:
    """Enrichment results (idx, category, ...) with `valid` (index in range) and `known` (category of the list or null); safety
    columns are removed."""
    out = df.drop(*SAFETY)
    return out.withColumns({"valid": F.col("idx").between(0, rows - 1), "known": F.coalesce(F.col("category").isin(*categories), F.lit(True))})


def correct_plan(plan: Sequence[dict], source_types: dict[str, str], schema: Schema, provider: Sequence[str] = ()) -> list[dict]:
    """Deterministic corrections: a rename between type families becomes a cast, deletions of the provider's columns go, and
    columns that nothing uses are deleted."""
    family = lambda t: "number" if t in ("double", "float", "bigint", "int", "integer") else "boolean" if t == "boolean" else "string"
    kinds = {f.name: f.type for f in schema.fields}
    out = []
    for p in plan:
        kind = str(p.get("primitive", "")).upper()
        if kind == "DELETE" and p.get("source") in provider:
            continue
        if kind == "RENAME" and p.get("target") in kinds and family(source_types.get(p.get("source"), "string")) != family(kinds[p["target"]]):
            p = p | {"primitive": "CAST", "type": kinds[p["target"]]}
        out.append(p)
    used = {s for p in out for s in [p.get("source"), *p.get("sources", [])] if s} | set(kinds) | set(provider)
    return out + [{"primitive": "DELETE", "source": c} for c in source_types if c not in used]


def check_domain(sequence: Sequence[str], custom: Sequence[str], available: Sequence[str]) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a domain pack: mapping programs and scores in place, custom blocks available."""
    from larder.plans.registry import validate

    errors, warnings = validate(sequence)
    if "__generated__" not in sequence:
        errors.append("lacks __generated__")
    errors += [f"no file of custom block {b}" for b in custom if b not in available]
    return errors, warnings + [f"custom block {b} is not in the sequence" for b in custom if b not in sequence]
