"""Blocks by name, block sequences of domains, their validation, and runs with a trace."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from larder.operators import cleaning, dedup, enrich, mapping, quality
from larder.session import cut

Block = Callable[[DataFrame, "Context"], DataFrame]

# Block sequences of the domains; `__generated__` stands for the mapping programs, `dedup_stage` for three blocks.
DEDUP_STAGE = ("fuzzy_deduplicate", "column_wise_merge", "golden_record_select")
CLEANERS = ("strip_whitespace", "lowercase_brand", "remove_noise_words", "strip_punctuation")
SEQUENCES: dict[str, tuple[str, ...]] = {
    "nutrition": ("dq_score_pre", "__generated__", *CLEANERS, "extract_quantity_column", "dedup_stage", "extract_allergens", "llm_enrich", "dq_score_post"),
    "safety": ("dq_score_pre", "__generated__", *CLEANERS, "dedup_stage", "dq_score_post"),
    "pricing": ("dq_score_pre", "__generated__", *CLEANERS, "keep_quantity_in_name", "dedup_stage", "dq_score_post"),
    "retail_inventory": ("dq_score_pre", "__generated__", "strip_whitespace", "remove_noise_words", "dedup_stage", "dq_score_post"),
    "healthcare_test": ("dq_score_pre", "__generated__", *CLEANERS, "llm_enrich", "dq_score_post"),
    "pharma": ("dq_score_pre", "__generated__", "strip_whitespace", "lowercase_brand", "llm_enrich", "dq_score_post"),
}
FALLBACK = ("dq_score_pre", "__generated__", "strip_whitespace", "remove_noise_words", "dq_score_post")


@dataclass
class Context:
    """What a run knows: row id column, date that counts as today, mapping programs of the source, trace so far."""

    as_of: str
    row_id: str = "record_id"
    source: str = ""
    programs: dict[str, list[dict]] = field(default_factory=dict)
    all_domain: bool = False
    reference: list[str] | None = None
    required: Sequence[str] = ("product_name",)
    trace: list[dict] = field(default_factory=list)


def _pre(df: DataFrame, c: Context) -> DataFrame:
    c.reference = quality.score_columns(df)
    return quality.quality_score(df, "dq_score_pre", c.as_of, c.reference)


def _post(df: DataFrame, c: Context) -> DataFrame:
    df = quality.quality_score(df, "dq_score_post", c.as_of, c.reference)
    return quality.score_delta(df) if "dq_score_pre" in df.columns else df


def _generated(df: DataFrame, c: Context) -> DataFrame:
    programs = [p for ps in c.programs.values() for p in ps] if c.all_domain else c.programs.get(c.source, [])
    for p in programs:
        df = mapping.apply(df, p)
    return df


def _merge(df: DataFrame, c: Context) -> DataFrame:
    return dedup.merge_columns(df, "duplicate_group_id", c.row_id) if "duplicate_group_id" in df.columns else df


def _golden(df: DataFrame, c: Context) -> DataFrame:
    return dedup.golden_records(df, "duplicate_group_id", c.row_id).drop("golden_score") if "duplicate_group_id" in df.columns else df


BLOCKS: dict[str, Block] = {
    "dq_score_pre": _pre, "dq_score_post": _post, "__generated__": _generated, "strip_whitespace": lambda df, c: cleaning.strip_whitespace(df), "lowercase_brand": lambda df, c: cleaning.lowercase_brand(df),
    "remove_noise_words": lambda df, c: cleaning.remove_noise_words(df), "strip_punctuation": lambda df, c: cleaning.strip_punctuation(df), "keep_quantity_in_name": lambda df, c: df,
    "extract_quantity_column": lambda df, c: cleaning.extract_quantity(df), "fuzzy_deduplicate": lambda df, c: dedup.duplicate_groups(cut(df), c.row_id), "column_wise_merge": _merge, "golden_record_select": _golden,
    "extract_allergens": lambda df, c: cleaning.extract_allergens(df), "llm_enrich": lambda df, c: cut(enrich.apply_rules(df)),  # the rules' values are used many times by the score, the cleaned rows several times by deduplication
}


def register(name: str, block: Block) -> None:
    """Add a block of one's own, e.g. `domain__name`."""
    BLOCKS[name] = block


def expand(sequence: Sequence[str]) -> list[str]:
    """The sequence with stages as their blocks."""
    return [b for name in sequence for b in (DEDUP_STAGE if name == "dedup_stage" else (name,))]


def sequence_of(domain: str) -> list[str]:
    """The blocks of a domain; the fallback for one without a sequence."""
    return expand(SEQUENCES.get(domain, FALLBACK))


def silver_sequence(domain: str) -> list[str]:
    """The blocks up to deduplication."""
    return [b for b in sequence_of(domain) if b not in (*DEDUP_STAGE, "llm_enrich", "extract_allergens", "dq_score_post")]


def gold_sequence(domain: str) -> list[str]:
    """Deduplication and what follows."""
    return [b for b in sequence_of(domain) if b in (*DEDUP_STAGE, "llm_enrich", "extract_allergens", "dq_score_post")]


def validate(sequence: Sequence[str], expected: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(errors, warnings): unknown and repeated blocks, scores not at the ends, cleaning behind deduplication, allergens behind enrichment."""
    s = expand(sequence)
    errors = [f"unknown block {b}" for b in s if b not in BLOCKS] + [f"repeated block {b}" for b in sorted({b for b in s if s.count(b) > 1})]
    if "dq_score_pre" in s and s[0] != "dq_score_pre":
        errors.append("dq_score_pre must come first")
    if "dq_score_post" in s and s[-1] != "dq_score_post":
        errors.append("dq_score_post must come last")
    if "fuzzy_deduplicate" in s:
        errors += [f"{b} must come before fuzzy_deduplicate" for b in CLEANERS if b in s and s.index(b) > s.index("fuzzy_deduplicate")]
    if "extract_allergens" in s and "llm_enrich" in s and s.index("extract_allergens") > s.index("llm_enrich"):
        errors.append("extract_allergens must come before llm_enrich")
    return errors, [f"lacks {b}" for b in expected if b not in s]


def run(df: DataFrame, sequence: Sequence[str], context: Context, measure: bool = False) -> DataFrame:
    """The frame after all blocks, one lazy plan; with `measure` each block is counted (an action per block) for the trace."""
    errors, _ = validate(sequence)
    if errors:
        raise ValueError("; ".join(errors))
    rows = df.count() if measure else None
    for name in expand(sequence):
        began = time.time()
        df = BLOCKS[name](df, context)
        entry = {"block": name, "columns": len(df.columns), "seconds": time.time() - began}
        if measure:
            after = df.count()
            entry |= {"rows_in": rows, "rows_out": after}
            rows = after
        context.trace.append(entry)
    return df
