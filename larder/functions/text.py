"""Column functions on text that keep Python's meaning where Spark's built-in differs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value in delimited files, beside an empty cell.
NA_TEXTS = (
    "na", "Na", "NA", "n/a", "N/A", "n.a.", "N.A.", "none", "None", "NONE", "null", "Null", "NULL", "nan", "NaN", "NAN", "-", "--",
    "not available", "not applicable", "unknown", "Unknown", "UNKNOWN", "",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def null_texts(c: Column, texts: tuple[str, ...] = NA_TEXTS) -> Column:
    """Null where the stripped text stands for a missing value."""
    return F.when(~strip(c).isin(*texts), c)


def as_text(c: Column, dtype: str) -> Column:
    """Text of a value as Python prints it: whole doubles end in .0, booleans are True and False."""
    if dtype in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
        return F.when(F.isnan(c), "nan").when(whole, F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    if dtype == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: named groups, Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


def java_replacement(text: str) -> str:
    """A Python replacement for Java: \\1 and \\g<1> become $1."""
    text = re.sub(r"\\g<(\w+)>", r"\\\1", text)
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def title(c: Column) -> Column:
    """Python's title case: every letter after a non-letter is capital, the others small."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def from_strptime(fmt: str) -> str | None:
    """Java date pattern of a strptime format; null if it has no directive or one without a counterpart."""
    known = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "I": "hh", "p": "a", "j": "DDD", "z": "xx"}
    out, i, seen = [], 0, False
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d == "%":
                out.append("'%'")
            elif d in known:
                out.append(known[d])
                seen = True
            else:
                return None
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out) if seen else None


@F.pandas_udf(T.StringType())
def literal_to_json(s: pd.Series) -> pd.Series:
    """JSON text of a Python literal (single quotes, None, True); null if it is none."""
    import ast
    import json

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            v = ast.literal_eval(t)
            return json.dumps(v) if isinstance(v, (dict, list)) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return s.map(one, na_action="ignore")


def json_text(c: Column) -> Column:
    """The text if it is JSON, else the JSON of the Python literal it is, else null; only the latter rows leave the JVM."""
    ok = F.try_parse_json(c).isNotNull()
    return F.when(ok, c).otherwise(literal_to_json(F.when(~ok, c)))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty texts. Longest common subsequence by bit vectors."""
    if not a and not b:
        return 100.0
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    s = (1 << len(a)) - 1
    full = s
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_sort(t: str) -> str:
    """Words in order, joined by a space."""
    return " ".join(sorted(t.split()))
