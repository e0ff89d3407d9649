"""Context tiers: the smallest window that holds a text and what is said around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window sizes in tokens, characters a token of code, and tokens around an element of each type.
TIERS = [1024, 2048, 4096, 8192, 16384, 32768]
CHARS_PER_TOKEN = 4
AROUND = {
    "file": 950, "class": 1250, "interface": 950, "trait": 950, "enum": 850, "type_alias": 800, "function": 1650, "method": 1550, "constant": 1150, "variable": 1800, "import": 400,
}
AROUND_OTHER = 800


def tier_above(tokens: Column, strict: bool = True) -> Column:
    """Smallest tier above (or, if not strict, at least) ``tokens``; the largest if none is."""
    fits = F.filter(F.array(*[F.lit(t) for t in TIERS]), lambda t: (t > tokens) if strict else (t >= tokens))
    return F.coalesce(F.array_min(fits), F.lit(TIERS[-1]))


def element_tier(element_type: Column, chars: Column) -> Column:
    around = F.lit(AROUND_OTHER)
    for k, v in AROUND.items():
        around = F.when(element_type == k, v).otherwise(around)
    return tier_above(F.floor(chars / CHARS_PER_TOKEN) + around)


def element_tier_sql(element_type: str, chars: str) -> str:
    around = f"CASE {element_type} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AROUND.items()) + f" ELSE {AROUND_OTHER} END"
    return "CASE " + " ".join(f"WHEN {chars} // {CHARS_PER_TOKEN} + ({around}) < {t} THEN {t}" for t in TIERS) + f" ELSE {TIERS[-1]} END"
