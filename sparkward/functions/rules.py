"""Pattern rules for SQL built from strings: tables of rules, and the columns that apply them.

Patterns are Java regular expressions under (?imU), which match Unicode white space as Python's do. Everything stays in
generated code; there is no UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the detector, in their order.
DETECTOR_RULES = (
    ("fstring_sql", r"""(?:execute|executemany)\s*\(\s*f["']"""),
    ("concat_plus_sql", r"""["']\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*\+"""),
    ("format_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*\{[^}]+\}[^"']*["']\s*\.format"""),
    ("percent_format_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*%[sd][^"']*["']\s*%"""),
    ("sqlalchemy_text_fstring", r"""text\s*\(\s*f["']"""),
    ("sqlalchemy_text_format", r"""text\s*\(\s*["'][^"']*\{[^}]+\}"""),
    ("join_build_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*["']\s*\.join"""),
)
HEURISTIC = "unsafe_execute_heuristic"
# The patterns of the heuristic rule.
HEURISTIC_PATTERNS = (r"execute\s*\(\s*[^)]*\+", r"""execute\s*\(\s*f["']""", r"""executemany\s*\(\s*f["']""")
# The rules for training targets, in their order.
TARGET_RULES = (
    ("fstring_sql", r"""(?:execute|executemany)\s*\(\s*f["']"""),
    ("concat_plus_sql", r"""["']\s*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*\+"""),
    ("format_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*\{[^}]+\}[^"']*["']\s*\.format"""),
    ("percent_format_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*%[sd][^"']*["']\s*%"""),
    ("percent_format_sql_assigned", r"""["'][^"']*%[sd][^"']*["']\s*%\s*\("""),
    ("sqlalchemy_text_fstring", r"""text\s*\(\s*f["']"""),
    ("sqlalchemy_text_format", r"""text\s*\(\s*["'][^"']*\{[^}]+\}"""),
    ("execute_plus_concat", r"execute\s*\(\s*[^)]*\+"),
    ("join_build_sql", r"""(?:execute|executemany)\s*\(\s*["'][^"']*["']\s*\.join"""),
)


def matches(code: Column, pattern: str) -> Column:
    return F.coalesce(code, F.lit("")).rlike(f"(?imU){pattern}")


def rule_hits(code: Column, rules: tuple[tuple[str, str], ...] = DETECTOR_RULES, heuristic: bool = True) -> Column:
    """Names of the rules that match, in their order; an empty array where none does. Null code is empty."""
    tests = [F.when(matches(code, p), F.lit(name)) for name, p in rules]
    if heuristic:
        tests.append(F.when(reduce(lambda a, b: a | b, (matches(code, p) for p in HEURISTIC_PATTERNS)), F.lit(HEURISTIC)))
    return F.array_compact(F.array(*tests))


def target_is_safe(code: Column) -> Column:
    return F.size(rule_hits(code, TARGET_RULES, heuristic=False)) == 0


# Fixed values.
#: Merge modes of the detectors; weights of b608, any issue, rules and taint, and the bound, of the weighted mode.
MODES = ("or", "or_bandit_any", "weighted")
WEIGHTS = {"b608": 0.95, "any_issue": 0.35, "rules": 0.85, "taint": 0.9}
BOUND = 0.55


def merged_verdict(mode: str, b608: Column, any_issue: Column, rules: Column, taint: Column) -> Column:
    """Whether the detectors together call the code vulnerable; null flags count as false."""
    off = lambda c: F.coalesce(c, F.lit(False))
    b608, any_issue, rules, taint = map(off, (b608, any_issue, rules, taint))
    if mode == "or":
        return b608 | rules | taint
    if mode == "or_bandit_any":
        return any_issue | rules | taint
    if mode != "weighted":
        raise ValueError(f"unknown merge mode: {mode}")
    score = lambda c, k: F.when(c, WEIGHTS[k]).otherwise(0.0)
    static = F.when(b608, WEIGHTS["b608"]).otherwise(score(any_issue, "any_issue"))
    return F.greatest(static, score(rules, "rules"), score(taint, "taint")) >= BOUND


def detection_sources(mode: str, b608: Column, any_issue: Column, rules: Column, taint: Column) -> Column:
    """Names of the detectors that speak in this mode, in the order bandit, rules, taint."""
    static = F.when(any_issue, F.lit("bandit")) if mode == "or_bandit_any" else F.when(b608, F.lit("bandit_b608"))
    return F.array_compact(F.array(static, F.when(rules, F.lit("rule_based")), F.when(taint, F.lit("taint"))))
