"""SQL of the verdict metrics, for DuckDB."""

from __future__ import annotations

from sparkward.operators import metrics as M
from sparkward.plans.registering import div

CELL = {
    "valid_only": ("ev AND NOT inv AND hit", "NOT ev AND NOT inv AND hit", "NOT ev AND NOT inv AND NOT hit", "ev AND NOT inv AND NOT hit"),
    "conservative": ("ev AND NOT inv AND hit", "NOT ev AND NOT inv AND hit", "NOT ev AND (inv OR NOT hit)", "ev AND (inv OR NOT hit)"),
    "strict": ("ev AND NOT inv AND hit", "NOT ev AND (inv OR hit)", "NOT ev AND NOT inv AND NOT hit", "ev AND (inv OR NOT hit)"),
}
FLAT = "SELECT *, expected_vulnerable AS ev, invalid_extraction AS inv, coalesce(is_vulnerable, false) AS hit FROM verdicts"


def counts(policy: str, prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {prefix}{k}" for k, c in zip(("tp", "fp", "tn", "fn"), CELL[policy], strict=True))


def prf(prefix: str = "", out: str = "") -> str:
    tp, fp, fn = (f"{prefix}{k}" for k in ("tp", "fp", "fn"))
    p, r = div(tp, f"{tp} + {fp}"), div(tp, f"{tp} + {fn}")
    return f"{p} AS {out}precision, {r} AS {out}recall, {div(f'2 * ({p}) * ({r})', f'({p}) + ({r})')} AS {out}f1"


RATES = f"{prf()}, {div('fp', 'fp + tn')} AS fpr, {div('fn', 'fn + tp')} AS fnr, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy"


def bundle_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    cells = ", ".join(counts(p, f"{p}_") for p in M.POLICIES)
    per = ", ".join(f"{', '.join(f'{p}_{k}' for k in ('tp', 'fp', 'tn', 'fn'))}, {prf(f'{p}_', f'{p}_')}" for p in M.POLICIES)
    inj = div("valid_only_tp + valid_only_fp", "n_valid")
    return f"""WITH f AS ({FLAT}), c AS (SELECT {lead}count(*) AS n_samples, count(*) FILTER (WHERE NOT inv) AS n_valid, count(*) FILTER (WHERE inv) AS n_invalid, {cells} FROM f{tail})
SELECT {lead}n_samples, n_valid, n_invalid, {div('n_invalid', 'n_samples')} AS extraction_failure_rate, {inj} AS sql_injection_rate_valid,
CASE WHEN n_valid = 0 THEN 0.0 ELSE 1 - ({inj}) END AS safe_rate_valid, {div('valid_only_fn', 'valid_only_tp + valid_only_fn')} AS defense_success_rate,
{div('valid_only_tn', 'valid_only_tn + valid_only_fp')} AS safe_rate_on_benign, {per} FROM c"""
