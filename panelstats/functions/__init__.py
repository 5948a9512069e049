"""Column functions: recoding, null rules, text, weighted statistics."""

from .nulls import (
    bround, cut, either, if_else, isin, na_to, paste, same, shift_code, zero_to_null,
)
from .recode import (
    clamp_low, deflated, fallback, floor_bin, harmonise, ihs, log1p_income, no_income,
    recode, sentinel_null, signed_sum, valid_when,
)
from .stats import (
    centers, cochran_var, growth_pct, log_se, logistic, logit, mean_ci, pct_effect, ratio_pct, wmean,
    wpct, wvar,
)
from .text import (
    comma, first_match, number, pad0, percent_label, sentence_case, slice_code, title_case,
)

__all__ = [n for n in dir() if not n.startswith("_")]
