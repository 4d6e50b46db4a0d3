"""Column expressions over text, dates and categories."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import fixed


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alternation(words: list[str]) -> str:
    return "|".join(words)


# --- parsing -------------------------------------------------------------

def safe_date(c) -> Column:
    """``yyyymmdd`` integer or text to date, null when it is no real day."""
    return F.try_to_date(_c(c).cast("string"), "yyyyMMdd")


def safe_long(c) -> Column:
    return _c(c).try_cast("bigint")


def safe_double(c) -> Column:
    return _c(c).try_cast("double")


def parse_mixed_date(c) -> Column:
    """Spreadsheet serial number, ISO date or US date, in that order."""
    c = _c(c)
    serial = c.try_cast("int")
    return F.coalesce(
        F.when(serial.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), serial)),
        F.try_to_date(c, "yyyy-MM-dd"),
        F.try_to_date(c, "M/d/yyyy"),
    )


def date_year_mismatch(d, year) -> Column:
    d = _c(d)
    return d.isNull() | (F.year(d) != _c(year))


def add_years(d, years) -> Column:
    """Same calendar day N years on; 29 February falls on 28 February."""
    return F.add_months(_c(d), (F.lit(years) if isinstance(years, int) else _c(years)) * 12)


def followup_complete(anchor, years: int, cutoff: Column) -> Column:
    return add_years(anchor, years) <= cutoff


# --- predicates and flags ------------------------------------------------

def non_blank(c) -> Column:
    c = _c(c)
    return c.isNotNull() & (F.trim(c) != "")


def has_token(c, words: list[str]) -> Column:
    return F.regexp_like(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(f"(^| )({alternation(words)})( |$)"))


def combination_flag(c) -> Column:
    return F.regexp_like(F.lower(_c(c)), F.lit(r"\+|/|\sand\s"))


def multi_active(c) -> Column:
    outside = F.regexp_replace(_c(c), r"\([^)]*\)", "")
    return F.regexp_like(outside, F.lit(r"(?i)[,;]|\s+and\s+"))


def word_flag(c, words: list[str], whole: bool = True) -> Column:
    body = alternation(words)
    return F.regexp_like(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(rf"\b({body})\b" if whole else body))


def keyword_class(c, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """First rule whose keyword occurs decides."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    out = None
    for word, label in rules:
        hit = low.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if default is not None else out


def collapse_status(c, keep_na: bool = False) -> Column:
    c = _c(c).cast("string")
    low = F.lower(c)
    out = F.when(low.startswith("yes") | (low == "true"), "Yes")
    if keep_na:
        out = out.when(c == "N/A", "N/A")
    return out.when(low.isin("no", "false"), "No").otherwise("MISSING/UNKNOWN")


def _broad(c, rules) -> Column:
    c = _c(c)
    out = F.when(~F.coalesce(non_blank(c), F.lit(False)), "MISSING/UNKNOWN").when(F.instr(c, "|") > 0, "MULTIPLE")
    for word, label in rules:
        out = out.when(F.lower(c).contains(word), label)
    return out.otherwise("OTHER")


def broad_route(c) -> Column:
    return _broad(c, fixed.ROUTE_CLASSES)


def broad_form(c) -> Column:
    return _broad(c, fixed.FORM_CLASSES)


def threshold_class(c, missing: str | None = "MISSING") -> Column:
    c = _c(c)
    out = F.when(c == 0, "0%").when((c > 0) & (c < 5), ">0_TO_<5%").when(c == 5, "=5%").when(c > 5, ">5%")
    return out.otherwise(F.lit(missing)) if missing else out


COVERAGE_BINS = ["0%", ">0-10%", ">10-25%", ">25-50%", ">50%", "NO_SIGNALS"]


def coverage_bin(c) -> Column:
    c = _c(c)
    return (
        F.when(c.isNull(), "NO_SIGNALS").when(c == 0, "0%").when(c <= 0.10, ">0-10%")
        .when(c <= 0.25, ">10-25%").when(c <= 0.50, ">25-50%").otherwise(">50%")
    )


def volume_tiers(c, minima: list[int], prefix: str) -> list[Column]:
    return [(_c(c) >= k).alias(f"{prefix}{k}") for k in minima]


# --- text keys -----------------------------------------------------------

@pandas_udf(StringType())
def norm_l1(s: pd.Series) -> pd.Series:
    """Compatibility-normalise, case-fold, squeeze blanks. Use on distinct terms."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


@pandas_udf(StringType())
def norm_l2(s: pd.Series) -> pd.Series:
    """As ``norm_l1`` with every non-alphanumeric character turned into a blank."""

    def one(v):
        if v is None:
            return None
        folded = unicodedata.normalize("NFKC", v).casefold()
        return " ".join("".join(ch if ch.isalnum() else " " for ch in folded).split())

    return s.map(one)


@pandas_udf(StringType())
def _fold_name(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


clean_text = squeeze


def identity_key(c) -> Column:
    """Name with compatibility forms, case and blanks folded."""
    return norm_l1(_c(c))


def fold_key(c) -> Column:
    return F.upper(F.trim(_c(c)))


def title_key(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(c), "[^A-Za-z0-9]+", " ")))


def agent_key(c) -> Column:
    x = F.regexp_replace(F.lower(_c(c)), fixed.BRACKETS, " ")
    x = F.regexp_replace(x, fixed.STRENGTH, " ")
    x = F.regexp_replace(x, rf"\b({alternation(fixed.AGENT_WORDS)})\b", " ")
    x = F.regexp_replace(x, "[^a-z0-9 -]+", " ")
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def name_tokens(c) -> Column:
    x = F.regexp_replace(F.lower(_c(c)), fixed.BRACKETS, " ")
    x = F.regexp_replace(x, fixed.STRENGTH, " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")
    forms = F.array(*[F.lit(w) for w in fixed.FORM_WORDS])
    return F.filter(F.split(x, " "), lambda t: (t != "") & ~F.array_contains(forms, t))


def name_key(c) -> Column:
    """Name without brackets, strengths and dosage-form words. Unicode names: fold them first."""
    return F.array_join(name_tokens(c), " ")


def base_key(c) -> Column:
    """``name_key`` without a four-letter suffix (names with a hyphen) and trailing salt words."""
    key = name_key(c)
    cut = F.when(F.instr(_c(c), "-") > 0, F.regexp_replace(key, "(^| )[a-z]{4}$", "")).otherwise(key)
    return F.regexp_replace(cut, rf"((^| )({alternation(fixed.SALT_WORDS)}))+$", "")


def fold_names(c) -> Column:
    """Unicode folding for raw names, applied to distinct names only."""
    return _fold_name(_c(c))


def split_list(c, pattern: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(_c(c), pattern), lambda x: F.trim(x)), lambda x: x != "")


def dev_codes(arr) -> Column:
    return F.filter(_c(arr), lambda x: F.regexp_like(F.trim(x), F.lit(fixed.DEV_CODE)))


def pair_id(*cols) -> Column:
    return F.md5(F.concat_ws("|", *[_c(c) for c in cols]))


# --- display -------------------------------------------------------------

def fmt_count_pct(n, d) -> Column:
    return F.format_string("%d (%.1f%%)", _c(n), F.try_divide(F.lit(100.0) * _c(n), _c(d)))


def fmt_ratio(n, d) -> Column:
    return F.format_string("%d/%d", _c(n), _c(d))


def fmt_estimate(est, lo, hi, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f (%.{digits}f-%.{digits}f)", _c(est), _c(lo), _c(hi))


def fmt_quartiles(med, q1, q3, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f [%.{digits}f-%.{digits}f]", _c(med), _c(q1), _c(q3))
