"""Row validation (B7-B10): declared rules become a ``violations`` array column.

A rule set is data: ``Rule(name, column, check)`` where ``check`` builds a
boolean column. Every row gets the names of the rules it breaks; a null or
NaN in a required field is a violation of that field's ``required`` rule,
and a null never satisfies a range rule. Splitting valid from rejected rows
is two filters over the same lazily computed column, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DOMAINS, FORM_DEFAULTS


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    check: Callable[[Column], Column]


def _num(c: Column) -> Column:
    """A number that is not NaN (Spark orders NaN above every number)."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def ge(v):
    return lambda c: _num(c) & (c >= v)


def gt(v):
    return lambda c: _num(c) & (c > v)


def le(v):
    return lambda c: _num(c) & (c <= v)


def between(lo, hi, lo_open=False):
    return lambda c: _num(c) & ((c > lo) if lo_open else (c >= lo)) & (c <= hi)


def one_of(values):
    return lambda c: c.isin(list(values))


REQUIRED_FIELDS = [
    "age", "income", "home", "emp_length", "intent",
    "amount", "rate", "percent_income", "default_flag", "cred_length",
]

# Rules enforced by the scoring service.
API_RULES = [
    Rule("age_range", "age", between(18, 100)),
    Rule("income_positive", "income", gt(0)),
    Rule("emp_length_nonnegative", "emp_length", ge(0)),
    Rule("amount_positive", "amount", gt(0)),
    Rule("rate_range", "rate", between(0, 30, lo_open=True)),
    Rule("percent_income_range", "percent_income", between(0, 1)),
    Rule("cred_length_nonnegative", "cred_length", ge(0)),
]

# The stricter variant of the entry form.
FORM_RULES = [
    Rule("age_range", "age", between(18, 100)),
    Rule("income_min", "income", ge(1)),
    Rule("emp_length_nonnegative", "emp_length", ge(0)),
    Rule("amount_min", "amount", ge(1)),
    Rule("rate_range", "rate", between(0.01, 30)),
    Rule("percent_income_range", "percent_income", between(0, 1)),
    Rule("cred_length_nonnegative", "cred_length", ge(0)),
]

# Domain checks (B9); the service describes but does not enforce them.
DOMAIN_RULES = [Rule(f"{c}_domain", c, one_of(v)) for c, v in DOMAINS.items()]


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(c)
    if dict(df.dtypes)[c] in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def violations(df: DataFrame, rules: list[Rule], required: list[str] | None = REQUIRED_FIELDS,
               columns: dict[str, str] | None = None) -> Column:
    """``array<string>`` of broken rule names (empty when the row is valid).

    A required field that is missing reports ``<field>_required`` and not
    its range rule as well. ``columns`` renames fields to input columns.
    """
    columns = columns or {}
    name_of = lambda f: columns.get(f, f)
    checks = []
    req = set(required or [])
    for f in required or []:
        checks.append(F.when(_missing(df, name_of(f)), F.lit(f"{f}_required")))
    for r in rules:
        c = name_of(r.column)
        ok = r.check(F.col(c))
        bad = ~F.coalesce(ok, F.lit(False))
        if r.column in req:
            bad = bad & ~_missing(df, c)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, rules: list[Rule] = API_RULES, required: list[str] | None = REQUIRED_FIELDS,
             columns: dict[str, str] | None = None, out_col: str = "violations") -> DataFrame:
    """Add the ``violations`` column."""
    return df.withColumn(out_col, violations(df, rules, required, columns))


def split_valid(validated: DataFrame, col: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Valid rows (without the column) and rejected rows (with it)."""
    valid = validated.where(F.size(col) == 0).drop(col)
    rejected = validated.where(F.size(col) > 0)
    return valid, rejected


def fill_form_defaults(df: DataFrame, defaults: dict[str, str] | None = None,
                       columns: dict[str, str] | None = None) -> DataFrame:
    """Unset category fields take the form defaults (home RENT, intent PERSONAL, default N)."""
    columns = columns or {}
    fill = {columns.get(k, k): v for k, v in (defaults or FORM_DEFAULTS).items()}
    return df.fillna({k: v for k, v in fill.items() if k in df.columns})
