"""Column functions on single values: missing values, tolerant casts, labels, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float and double column with NaN as null; infinities stay."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def finite_mean(x: Column) -> Column:
    """A32/`safe mean`: mean of the finite entries, null if there is none."""
    return F.avg(present(x))


def to_int(x: Column) -> Column:
    """the integer that a text or number stands for, truncated; null if none."""
    return x.try_cast("double").try_cast("int")


def to_double(x: Column) -> Column:
    """the finite number that a text stands for; null if none."""
    return present(x.try_cast("double"))


def contract(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The schema's columns in order; those that ``df`` lacks are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def has_columns(df: DataFrame, *names: str) -> bool:
    """Whether the operator that needs ``names`` has anything to work on."""
    return set(names) <= set(df.columns)


def status_band(value: Column, red: float, amber: float, higher_is_worse: bool = True) -> Column:
    """P10: red, amber or green by strict thresholds; a missing value is amber."""
    over = (lambda t: value > t) if higher_is_worse else (lambda t: value < t)
    return F.when(value.isNull() | F.isnan(value), "amber").when(over(red), "red").when(over(amber), "amber").otherwise("green")


def joined_reasons(**rules: Column) -> Column:
    """Names of the rules that hold, joined by "|"; empty if none does."""
    return F.concat_ws("|", *[F.when(rule, name) for name, rule in rules.items()])


def first_failure(stages: Sequence[tuple[str, Column]], passed: str = "ok") -> Column:
    """Name of the first stage whose condition holds."""
    out = F
    for name, failed in stages:
        out = out.when(failed, name)
    return out.otherwise(passed)


def string_number(s_num: Column, label: Column) -> Column:
    """s_num, else the leading integer of a label such as "6 (low E)", else 0."""
    return F.coalesce(s_num, F.regexp_extract(label, r"^\s*(-?\d+)(?:\s|$)", 1).try_cast("int"), F.lit(0))


def safe_name(text: Column) -> Column:
    """Only letters, digits and -_. stay; "x" if nothing does."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_.-]", "")
    return F.when(kept == "", "x").otherwise(kept)


def channel_list(text: Column, available: Column) -> Column:
    """P25: channels of "1,2,5" within 1..available; the first eight at most without a list."""
    parsed = F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c).try_cast("int")), lambda c: c.between(1, available))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.sequence(F.lit(1), F.least(F.lit(8), available))).otherwise(parsed)


def element_scores(flat: Column) -> Column:
    """[el, score, el, score, ...] as structs; a score that is no number is NaN."""
    at = F.filter(F.sequence(F.lit(0), F.size(flat) - 1), lambda i: (i % 2 == 0) & (i + 1 < F.size(flat)))
    pair = lambda i: F.struct(flat[i].alias("element"), F.coalesce(flat[i + 1].try_cast("double"), F.lit(float("nan"))).alias("score"))
    return F.when(F.size(flat) >= 2, F.transform(at, pair)).otherwise(F.array().cast("array<struct<element:string,score:double>>"))


def one_hot(x: Column, values: Sequence) -> list[Column]:
    """1.0 or 0.0 for each value; all 0.0 for null or another value."""
    return [F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values]


def named(x: Column, names: dict[int, str]) -> Column:
    """a value's name, else the value as text."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), x.cast("string"))


def percent(x: Column, digits: int = 1) -> Column:
    """a share as a percentage; a dash for a missing one."""
    return F.when(x.isNull() | F.isnan(x), "–").otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def html_escape(text: Column) -> Column:
    """text that is safe between tags and in attributes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """the value at share ``t`` of the way from a to b."""
    return a + (b - a) * t


def rms(samples: Column) -> Column:
    """root of the mean square of an array; null if it is empty."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples)))


def diagnosis(heard_left: Column, heard_right: Column, ratio: float = 2.0, floor: float = 1e-4) -> Column:
    """F32: what was heard against the side that was played (left): PASS, SWAPPED, FAIL or UNCLEAR."""
    return (
        F.when((heard_left < floor) & (heard_right < floor), "FAIL")
        .when(heard_left >= ratio * heard_right, "PASS")
        .when(heard_right >= ratio * heard_left, "SWAPPED")
        .otherwise("UNCLEAR")
    )


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """P5: rows whose columns have the wanted values; what is wanted as None is not asked for."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def pick_named(df: DataFrame, name: str, needle: str, order: Sequence[Column]) -> DataFrame:
    """Of the rows whose name holds ``needle`` in any case the first by ``order``; a needle of digits is the row's place in ``order``."""
    if needle.isdigit():
        return df.orderBy(*order).offset(int(needle)).limit(1)
    return df.where(F.contains(F.lower(F.col(name)), F.lit(needle.lower()))).orderBy(*order).limit(1)


def setting(document: Column, path: str, default) -> Column:
    """a value of a JSON document as the default's type, else the default."""
    kind = {int: "bigint", float: "double", bool: "boolean"}.get(type(default), "string")
    return F.coalesce(F.get_json_object(document, path).try_cast(kind), F.lit(default))


def below(root: str, path: Column) -> Column:
    """an absolute path as it is, another one below ``root``."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def lacking(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns of ``df`` that are not among ``names``, in order."""
    return df.select(*[c for c in df.columns if c not in set(names)])


def two_sided_p(z: Column) -> Column:
    """Chance that a standard normal value lies farther from 0 than ``z``; 1 for z at or below 0, null for null.

    A power series below 2.8 and a continued fraction above it, both good to more than ten digits.
    """
    x = F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def grow(s: Column, n: Column) -> Column:
        term = -s["term"] * x * x / n
        return F.struct(term.alias("term"), (s["sum"] + term / (2 * n + 1)).alias("sum"))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, grow)["sum"] * 2 / F.sqrt(F.pi())
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda t, k: x + k / 2 / t)
    return F.when(z.isNull(), None).when(x < 2, 1 - near).otherwise(F.exp(-x * x) / (F.sqrt(F.pi()) * fraction))
