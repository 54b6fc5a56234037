"""Numbers in answers and evidence."""

from __future__ import annotations

import ast
import operator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seshat.functions.text import normalize_answer, text

LARGEST = 1e18
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


def evaluate(expression: str | None) -> float | None:
    """Value of an arithmetic expression of numbers, + - * / ** and signs; None where it has none."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            out = float(node.value)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            out = value(node.operand) * (-1 if isinstance(node.op, ast.USub) else 1)
        elif isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            out = _BINARY[type(node.op)](a, b)
        else:
            raise ValueError("not arithmetic")
        if isinstance(out, complex) or abs(out) > LARGEST:
            raise ValueError("out of range")
        return out

    try:
        return value(ast.parse((expression or "").replace(",", "").replace("$", "").replace("%", "").strip(), mode="eval"))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


@F.pandas_udf(DoubleType())
def safe_eval(expressions: pd.Series) -> pd.Series:
    return pd.Series([evaluate(e) for e in expressions], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def numeric_value(c: Column | str) -> Column:
    """The first number of a text without currency signs and thousands separators; null without one."""
    return F.regexp_extract(F.regexp_replace(F.trim(text(c)), "[$€£¥,]", ""), r"-?\d+\.?\d*", 0).try_cast("double")


def exact_match(prediction: Column | str, truth: Column | str) -> Column:
    return (_both(prediction, truth) & (normalize_answer(prediction) == normalize_answer(truth))).cast("double")


def contains_match(prediction: Column | str, truth: Column | str) -> Column:
    return (_both(prediction, truth) & F.contains(normalize_answer(prediction), normalize_answer(truth))).cast("double")


def numeric_match(prediction: Column | str, truth: Column | str) -> Column:
    """Within 5% of the truth; a zero needs a zero (M8)."""
    p, t = numeric_value(prediction), numeric_value(truth)
    near = F.when(t != 0, F.abs(p - t) / F.abs(t) < 0.05).otherwise(p == 0)
    return (_both(prediction, truth) & F.coalesce(near, F.lit(False))).cast("double")


def _both(a: Column | str, b: Column | str) -> Column:
    return (F.length(text(a)) > 0) & (F.length(text(b)) > 0)


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def numeric_literals(c: Column | str) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, _plain)


def _plain(token: Column) -> Column:
    """A number without $, commas and %; in parentheses it is negative."""
    bare = F.regexp_replace(token, r"[$,%()\s+]", "").try_cast("double")
    return F.when(token.rlike(r"^\s*\(.*\)\s*$"), -bare).otherwise(bare)


def _no_year(v: Column) -> Column:
    return ~((v == F.floor(v)) & F.abs(v).between(1900, 2100))


def largest_non_year(c: Column | str) -> Column:
    """The number largest by absolute value that is no year, the first of equals (M4)."""
    kept = F.filter(numeric_literals(c), _no_year)
    return F.aggregate(kept, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull() | (F.abs(v) > F.abs(a)), v).otherwise(a))


def primary_number(c: Column | str) -> Column:
    """An amount after $, else the first in parentheses as a negative, else the first that is no year (M3)."""
    t = text(c)
    money = F.get(F.regexp_extract_all(t, F.lit(r"\$\s*\(?\d[\d,]*(?:\.\d+)?"), F.lit(0)), F.lit(0))
    wrapped = F.get(F.regexp_extract_all(t, F.lit(r"\(\s*\d[\d,]*(?:\.\d+)?\s*\)"), F.lit(0)), F.lit(0))
    return F.coalesce(_plain(money), _plain(wrapped), F.get(F.filter(numeric_literals(c), _no_year), F.lit(0)))


def scaled_numbers(c: Column | str) -> Column:
    """Every number with its scale word applied, and its absolute value, rounded to six places, each once (M6).

    A bare m, b or k scales only after a currency sign, or a number of 100 or more or with a point or comma.
    """
    pattern = r"(?i)\(?\s*[$€£]?\s*[-+]?\d[\d,]*(?:\.\d+)?\s*(?:billion|million|thousand|bn|mn|mm|b|m|k)?\s*\)?"

    def one(m: Column) -> Column:
        low = F.lower(m)
        token = F.regexp_extract(low, r"[-+]?\d[\d,]*(?:\.\d+)?", 0)
        v = F.replace(token, F.lit(","), F.lit("")).try_cast("double")
        v = F.when(low.rlike(r"^\s*\(.*\)\s*$"), -F.abs(v)).otherwise(v)
        suffix = F.regexp_extract(low, r"(billion|million|thousand|bn|mn|mm|b|m|k)\s*\)?\s*$", 1)
        bare = suffix.isin("m", "b", "k") & ~low.rlike("[$€£]") & ~token.rlike("[.,]") & (F.abs(v) < 100)
        factor = F.when(bare, 1.0).when(suffix.isin("billion", "bn", "b"), 1e9).when(suffix.isin("million", "mn", "mm", "m"), 1e6).when(suffix.isin("thousand", "k"), 1e3).otherwise(1.0)
        return F.round(v * factor, 6)

    found = F.transform(F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0)), one)
    return F.array_distinct(F.flatten(F.transform(found, lambda v: F.array(v, F.abs(v)))))


def value_grounded(value: Column | str, span: Column | str) -> Column:
    """Whether a span states a value (M7): either holds the other, numbers within a ten-thousandth, else 35% of words."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))
    v, s = norm(value), norm(span)
    a, b = scaled_numbers(v), scaled_numbers(s)
    near = F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= F.greatest(F.lit(1e-6), F.abs(y) * 1e-4)))
    words, held = (F.regexp_extract_all(x, F.lit("[a-z0-9]{4,}"), F.lit(0)) for x in (v, s))
    shared = F.size(F.filter(words, lambda w: F.array_contains(held, w)))
    enough = (F.size(words) > 0) & (F.size(held) > 0) & (shared >= F.greatest(F.lit(1), F.floor(F.size(words) * 0.35)))
    return (F.length(v) > 0) & (F.length(s) > 0) & (F.contains(s, v) | F.contains(v, s) | F.when(F.size(a) > 0, near).otherwise(enough))


def significant(v: Column, digits: int = 12) -> Column:
    """A number to so many significant digits, without trailing zeros; with an exponent below 1e-4 and from 10**digits on."""
    places = F.floor(F.log10(F.abs(v)))
    shown = F.format_string(f"%.{digits - 1}e", v)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")
    far = F.concat(bare(F.split_part(shown, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(shown, F.lit("e"), F.lit(2)))
    near = bare(shown.cast("decimal(38,18)").cast("string"))
    return F.when(v == 0, "0").when((places >= digits) | (places < -4), far).otherwise(near)


def conflict_key(value: Column | str) -> Column:
    """num: with the number largest by absolute value, else txt: with the text; empty for an empty one."""
    plain = F.trim(F.regexp_replace(F.lower(text(value)), r"\s+", " "))
    numbers = scaled_numbers(plain)
    most = F.aggregate(numbers, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull() | (F.abs(v) > F.abs(a)), v).otherwise(a))
    # as a variable, the number is worked out once for all that its digits are taken from
    told = F.get(F.transform(F.array(most), lambda v: F.when(v.isNotNull(), F.concat(F.lit("num:"), significant(v)))), F.lit(0))
    return F.when(F.length(plain) == 0, "").otherwise(F.coalesce(told, F.concat(F.lit("txt:"), plain)))


def formatted(v: Column) -> Column:
    """A whole number as such, else at most eight decimals without trailing zeros."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.8f", v), r"\.?0+$", ""))


def positive_amount(c: Column | str) -> Column:
    """The first (n), else the first - n, without its sign."""
    t = text(c)
    wrapped, minus = r"(?s)^(.*?)\(\s*(\d[\d,]*(?:\.\d+)?)\s*\)", r"(?s)^(|.*?\s)-\s*(\d[\d,]*(?:\.\d+)?)"
    return F.when(t.rlike(wrapped), F.regexp_replace(t, wrapped, "$1$2")).otherwise(F.regexp_replace(t, minus, "$1$2"))
