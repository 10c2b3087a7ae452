"""Scalar expressions, all inside whole-stage code unless said otherwise."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Separators of tag cells, by priority (fixed values of the input format).
TAG_SEPARATORS = [";", "；", ",", "，", "|"]


def clamp01(x: Column, default: float = 0.0) -> Column:
    """x as a number in [0, 1]; what isn't a number gives ``default``; NaN gives 1."""
    v = F.expr("NULL").cast("double") if x is None else x.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(float(default)))))


def rounded(x: Column, digits: int = 6) -> Column:
    """x, shifted by its digits, to the nearest whole number and back; so a
    quotient that lies a last bit under a half, as 137058.3 / 200000 does under
    0.6852915, is rounded up as the half is."""
    by = F.lit(float(10**digits))
    return F.round(x * by) / by


def safe_float(x: Column, default: float) -> Column:
    v = F.trim(x.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(float(default)))


def filled(x: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    t = F.trim(x.cast("string"))
    return F.when(t != "", t)


def first_filled(cols: list[Column], default: str) -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def split_tags(x: Column) -> Column:
    """Parts of a tag cell by the first separator, in order of priority, that
    it holds; blank parts go; an empty cell is ``uncertain``."""
    t = F.coalesce(F.trim(x), F.lit(""))
    parts = F.array(t)
    for s in reversed(TAG_SEPARATORS):
        parts = F.when(F.contains(t, F.lit(s)), F.split(t, re.escape(s))).otherwise(parts)
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("uncertain")))


def split_set(x: Column) -> Column:
    """Distinct parts by any separator; a text that starts with ``[`` is JSON."""
    t = F.coalesce(F.trim(x), F.lit(""))
    plain = F.split(t, "[;；,，|]")
    listed = F.from_json(t, "array<string>")
    parts = F.when(t.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(plain)
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def safe_filename(x: Column) -> Column:
    return F.translate(x, ":/\\ ", "____")


def variable_key(variable: Column, fuzzy_set: Column) -> Column:
    return F.concat_ws(".", variable, fuzzy_set)


def observation_key(standard: Column, feature: Column, value: Column) -> Column:
    return F.when(F.coalesce(standard, F.lit("")) != "", standard).otherwise(F.concat_ws(":", feature, value))


def trapezoid(x: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Membership of x in the trapezoid a <= b <= c <= d; vertical sides count
    as inside at their foot."""
    return F.when((x < a) | (x > d), 0.0).when((x >= b) & (x <= c), 1.0).when(
        x < b, (x - a) / F.nullif(b - a, F.lit(0.0))
    ).otherwise((d - x) / F.nullif(d - c, F.lit(0.0)))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form, which the engine lacks; use it on distinct values."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_item(x: Column) -> Column:
    """``left:right`` of an item in normal form, trimmed, lower-cased, white
    space collapsed; an item without colon is itself."""
    t = F.trim(F.regexp_replace(nfkc(x), "(?U)\\s+", " "))
    at = F.instr(t, ":")
    left, right = F.lower(F.trim(F.substring(t, F.lit(1), at - 1))), F.lower(F.trim(F.substr(t, at + 1)))
    return F.when(at > 0, F.concat(left, F.lit(":"), right)).otherwise(F.lower(t))


def _loads(text: str):
    for candidate in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def _outer_objects(text: str):
    decoder, at = json.JSONDecoder(), text.find("{")
    tidy = re.sub(r",\s*([}\]])", r"\1", text)
    at = tidy.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(tidy, at)
            yield value
        except ValueError:
            end = at + 1
        at = tidy.find("{", end)


def recover_payload(text: str | None) -> str | None:
    """The observations of a model's answer as a JSON list, or null. Thinking
    blocks and fences go; trailing commas are forgiven; a bare list or the
    first object found counts, its list under one of several names."""
    clean = re.sub(r"(?is)<think>.*?</think>", "", text or "")
    fenced = re.findall(r"(?s)```(?:\w+)?\s*(.*?)```", clean)
    body = re.sub(r"```(?:\w+)?", "", clean).strip()
    for value in (v for v in [_loads(body), *map(_loads, fenced), *_outer_objects(body)] if v is not None):
        if isinstance(value, list):
            return json.dumps(value, ensure_ascii=False)
        if isinstance(value, dict):
            #: Names of the list (fixed values of the answer format).
            for name in ("observations", "observation", "items", "data", "results"):
                if isinstance(value.get(name), list):
                    return json.dumps(value[name], ensure_ascii=False)
            return "[]"
    return None


@F.pandas_udf(StringType())
def recover_payload_udf(s: pd.Series) -> pd.Series:
    return s.map(recover_payload)
