"""Scores of single rows: signals, proofs, oracles, severity vectors and redaction, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone import catalogs as C


def any_matches(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def is_concrete(proof: Column) -> Column:
    """Whether a proof shows a concrete sign and no stand-in; false for null and blank."""
    text = F.coalesce(proof, F.lit(""))
    return (F.trim(text) != "") & ~any_matches(text, C.PLACEHOLDER_SIGNS) & any_matches(text, C.CONCRETE_SIGNS)


def demonstrates(payload: Column, cwe: Column) -> Column:
    """Whether a payload demonstrates a weakness class; null for classes that can't be judged."""
    p = F.trim(F.coalesce(payload, F.lit("")))
    sql = p.rlike(C.SQL_TAUTOLOGY) | p.rlike(C.SQL_STACKED) | p.rlike(C.SQL_UNION) | p.rlike(C.SQL_COMMENT) & p.rlike(C.SQL_BREAKOUT)
    host = F.regexp_extract(p, C.URL_HOST, 1)
    judged = (
        F.when(cwe == 89, sql)
        .when(cwe == 78, p.rlike(C.SHELL_META) & p.rlike(C.SHELL_VERB))
        .when(cwe == 22, p.rlike(C.PATH_TARGET) | (F.regexp_count(p, F.lit(C.PATH_HOP)) >= 2))
        .when(cwe == 918, (host != "") & host.rlike(C.INTERNAL_HOST))
        .when(cwe == 79, p.rlike(C.SCRIPT_VECTOR))
        .when(cwe == 95, p.rlike(C.CODE_TOKENS))
    )
    return F.when(p == "", F.lit(False)).otherwise(judged)


def _weight(table: dict[str, float], c: Column) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[c]


def cvss(cwe: Column, has_route: Column, authenticated: Column, interaction: Column) -> tuple[Column, Column]:
    """(vector, score) of CVSS 3.1 from the defaults of a class and its context; unknown classes get C:L/I:L/A:N."""
    names = ("av", "ui", "s", "c", "i", "a")
    fallback = ("N", "N", "U", "L", "L", "N")
    defaults = F.create_map(*(x for row in C.CVSS_DEFAULTS for x in (F.lit(row[0]), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row[1:]))))))
    base = F.coalesce(defaults[cwe], F.struct(*(F.lit(v).alias(n) for n, v in zip(names, fallback))))
    av = F.when(has_route, "N").when(base["av"] != "N", base["av"]).otherwise("L")
    pr = F.when(authenticated, "L").otherwise("N")
    ui = F.when(interaction, "R").otherwise(base["ui"])
    scope, c, i, a = base["s"], base["c"], base["i"], base["a"]
    vector = F.concat(F.lit("CVSS:3.1/AV:"), av, F.lit("/AC:L/PR:"), pr, F.lit("/UI:"), ui, F.lit("/S:"), scope, F.lit("/C:"), c, F.lit("/I:"), i, F.lit("/A:"), a)
    loss = 1 - (1 - _weight(C.CVSS_CIA, c)) * (1 - _weight(C.CVSS_CIA, i)) * (1 - _weight(C.CVSS_CIA, a))
    impact = F.when(scope == "C", 7.52 * (loss - 0.029) - 3.25 * F.pow(loss - 0.02, F.lit(15))).otherwise(6.42 * loss)
    pr_weight = F.when(scope == "C", _weight(C.CVSS_PR_CHANGED, pr)).otherwise(_weight(C.CVSS_PR_UNCHANGED, pr))
    ease = 8.22 * _weight(C.CVSS_AV, av) * F.lit(C.CVSS_AC["L"]) * pr_weight * _weight(C.CVSS_UI, ui)
    raw = F.least(F.when(scope == "C", 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    return vector, F.when(impact <= 0, F.lit(0.0)).otherwise(F.ceil(raw * 10) / 10)


def redacted(text: Column) -> Column:
    """Text with secret shapes, bearer tokens, passwords in addresses and assigned secrets masked, in that order."""
    out = text
    for p in C.REDACTED_SHAPES:
        out = F.regexp_replace(out, p, C.MASK)
    out = F.regexp_replace(out, C.REDACTED_BEARER, "$1" + C.MASK)
    out = F.regexp_replace(out, C.REDACTED_URL, "$1" + C.MASK + "@")
    return F.regexp_replace(out, C.REDACTED_ASSIGNMENT, "$1$2$3" + C.MASK + "$5")


def grounded(text: Column, cwe: Column) -> Column:
    """Whether text near a place shows a sign of the weakness class; null for classes without signs."""
    classes = sorted({c for c, _ in C.CLASS_SIGNS})
    return reduce(lambda chain, c: chain.when(cwe == c, any_matches(F.coalesce(text, F.lit("")), [p for k, p in C.CLASS_SIGNS if k == c])), classes, F)


def redacted_nested(value: Column, kind: T.DataType) -> Column:
    """A value of any type with all text inside it redacted; names of fields and keys of maps stay."""
    if isinstance(kind, T.StringType):
        return redacted(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redacted_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redacted_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value
