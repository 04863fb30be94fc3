"""Validation as data: rows (line, code, message), of which the smallest line is raised on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip
from ..sources.records import text_variant

#: Fixed values.
CATEGORIES = ("meaning", "omission", "addition", "terminology", "grammar", "naturalness", "formatting")


class ValidationError(ValueError):
    pass


Rules = dict[str, tuple[Column, str]]


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """rules: code -> (predicate that holds for a bad row, message), in order of precedence. (line, rank, code, message), found in one pass.

    Null predicates count as not held."""
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"), F.lit(text).alias("message"))) for i, (code, (bad, text)) in enumerate(rules.items())]
    return df.select("line", F.explode(F.array_compact(F.array(*marks))).alias("v")).select("line", "v.*")


def raise_first(found: DataFrame, where: str = "input") -> None:
    """Raise for the smallest line, and of its violations for the first rule."""
    first = found.agg(F.min(F.struct("line", "rank", "message")).alias("x")).first().x
    if first is not None:
        raise ValidationError(f"{where} line {first.line}: {first.message}")


def checked(df: DataFrame, rules: Rules, where: str = "input") -> DataFrame:
    """df, once none of its rows breaks a rule."""
    raise_first(violations(df, rules), where)
    return df


def not_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValidationError(message)
    return df


def object_rules() -> Rules:
    """Of parsed lines: each holds a JSON object."""
    return {"malformed": (F.col("form") == "malformed", "invalid JSON"), "not_object": (F.col("form") == "other", "expected a JSON object")}


def record_rules() -> Rules:
    """Of records whose targets are objects with a language each."""
    no_language = F.exists("tgts", lambda t: text_variant(t, "language").isNull())
    names = F.transform("tgts", lambda t: text_variant(t, "language"))
    return object_rules() | {
        "language": (F.col("language").isNull(), "language must be a string"),
        "seg": (is_blank(F.col("seg")), "missing or empty seg"),
        "tgts": (F.coalesce(F.size("tgts"), F.lit(0)) <= 0, "missing or empty tgts"),
        "target_language": (no_language, "every target needs a language"),
        "duplicate_language": (F.size(F.array_distinct(names)) < F.size(names), "duplicate target language"),
        "duplicate_key": (F.exists("tgts", lambda t: F.size(F.array_distinct(F.map_keys(t))) < F.size(F.map_keys(t))), "duplicate key in a target"),
    }


def _told(t: Column, keys: tuple[str, ...]) -> Column:
    """Whether one of the keys stands in a target."""
    return F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(t, k))


def base_rules() -> Rules:
    """A target's base (or its older names) is text that is not blank, or a null under the name base."""
    from .targets import BASE, by_presence

    bad = lambda t: is_blank(by_presence(t, BASE)) & ~(F.map_contains_key(t, "base") & (F.schema_of_variant(t["base"]) == "VOID"))
    return {"base": (F.exists("tgts", bad), "expected nonempty target base (or legacy seg)")}


def human_rules() -> Rules:
    from .targets import HUMAN, by_presence

    return {"human": (F.exists("tgts", lambda t: is_blank(by_presence(t, HUMAN))), "expected nonempty target human (or legacy seg)")}


def compared_rules() -> Rules:
    """Every target has a text (an empty one too) under the first name that is present."""
    from .targets import COMPARED, by_presence

    return {"text": (F.exists("tgts", lambda t: by_presence(t, COMPARED).isNull()), "invalid translation language or text")}


def embedded_rules() -> Rules:
    """Where one target of a record has an embedded human reference, all have one, and none is blank."""
    from .targets import by_presence

    keys = ("human", "human_reference")
    blank = lambda t: is_blank(by_presence(t, keys))
    return {"embedded": (F.exists("tgts", lambda t: _told(t, keys)) & F.exists("tgts", blank), "missing or empty embedded human reference")}


def one_target_rules(language: str | None) -> Rules:
    """At most one target of the language (of any, if none is given)."""
    own = F.filter("tgts", lambda t: F.lit(True) if language is None else F.coalesce(text_variant(t, "language") == language, F.lit(False)))
    return {"ambiguous": (F.size(own) > 1, "multiple matching targets; name a target language or remove duplicate targets")}


def tsv_rules(columns: list[str]) -> Rules:
    return {"arity": (~F.col("well_formed"), f"expected exactly {len(columns)} TAB-separated fields")} | {
        f"blank_{c}": (F.col("well_formed") & is_blank(F.col(c)), f"blank {c}") for c in columns
    } | {f"replacement_{c}": (F.contains(F.col(c), F.lit("\ufffd")), f"U+FFFD in {c}") for c in columns}


def first_reason(*chain: tuple[str, Column]) -> Column:
    """The first reason whose predicate holds; null if none."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in chain])


def edits_agree(original: Column, corrected: Column, edits: Column) -> Column:
    """Whether each edit has a known category, a reason, a change and spans that occur in their texts, and there are edits if and only if the text changed.

    Without edits, a difference of white space at the ends is none."""
    ok = F.forall(edits, lambda e: e["category"].isin(*CATEGORIES) & ~is_blank(e["reason"]) & (e["before"] != e["after"]) & F.contains(original, e["before"]) & F.contains(corrected, e["after"]))
    changed = F.when(F.size(edits) == 0, strip(original) != strip(corrected)).otherwise(original != corrected)
    return F.coalesce(~is_blank(corrected) & ok & (changed == (F.size(edits) > 0)), F.lit(False))
