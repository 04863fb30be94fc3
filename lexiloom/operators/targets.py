"""Record targets: alias resolution by key presence, legacy names, upserts, explode and re-nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import rstrip
from ..sources.records import text_variant

#: The first key that is present wins, even if null.
BASE = ("base", "student", "seg")
HUMAN = ("human", "human_reference", "seg")
COMPARED = ("corrected", "base", "student", "human", "human_reference", "seg")
LEGACY = ("student", "human_reference", "seg")


def by_presence(target: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(target, key), text_variant(target, key)).otherwise(out)
    return out


def present(target: Column, keys: tuple[str, ...]) -> Column:
    """The key that by_presence reads, null if none."""
    return F.coalesce(*[F.when(F.map_contains_key(target, k), F.lit(k)) for k in keys])


def explode_targets(records: DataFrame) -> DataFrame:
    """(line, pos, language, base, human, corrected, target). base loses trailing white space, human keeps it."""
    t = F.col("t")
    rows = records.select("line", F.posexplode("tgts").alias("pos", "t"))
    return rows.select("line", "pos", text_variant(t, "language").alias("language"), rstrip(by_presence(t, BASE)).alias("base"), by_presence(t, HUMAN).alias("human"), text_variant(t, "corrected").alias("corrected"), t.alias("target"))


def upgrade_legacy(target: Column) -> Column:
    """The present form of a target: base is what the first present name of base has, without trailing white space; human stays, or takes the value
    of human_reference; student, human_reference and seg go, all other fields stay."""
    rest = F.map_filter(target, lambda k, v: ~k.isin(*LEGACY, "base", "human"))
    old = F.when(F.map_contains_key(target, "human"), target["human"]).when(F.map_contains_key(target, "human_reference"), target["human_reference"])
    told = F.map_contains_key(target, "human") | F.map_contains_key(target, "human_reference")
    base = F.create_map(F.lit("base"), _boxed(rstrip(by_presence(target, BASE))))
    human = F.when(told, F.create_map(F.lit("human"), old)).otherwise(F.map_filter(target, lambda k, v: F.lit(False)))
    return F.map_concat(rest, base, human)


def upsert(tgts: Column, language: str, key: str, value: Column) -> Column:
    """Set a field of the target of a language; add that target where it is missing."""
    boxed = _boxed(value)
    is_it = lambda t: F.coalesce(text_variant(t, "language") == language, F.lit(False))
    new = F.create_map(F.lit("language"), F.lit(language).cast("variant"), F.lit(key), boxed)
    return F.when(F.exists(tgts, is_it), F.transform(tgts, lambda t: F.when(is_it(t), set_field(t, key, value)).otherwise(t))).otherwise(F.concat(tgts, F.array(new)))


def set_field(target: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(target, lambda k, v: k != key), F.create_map(F.lit(key), _boxed(value)))


def _boxed(value: Column) -> Column:
    """A JSON null for null, so that the key stays present."""
    return F.when(value.isNull(), F.parse_json(F.lit("null"))).otherwise(value.cast("variant"))


def join_targets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Targets of the two sides by line and language, in any order: exploded rows (line, language, columns prefixed l_ and r_); pairs only."""
    side = lambda df, p: df.select("line", "language", *[F.col(c).alias(p + c) for c in df.columns if c not in ("line", "language")])
    return side(left, "l_").join(side(right, "r_"), ["line", "language"])


def target_of(tgts: Column, language: str | None) -> Column:
    """The target of a language, or without one the first; null if there is none. At most one is checked by validate.one_target_rules."""
    return F.get(tgts if language is None else F.filter(tgts, lambda t: F.coalesce(text_variant(t, "language") == language, F.lit(False))), 0)


def language_set(tgts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tgts, lambda t: text_variant(t, "language"))))
