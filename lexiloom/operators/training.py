"""Training tables: supervised rows, preference rows, padding, exclusions. Tokenizers are plug-ins: Column -> Column of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank, rstrip
from .validate import first_reason

IGNORED, TURN_END = -100, 9


def code_points(text: Column) -> Column:
    """Stand-in tokenizer."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def prompt_ids(text: Column, tokenize=code_points) -> Column:
    return F.concat(F.array(F.lit(1), F.lit(2)), tokenize(text))


def completion_ids(text: Column, tokenize=code_points) -> Column:
    return F.concat(tokenize(rstrip(text)), F.array(F.lit(TURN_END)))


def with_reason(rows: DataFrame, source: str, answers: list[str], max_length: int, tokenize=code_points) -> DataFrame:
    """Add reason: missing_or_empty_field, then max_length (prompt and turn end count), then identical_preferences; null for rows that stay."""
    too_long = [F.size(prompt_ids(F.col(source), tokenize)) + F.size(completion_ids(F.col(a), tokenize)) > max_length for a in answers]
    blank, over = is_blank(F.col(source)), F.lit(False)
    for a, long in zip(answers, too_long):
        blank, over = blank | is_blank(F.col(a)), over | long
    same = completion_ids(F.col(answers[0]), tokenize) == completion_ids(F.col(answers[1]), tokenize) if len(answers) == 2 else F.lit(False)
    return rows.withColumn("reason", first_reason(("missing_or_empty_field", blank), ("max_length", over), ("identical_preferences", same)))


def masked(prefix: Column, end: Column) -> dict[str, Column]:
    ids = F.concat(prefix, end)
    return {"input_ids": ids, "attention_mask": F.array_repeat(F.lit(1), F.size(ids)), "labels": F.concat(F.array_repeat(F.lit(IGNORED), F.size(prefix)), end)}


def sft_rows(kept: DataFrame, source: str, answer: str, tokenize=code_points) -> DataFrame:
    cols = masked(prompt_ids(F.col(source), tokenize), completion_ids(F.col(answer), tokenize))
    return kept.select("line", *[c.alias(n) for n, c in cols.items()])


def preference_rows(kept: DataFrame, source: str, chosen: str, rejected: str, tokenize=code_points) -> DataFrame:
    return kept.select("line", prompt_ids(F.col(source), tokenize).alias("prompt_input_ids"), completion_ids(F.col(chosen), tokenize).alias("chosen_input_ids"), completion_ids(F.col(rejected), tokenize).alias("rejected_input_ids"))


def cpo_rows(preferences: DataFrame) -> DataFrame:
    out = [F.col("prompt_input_ids"), F.array_repeat(F.lit(1), F.size("prompt_input_ids")).alias("prompt_attention_mask")]
    for side in ("chosen", "rejected"):
        out += [c.alias(f"{side}_{n}") for n, c in masked(F.col("prompt_input_ids"), F.col(f"{side}_input_ids")).items()]
    return preferences.select("line", *out)


def stop_ids(eos: Column, turn_end: Column) -> Column:
    """The distinct ids that end an answer, without nulls, in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(eos, turn_end))))


def hit_limit(output_ids: Column, stops: Column) -> Column:
    """Whether an output has no stop token."""
    return ~F.arrays_overlap(output_ids, stops)


def padded(rows: DataFrame, batch: int, pads: dict[str, int], left: bool = False) -> DataFrame:
    """Pad arrays to the longest of their batch of consecutive lines."""
    number = F.floor((F.col("line") - 1) / batch)
    first = next(iter(pads))
    longest = F.max(F.size(first)).over(Window.partitionBy("batch"))
    rows = rows.withColumn("batch", number).withColumn("longest", longest)
    fill = lambda c, v: F.array_repeat(F.lit(v), (F.col("longest") - F.size(c)).cast("int"))
    return rows.select("line", "batch", *[(F.concat(fill(c, v), F.col(c)) if left else F.concat(F.col(c), fill(c, v))).alias(c) for c, v in pads.items()])


def experiment_columns(name: str) -> dict[str, int]:
    """`sft-X` or `{cpo,dpo}-X-Y` to 1-based columns; X and Y differ."""
    ordinal = {"human": 2, "base": 3, "corrected": 4}
    kind, *sides = name.split("-")
    if kind == "sft" and len(sides) == 1 and sides[0] in ordinal:
        return {"target": ordinal[sides[0]]}
    if kind in ("cpo", "dpo") and len(sides) == 2 and set(sides) <= set(ordinal) and sides[0] != sides[1]:
        return {"chosen": ordinal[sides[0]], "rejected": ordinal[sides[1]]}
    raise ValueError(f"unknown experiment {name!r}")
