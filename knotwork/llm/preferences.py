"""Preference formatting (op 2).

A chosen and a rejected conversation share their first turns; that longest common prefix of turns is
rendered once as the prompt, and what follows in either becomes a completion with a mask that trains on
the assistant's words only. All built-in array functions; conversations are gathered by id, never by prompt,
so that one first turn that very many conversations share is no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chat layout.
HEAD, TAIL, SPEAKER = "<|{role}|>\n", "<|end|>\n", "assistant"


def gather_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) from rows (conv_id, turn, role, text), in order of turn, then role and text; null roles and texts count as empty, rows without conv_id go."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn lists."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.slice(a, F.lit(1), n), lambda t, i: F.when(t == F.get(b, i), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    return F.when(F.size(differ) > 0, F.get(differ, F.lit(0))).otherwise(n)


def render(turns: Column) -> Column:
    before, after = HEAD.split("{role}")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """array<struct<start, end>>: code points of the rendered turns to train on, the assistant's texts with their end marks."""
    before, after = HEAD.split("{role}")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["role"]) + len(before) + len(after)
        end = start + F.length(t["text"]) + len(TAIL)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == SPEAKER, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda a: a["out"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with prompt_turns, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask.

    pairs holds chosen and rejected as array<struct<role, text>>; its other columns stay, but for those of the six
    names, which are replaced. Equal conversations have empty completions; a null conversation counts as one without turns.
    An empty table gives an empty one.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    c, r = F.coalesce("chosen", none), F.coalesce("rejected", none)
    rows = pairs.withColumns({"chosen": c, "rejected": r}).withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.size(x))
    return rows.withColumns(
        {"prompt": render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))), "chosen_text": render(rest("chosen")), "rejected_text": render(rest("rejected")), "chosen_mask": mask(rest("chosen")), "rejected_mask": mask(rest("rejected"))}
    )


def last_answer(turns: Column) -> Column:
    """Number from 1 of the speaker's last turn; of the last turn if there is none."""
    own = F.transform(turns, lambda t, i: F.when(t["role"] == SPEAKER, i + 1))
    return F.coalesce(F.array_max(own), F.size(turns))


def paired_with_other_answers(turns: DataFrame) -> DataFrame:
    """(pair_id, other_id, chosen, rejected): each conversation as chosen, and with another's last answer in the place of its own as rejected.

    The other one is that of conversations 2n and 2n + 1; where it is missing, other_id is null and the answer is empty. What
    follows the last answer is no part of rejected. A row for each conversation.
    """
    convs = gather_turns(turns).withColumn("at", last_answer(F.col("turns")))
    answers = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("conv_id").alias("other_id"), F.get("turns", F.col("at") - 1)["text"].alias("answer"))
    other = F.array(F.struct(F.lit(SPEAKER).alias("role"), F.coalesce("answer", F.lit("")).alias("text")))
    return convs.join(answers, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), "other_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), other).alias("rejected"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """(pair_id, other_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of turns (conv_id, turn, role, text, ...); masks as start:end, comma-joined. Repeated turns all stay; an empty table gives none."""
    rows = format_pairs(paired_with_other_answers(turns))
    spans = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("pair_id", "other_id", F.col("prompt_turns").cast("int").alias("prompt_turns"), "prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))
