"""Preference formatting: shared turns as the prompt, two masked completions; DataFrame functions only.

`format_preferences` takes one row a pair with the turns of the chosen and of the
rejected conversation. The longest common prefix of turns (same role and text) is
rendered once as the prompt; what follows in each is its completion. A mask is the
list of spans [start, end), in code points of the completion, on which a loss is
taken: the texts of assistant turns and their end marks. All else is masked out.

`pair_conversations` derives pairs from a table of turns. Conversations with one
opening (equal first turns) are siblings: the one with the most turns, then the
largest conv_id, is chosen, and every other one is rejected against it, so a group
of n gives n - 1 pairs. A conversation without siblings is chosen against itself
with its last assistant turn replaced by its first assistant turn, where these
differ. What can't be paired that way is returned with null prompt and completions.

Hot openings: only (conv_id, opening) meet the groups' choices by opening, and as the
choices are a written table, Spark sends it out where it is small and splits a hot
opening's rows where it isn't. Turns move by conv_id alone; a group's chosen conversation
is dealt to its siblings by salts, `rows_per_salt` siblings to a copy.

Marks inside texts are escaped, so a text can't forge a turn. Null texts and roles
read as empty; a null turn sorts first; turns are ordered by (turn, role, text), so
repeated rows stay as repeated turns. Rows with a null conv_id belong to no
conversation and are left out. Further columns are not looked at. An empty table gives no
rows; a conversation without siblings and without two different replies is a row with null
prompt and completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import scratch

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def _escaped(x: Column) -> Column:
    return F.replace(x, F.lit(OPEN), F.lit("<\\|"))


def render(turns: Column) -> Column:
    """Turns as text: a role mark, the text and an end mark each."""
    one = lambda t: F.concat(F.lit(OPEN), _escaped(t["role"]), F.lit(CLOSE + "\n"), _escaped(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column) -> Column:
    """Spans of assistant texts and their end marks in render(turns)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_escaped(t["role"])) + len(OPEN + CLOSE + "\n")
        end = start + F.length(_escaped(t["text"])) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def format_preferences(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """`pairs` with shared_turns, prompt, chosen, chosen_mask, rejected and rejected_mask for the two arrays of turns."""
    a, b, n = F.col(chosen), F.col(rejected), F.col("shared_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    out = pairs.withColumn("shared_turns", F.when(a.isNotNull() & b.isNotNull(), common_turns(a, b)))
    out = out.withColumns({"prompt": F.when(n.isNotNull(), render(F.slice(a, F.lit(1), n))), "a_rest": F.when(n.isNotNull(), rest(a)), "b_rest": F.when(n.isNotNull(), rest(b))})
    return out.withColumns({"chosen": render(F.col("a_rest")), "chosen_mask": mask(F.col("a_rest")), "rejected": render(F.col("b_rest")), "rejected_mask": mask(F.col("b_rest"))}).drop("a_rest", "b_rest", chosen, rejected)


def pair_conversations(turns: DataFrame, rows_per_salt: int = 500) -> DataFrame:
    """chosen_id, rejected_id, source, chosen_turns and rejected_turns from a table (conv_id, turn, role, text, ...)."""
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    talks = talks.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    # a conversation's first turn by itself: the whole conversation doesn't move by its opening
    opening = clean.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("o"), F.count("*").alias("k"))
    opening = opening.select("conv_id", "k", F.sha2(F.concat_ws("\n", "o.role", "o.text"), 256).alias("opening"))
    groups = opening.groupBy("opening").agg(F.count("*").alias("n"), F.max(F.struct("k", "conv_id"))["conv_id"].alias("best")).where("n > 1")
    groups = scratch.table(groups.select("opening", "best", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts")), "chat-groups")
    marked = talks.join(opening.join(groups, "opening", "left").select("conv_id", "best", "salts"), "conv_id")
    siblings = marked.where("best is not null and conv_id <> best").withColumn("salt", F.pmod(F.xxhash64("conv_id"), "salts").cast("int"))
    best = groups.join(talks.select("conv_id", "turns"), F.col("best") == F.col("conv_id")).select("best", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("turns").alias("chosen_turns"))
    by_group = siblings.join(best, ["best", "salt"]).select(F.col("best").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.lit("sibling").alias("source"), "chosen_turns", F.col("turns").alias("rejected_turns"))
    roles = F.transform("turns", lambda t: t["role"] == "assistant")
    first, last = F.array_position(roles, F.lit(True)), F.size("turns") + 1 - F.array_position(F.reverse(roles), F.lit(True))
    alone = marked.where("best is null").withColumns({"first": F.when(F.exists("turns", lambda t: t["role"] == "assistant"), first.cast("int")), "last": last.cast("int")})
    reply, final = F.element_at("turns", F.col("first")), F.element_at("turns", F.col("last"))
    fit = F.col("first").isNotNull() & (F.col("first") < F.col("last")) & (reply["text"] != final["text"])
    upto = F.slice("turns", F.lit(1), F.col("last"))
    worse = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(reply))
    by_self = alone.select(F.col("conv_id").alias("chosen_id"), F.when(fit, F.col("conv_id")).alias("rejected_id"), F.when(fit, F.lit("earlier reply")).otherwise(F.lit("unpaired")).alias("source"), F.when(fit, upto).alias("chosen_turns"), F.when(fit, worse).alias("rejected_turns"))
    return by_group.unionByName(by_self)


def preference_pairs(turns: DataFrame, rows_per_salt: int = 500) -> DataFrame:
    """Pairs of a table of turns, formatted; masks as text "start-end,start-end"."""
    out = format_preferences(pair_conversations(turns, rows_per_salt))
    said = lambda m: F.array_join(F.transform(m, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.withColumns({"chosen_mask": said(F.col("chosen_mask")), "rejected_mask": said(F.col("rejected_mask"))})
