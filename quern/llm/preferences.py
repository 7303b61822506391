"""Preference pairs: one prompt and two masked completions.

The prompt is the longest common prefix of turns of a chosen and a rejected
conversation (same role and text, nulls equal to nulls), rendered once. The rest
of each is its completion; its mask lists the spans of characters (start:end,
end exclusive) that train: what the assistant says, with its end mark.

Only DataFrame expressions are used. A null role counts as ``user``, a null text
as empty, a null conversation as one without turns; a turn without a
conversation id is a conversation of its own. Marks of the format inside a text
or role are broken by a blank, and so are line ends in a role. Turns are ordered
by number, then role and text, so repeated numbers have one order, and repeated
rows are turns of their own. A conversation, however long its texts, is one row,
as its pair has to be. An empty table gives no rows. Further columns of pairs
are carried through, but for those named as the results, which are replaced;
further columns of turns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import folds

RESULTS = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
TURNS = "array<struct<role:string,text:string>>"


def gather_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation as an array of (role, text) in order."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_col).alias("conv_id"), own.alias("own"), row.alias("row"))
    got = rows.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    return got.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def head(turn: Column) -> Column:
    role = F.replace(F.replace(F.coalesce(turn["role"], F.lit("user")), F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x), body(x))), "")


def trained_spans(turns: Column) -> Column:
    before = folds.running(F.transform(turns, lambda x: F.length(head(x)) + F.length(body(x))), F.lit(0), lambda a, b: a + b)

    def span(x: Column, at: Column) -> Column:
        begin = at + F.length(head(x))
        return F.when(x["role"] == "assistant", F.concat_ws(":", begin.cast("string"), (begin + F.length(body(x))).cast("string")))

    return F.array_join(F.zip_with(turns, before, span), ",")


def preference_pairs(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """The other columns of ``pairs``, and ``n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``."""
    none = F.array().cast(TURNS)
    a, b = F.coalesce(F.col(chosen_col), none), F.coalesce(F.col(rejected_col), none)
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    miss = F.array_position(same, F.lit(False))
    shared = F.when(miss > 0, miss - 1).otherwise(F.size(same)).cast("int")
    rest = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen_col, rejected_col, *RESULTS)]
    cut = pairs.select(*rest, a.alias("__a"), b.alias("__b"), shared.alias("n_prompt_turns"))
    left = cut.select(
        *rest, "n_prompt_turns", F.slice("__a", F.lit(1), F.col("n_prompt_turns")).alias("__p"),
        F.slice("__a", F.col("n_prompt_turns") + 1, F.greatest(F.size("__a"), F.lit(1))).alias("__a"),
        F.slice("__b", F.col("n_prompt_turns") + 1, F.greatest(F.size("__b"), F.lit(1))).alias("__b"),
    )
    return left.select(
        *rest, "n_prompt_turns", render(F.col("__p")).alias("prompt"), render(F.col("__a")).alias("chosen"), render(F.col("__b")).alias("rejected"),
        trained_spans(F.col("__a")).alias("chosen_mask"), trained_spans(F.col("__b")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected``: each conversation, and the same with its last turn taken from the next id's.

    A conversation that no next id follows is rejected without its last turn.
    """
    reply = conversations.select((F.col("conv_id") - 1).alias("conv_id"), F.array(F.element_at("turns", -1)).alias("reply"))
    reply = reply.where(F.col("conv_id").isNotNull())
    start = F.slice("turns", F.lit(1), F.size("turns") - 1)
    both = conversations.join(reply, "conv_id", "left")
    return both.select("conv_id", F.col("turns").alias("chosen"), F.concat(start, F.coalesce("reply", F.array().cast(TURNS))).alias("rejected"))
