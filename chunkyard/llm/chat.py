"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns become `<s>[INST]role[/INST]text</s>`; control strings and backslashes inside roles and texts are escaped by a
backslash and come back on reading. Prefix sums of turn tokens (runs of letters and digits, other signs, and the markup) choose the
windows: a turn starts in window floor(tokens before it / stride), where the stride is half of what the budget leaves
after history and the conversation's own opening system turn. A turn longer than the stride has a window to itself. A window after the
first repeats the system turn and the last turns of the window before it, as far as they fit `history` tokens; repeated turns are
masked, so each assistant text is a target exactly once. Turns are never cut: a window keeps to the budget as long as the system turn
leaves an eighth of it for a stride (with 1024 and 192, up to 576 tokens) and no turn is longer than two strides. A longer system
turn leaves strides of an eighth of the budget and passes it by what it is longer; a turn above two strides passes it alone in its window.

Prefix sums are taken within blocks of turn numbers first and then over blocks, so that a conversation with a large share
of all rows is not summed by one task. Turns are ordered by (turn, role, text); null turn numbers come first; null roles
and texts are empty; rows with a null conv_id form one conversation; repeated rows are turns of their own. A very long turn makes a
very long window, never a cut one. An empty table gives an empty result. Extra columns are ignored. `digests` hashes whole
conversations, so there one conversation must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)
MARKUP_TOKENS = 4
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
TURNS_IN_BLOCK = 512
ASSISTANT, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """conv_id, window (from 0, ascending), n_repeated (leading turns that are not new), n_tokens, formatted, loss (array of start from 0 and length, in code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(BEGIN + OPEN), escape(role), F.lit(CLOSE))
    rows = turns.select(
        "conv_id",
        F.floor(F.coalesce("turn", F.lit(-1)) / TURNS_IN_BLOCK).alias("block"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(TOKEN)) + F.regexp_count(role, F.lit(TOKEN)) + MARKUP_TOKENS).alias("tokens"),
    )
    # The first turn of each conversation: of its block's smallest turns by (turn, role, text).
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("f"))
    is_system = F.col("f.role") == SYSTEM
    lead_tokens = F.when(is_system, F.col("f.tokens")).otherwise(0)
    stride = F.greatest(F.lit(max(1, budget // 8)), F.floor((F.lit(budget - history) - lead_tokens) / 2)).cast("bigint")
    openings = first.select(
        F.col("conv_id").alias("_o_conv"),
        F.when(is_system, F.concat(F.lit(BEGIN + OPEN), escape(F.col("f.role")), F.lit(CLOSE), escape(F.col("f.text")), F.lit(END))).alias("lead"),
        lead_tokens.alias("lead_tokens"),
        stride.alias("stride"),
        (F.col("f.tokens") > stride).cast("int").alias("long_opening"),
    )
    strides = openings.select("_o_conv", "stride", "long_opening")
    sized = rows.join(strides, F.col("conv_id").eqNullSafe(F.col("_o_conv"))).drop("_o_conv").withColumn("is_long", (F.col("tokens") > F.col("stride")).cast("int"))
    over_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.sum("is_long").alias("is_long"))
    bases = blocks.select(
        F.col("conv_id").alias("_b_conv"),
        F.col("block").alias("_b_block"),
        F.coalesce(F.sum("tokens").over(over_blocks), F.lit(0)).alias("base"),
        F.coalesce(F.sum("is_long").over(over_blocks), F.lit(0)).alias("base_long"),
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inner = {"inner": F.coalesce(F.sum("tokens").over(in_block), F.lit(0)), "inner_long": F.coalesce(F.sum("is_long").over(in_block), F.lit(0))}
    summed = sized.withColumns(inner).join(bases, F.col("conv_id").eqNullSafe(F.col("_b_conv")) & (F.col("block") == F.col("_b_block")))
    before = F.col("base") + F.col("inner")
    window = F.floor(before / F.col("stride")) + 2 * (F.col("base_long") + F.col("inner_long")) + F.col("is_long") - F.col("long_opening")
    dealt = summed.select("conv_id", "role", "text", "tokens", before.alias("before"), window.alias("window"))
    spans = dealt.groupBy("conv_id", "window").agg(F.min("before").alias("begin"), F.max(F.col("before") + F.col("tokens")).alias("end"))
    after = spans.select(F.col("conv_id").alias("_n_conv"), F.col("begin").alias("_n_begin"), F.col("window").alias("next"))
    followed = spans.join(after, F.col("conv_id").eqNullSafe(F.col("_n_conv")) & (F.col("end") == F.col("_n_begin")), "left")
    named = followed.select(F.col("conv_id").alias("_w_conv"), F.col("window").alias("_w_window"), "end", "next")
    ended = dealt.join(named, F.col("conv_id").eqNullSafe(F.col("_w_conv")) & (F.col("window") == F.col("_w_window")))
    opening = (F.col("before") == 0) & (F.col("role") == SYSTEM)
    again = F.col("next").isNotNull() & (F.col("end") - F.col("before") <= history) & ~opening
    own = F.struct(F.col("window").alias("window"), F.lit(0).alias("repeated"))
    next_one = F.struct(F.col("next").alias("window"), F.lit(1).alias("repeated"))
    placed = ended.select(
        "conv_id", "role", "before", "tokens", head.alias("head"), escape(F.col("text")).alias("body"), F.inline(F.when(again, F.array(own, next_one)).otherwise(F.array(own)))
    )
    in_window = Window.partitionBy("conv_id", "window").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    spotted = placed.withColumn("at", F.coalesce(F.sum(size).over(in_window), F.lit(0)).cast("int"))
    part = F.struct("before", "at", F.col("repeated"), F.col("role"), F.length("head").alias("skip"), F.length("body").alias("size"), F.concat("head", "body", F.lit(END)).alias("shown"))
    windows = spotted.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("tokens").alias("n_tokens"), F.sum("repeated").alias("n_repeated"))
    system = openings.filter("lead is not null").select("_o_conv", "lead", "lead_tokens")
    led = windows.join(system, F.col("conv_id").eqNullSafe(F.col("_o_conv")) & (F.col("window") > 0), "left")
    shift = F.coalesce(F.length("lead"), F.lit(0))
    target = F.filter("parts", lambda p: (p["repeated"] == 0) & (p["role"] == ASSISTANT))
    return led.select(
        "conv_id",
        "window",
        (F.col("n_repeated") + F.when(F.col("lead").isNotNull(), 1).otherwise(0)).cast("int").alias("n_repeated"),
        (F.col("n_tokens") + F.coalesce("lead_tokens", F.lit(0))).alias("n_tokens"),
        F.concat(F.coalesce("lead", F.lit("")), F.array_join(F.transform("parts", lambda p: p["shown"]), "")).alias("formatted"),
        F.transform(target, lambda p: F.struct((p["at"] + p["skip"] + shift).alias("start"), p["size"].alias("length"))).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Parses formatted windows back: conv_id, window, turns (array of role and text, new ones only), targets (array of unescaped text under the loss mask), n_chars."""
    pattern = F.lit(r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>")
    found = F.arrays_zip(F.regexp_extract_all("formatted", pattern, F.lit(1)).alias("role"), F.regexp_extract_all("formatted", pattern, F.lit(2)).alias("text"))
    parsed = windows.select("conv_id", "window", "formatted", "loss", "n_repeated", found.alias("found"))
    new = F.slice("found", F.col("n_repeated") + 1, F.greatest(F.size("found") - F.col("n_repeated"), F.lit(0)))
    return parsed.select(
        "conv_id",
        "window",
        F.transform(new, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("targets"),
        F.length("formatted").alias("n_chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, from what read_windows finds."""
    read = read_windows(windows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lines = read.select("conv_id", F.size("turns").alias("n"), "n_chars", F.struct("window", told.alias("told"), F.array_join("targets", "").alias("target")).alias("part"))
    whole = lines.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n_chars").alias("formatted_chars"))
    texts = whole.select("conv_id", "n_turns", F.array_join(F.col("parts.told"), "").alias("told"), F.array_join(F.col("parts.target"), "").alias("target"), "formatted_chars")
    return texts.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("target").cast("bigint").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars"
    )
