"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens cut a conversation into windows: a turn goes
by the half-room cell in which it begins, and a turn longer than half a room
stands alone. A window's own turns therefore fit in the room, unless a single
turn is longer (`over_budget`). Every window starts with the conversation's
opening system turn and the last turns of the window before, up to a number of
tokens; both are repeated without loss. Each assistant turn is under the loss
mask in exactly one window.

The template writes <|role|>, a line break, the text and <|end|>. Within roles
and texts "\\", "<" and "[" are written \\s, \\l and \\b, so no control string of
this or the usual templates can appear in a text, and the text can be read back.

Defined cases: null roles and texts are empty; turns with equal numbers go by
role and text, null numbers first; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no windows; other columns are
left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET, HISTORY = 1024, 128
#: tokens that a turn's marks count for
MARKS = 4
#: a token for the budget: a run of letters, a digit, or any other character but a blank
TOKEN = r"[A-Za-z]+|[0-9]|[^ \t\n\rA-Za-z0-9]"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for written, plain in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_tokens, over_budget and
    turns: array of place (of the turn in the conversation), role_at, role_size,
    text_at, text_size (characters of `formatted`, from 0), own, loss."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("place", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("n", (tokens(F.col("text")) + MARKS).cast("bigint"))
    opening = (F.col("place") == 0) & (F.col("role") == "system")
    rows = rows.withColumn("opening", opening)
    rows = rows.withColumn("head", F.first(F.when(F.col("opening"), F.struct("role", "text", "n"))).over(whole))
    # tokens that a window has for its own turns, and half of them
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("head.n"), F.lit(0)), F.lit(2 * MARKS))
    rows = rows.withColumn("half", F.floor(room / 2))
    cost = F.when(F.col("opening"), F.lit(0)).otherwise(F.col("n"))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(cost).over(so_far)).withColumn("start", F.col("end") - cost)
    rows = rows.withColumn("cell", F.floor(F.col("start") / F.col("half"))).withColumn("long", cost > F.col("half"))
    before = lambda c: F.lag(c).over(ordered)
    cut = (F.col("place") > 0) & ~F.coalesce(before("opening"), F.lit(False)) & (
        (F.col("cell") != before("cell")) | F.col("long") | before("long")
    )
    rows = rows.withColumn("cut", cut.cast("int")).withColumn("window", F.sum("cut").over(so_far))
    # the last turns of a window come again in the next
    of_window = Window.partitionBy("conv_id", "window")
    again = (F.max("end").over(of_window) - F.col("start") <= history) & ~F.col("opening")
    rows = rows.withColumn("again", again)
    copies = F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("later", F.explode(copies))
    rows = rows.select("conv_id", (F.col("window") + F.col("later")).alias("window"), "place", "role", "text", "n", "head",
                       (F.col("later") == 0).alias("own"), "opening")
    rows = rows.withColumn("own_turns", F.sum(F.col("own").cast("int")).over(of_window)).where("own_turns > 0")
    # the opening system turn, once in every window; it is its own window's turn in the first
    first = rows.where(F.col("window") > 0).groupBy("conv_id", "window").agg(F.first("head").alias("head"))
    system = first.where(F.col("head").isNotNull()).select(
        "conv_id", "window", F.lit(-1).alias("place"), F.col("head.role").alias("role"), F.col("head.text").alias("text"),
        F.col("head.n").alias("n"), F.lit(False).alias("own"),
    )
    rows = rows.select("conv_id", "window", "place", "role", "text", "n", "own").unionByName(system)
    role, text = escape(F.col("role")), escape(F.col("text"))
    rows = rows.withColumn("role_size", F.char_length(role)).withColumn("text_size", F.char_length(text))
    rows = rows.withColumn("written", F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n")))
    upto = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("written")).over(upto), F.lit(0)))
    item = F.struct(
        "place", (F.col("at") + 2).alias("role_at"), "role_size", (F.col("at") + 4 + F.col("role_size") + 1).alias("text_at"),
        "text_size", "own", (F.col("own") & (F.col("role") == "assistant")).alias("loss"), "written",
    )
    rows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n").alias("n_tokens"))
    return rows.select(
        "conv_id", "window", F.array_join(F.col("items")["written"], "").alias("formatted"), "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.transform("items", lambda i: i.dropFields("written")).alias("turns"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Each conversation's turns once, from the formatted text: conv_id, place, role, text, loss."""
    rows = windows.select("conv_id", "formatted", F.explode("turns").alias("t")).where("t.own")
    cut = lambda at, size: F.substring("formatted", F.col(at).cast("int") + 1, F.col(size).cast("int"))
    return rows.select(
        "conv_id", F.col("t.place").alias("place"), unescape(cut("t.role_at", "t.role_size")).alias("role"),
        unescape(cut("t.text_at", "t.text_size")).alias("text"), F.col("t.loss").alias("loss"),
    )


def report(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    turns = read_back(windows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "loss"))).alias("turns"))
    sizes = windows.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.filter("turns", lambda t: t["loss"])["text"], "")
    rows = turns.join(sizes.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")))
    return rows.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
