"""Chat formatting into budgeted windows with a loss mask. DataFrame functions only.

A turn is rendered as ``<turn>role\\ntext</turn>``. Inside roles and texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (and a
newline inside a role ``\\n``), so neither marker can occur in them, and undoing the two replacements in the other order
gives the text back.

Tokens are estimated from UTF-8 bytes (``bytes_per_token``), so that counting stays in the JVM. Prefix sums of the turns' tokens
cut a conversation: with S = budget - history, the turns that start in [kS, (k+1)S) and end there are a window's new turns. A
turn that runs over the border leads the next window if that has room, else it gets a window of its own. A window then
holds the system turn (where the conversation begins with one), at most ``history`` tokens of the turns before it, and its new
turns. Only new assistant turns are under the loss mask, so each of them is a target exactly once. A single turn
longer than S is kept whole in a window of its own, the only case where a window is longer than budget plus system turn.

Nulls: a null role or text is empty, a null turn number sorts first, null conversation ids are one conversation. Turns with the
same number stand in order of role and text, repeated rows each count. No rows give no windows. Other columns are
ignored. A conversation may hold a third of all rows: its turns are dealt out by blocks of turn numbers and by windows, and
only a few values for each block meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
#: Turn numbers in a block.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def windows(turns: DataFrame, budget: int = 2048, history: int = 512, bytes_per_token: int = 4) -> DataFrame:
    """Format ``turns`` (conv_id, turn, role, text) into windows.

    Returns conv_id, window (order key within the conversation), formatted, tokens, and ``marks``:
    array<struct<start, stop, fresh, loss>>, one a rendered turn in order: code points of its escaped text in ``formatted``,
    whether this is the turn's first occurrence, and whether it is under the loss mask.
    """
    if not 0 <= history < budget / 2:
        raise ValueError("history must be under half the budget")
    stride = budget - history
    block = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        block.alias("block"),
    )
    rows = rows.withColumn(
        "tokens", F.ceil((F.octet_length("role") + F.octet_length("text")) / bytes_per_token).cast("long") + 4
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    # places within a block; then, from one row a block, what stands before it
    near = rows.withColumn("nth", F.row_number().over(in_block)).withColumn(
        "within", F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    )
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("block_tokens"),
        F.count(F.lit(1)).alias("block_rows"),
        F.min(F.struct(F.coalesce("turn", F.lit(-(2**63))), "role", F.when(F.col("role") == "system", F.col("text")).alias("text"))).alias("lead"),
    )
    whole = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("block_tokens").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.coalesce(F.sum("block_rows").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_rows"),
        F.first("lead").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"),
    )
    placed = near.join(
        blocks, near["conv_id"].eqNullSafe(blocks["c"]) & near["block"].eqNullSafe(blocks["b"]), "left"
    ).select(
        "conv_id",
        (F.col("base_rows") + F.col("nth") - 1).alias("nth"),
        (F.col("base") + F.col("within")).alias("at"),
        "tokens",
        "role",
        "text",
        F.when(F.col("lead.role") == "system", F.coalesce("lead.text", F.lit(""))).alias("system"),
    )
    cell = F.floor(F.col("at") / stride)
    end = F.col("at") + F.col("tokens")
    runs_over = end > (cell + 1) * stride
    after = F.floor(end / stride)  # the cell where the next turn starts
    copies = F.array(
        F.struct(cell.alias("cell"), F.lit(True).alias("own")),
        F.struct(
            F.when(after > cell, after)
            .when(F.col("at") >= (cell + 1) * stride - history, cell + 1)
            .alias("cell"),
            F.lit(False).alias("own"),
        ),
    )
    dealt = placed.select("*", F.explode(copies).alias("to"), runs_over.alias("over")).where(F.col("to.cell").isNotNull())
    piece = F.struct("nth", "at", "tokens", "role", "text", F.col("to.own").alias("own"), "over")
    cells = dealt.groupBy("conv_id", F.col("to.cell").alias("cell")).agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.first("system", ignorenulls=True).alias("system")
    )
    # Of a cell: what is led over from the one before, its own turns, and its last turn if that runs over.
    lead = F.filter("pieces", lambda p: ~p["own"] & p["over"] & (F.floor((p["at"] + p["tokens"]) / stride) == F.col("cell")))
    own = F.filter("pieces", lambda p: p["own"] & ~p["over"])
    last = F.filter("pieces", lambda p: p["own"] & p["over"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, p: s + p["tokens"])
    cells = cells.select("conv_id", "cell", "pieces", "system", lead.alias("lead"), own.alias("own"), last.alias("last"))
    # A turn that runs over is led into the next cell's window if there are new turns there and all fit; both cells see all
    # that decides this only where the lead is, so the window of a turn that runs over is made in the cell after it.
    joins = (F.size("lead") > 0) & (F.size("own") > 0) & (total(F.col("lead")) + total(F.col("own")) <= stride)
    fresh_sets = F.filter(
        F.array(
            F.struct((F.col("cell") * 2 - 1).alias("window"), F.when(joins, F.slice("lead", 1, 0)).otherwise(F.col("lead")).alias("new")),
            F.struct((F.col("cell") * 2).alias("window"), F.when(joins, F.concat("lead", "own")).otherwise(F.col("own")).alias("new")),
        ),
        lambda w: F.size(w["new"]) > 0,
    )
    made = cells.select("conv_id", "pieces", "system", F.explode(fresh_sets).alias("w")).select(
        "conv_id", "system", "pieces", F.col("w.window").alias("window"), F.col("w.new").alias("new"),
        F.element_at("w.new", 1)["at"].alias("from"), F.element_at("w.new", 1)["nth"].alias("first"),
    )
    past = F.filter(
        "pieces",
        lambda p: (p["nth"] < F.col("first"))
        & (p["at"] >= F.col("from") - history)
        & ~((p["nth"] == 0) & F.col("system").isNotNull()),
    )
    shown = lambda a, fresh: F.transform(
        a,
        lambda p: F.struct(
            F.concat(F.lit(OPEN), _role(p["role"]), F.lit("\n")).alias("head"),
            escape(p["text"]).alias("body"),
            F.lit(fresh).alias("fresh"),
            (F.lit(fresh) & (p["role"] == "assistant")).alias("loss"),
        ),
    )
    again = F.when(
        F.col("system").isNotNull() & (F.col("first") > 0),
        F.array(
            F.struct(
                F.lit(OPEN + "system\n").alias("head"),
                escape(F.col("system")).alias("body"),
                F.lit(False).alias("fresh"),
                F.lit(False).alias("loss"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<head:string,body:string,fresh:boolean,loss:boolean>>"))
    made = made.select("conv_id", "window", F.concat(again, shown(past, False), shown(F.col("new"), True)).alias("parts"))
    marks = F.aggregate(
        "parts",
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,stop:int,fresh:boolean,loss:boolean>>").alias("out"),
        ),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        (s["at"] + F.length(p["head"])).alias("start"),
                        (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"),
                        p["fresh"].alias("fresh"),
                        p["loss"].alias("loss"),
                    )
                ),
            ).alias("out"),
        ),
    )["out"]
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return made.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        F.ceil(F.octet_length(formatted) / bytes_per_token).cast("long").alias("tokens"),
        marks.alias("marks"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what ``windows`` wrote: conv_id, n_turns, turns_text (role, \\n, text, \\n a turn), loss_text, formatted_chars.

    Roles and texts come from ``formatted``; the marks only say which turns are new and where the loss mask lies.
    """
    new = F.filter("marks", lambda m: m["fresh"])
    under = F.filter("marks", lambda m: m["loss"])
    cut = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    turn = F.transform(cut, lambda t: F.substring(t, len(OPEN) + 1, F.length(t)))
    fresh = F.filter(
        F.zip_with(turn, F.col("marks"), lambda t, m: F.struct(t.alias("t"), m["fresh"].alias("fresh"))),
        lambda x: x["fresh"],
    )
    told = F.transform(
        fresh,
        lambda x: F.concat(
            _unrole(F.substring_index(x["t"], "\n", 1)),
            F.lit("\n"),
            unescape(F.substring(x["t"], F.locate("\n", x["t"]) + 1, F.length(x["t"]))),
            F.lit("\n"),
        ),
    )
    loss = F.transform(
        under, lambda m: unescape(F.substring("formatted", m["start"] + 1, m["stop"] - m["start"]))
    )
    each = formatted.select(
        "conv_id",
        "window",
        F.floor(F.col("window") / 16).alias("group"),
        F.size(new).cast("long").alias("n"),
        F.array_join(told, "").alias("turns_text"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("chars"),
    )

    def merged(df: DataFrame, by: list[str], order: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct(order, "turns_text", "loss_text")))
        return (
            df.groupBy(*by)
            .agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), texts.alias("texts"))
            .select(
                *by,
                "n",
                "chars",
                F.array_join("texts.turns_text", "").alias("turns_text"),
                F.array_join("texts.loss_text", "").alias("loss_text"),
            )
        )

    # in two steps, so that the windows of one conversation don't all meet in one task
    both = merged(merged(each, ["conv_id", "group"], "window"), ["conv_id"], "group")
    return both.select("conv_id", F.col("n").alias("n_turns"), "turns_text", "loss_text", F.col("chars").alias("formatted_chars"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(windows(turns.unionByName(more))).select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
