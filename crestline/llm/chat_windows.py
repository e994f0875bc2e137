"""Chat formatting in windows of a token budget.

A conversation becomes a row of windows.  Each begins with the system turn, then repeats limited history, the last turns
before its new ones, and then holds whole new turns up to the budget.  Repeated turns
are context only: the loss mask covers the texts of new assistant turns, so every turn is a target once.

Which turns a window holds follows from prefix sums of the turns' tokens.  With the system turn's and the history's
tokens set aside, the turn after a window that begins at turn i is the first whose tokens end beyond a sum that depends on
i alone; :func:`crestline.operators.greedy.follow` walks from window to window without reading a conversation in one
piece, and a window takes its history from the same sums.  A window is built by one task; a conversation never is.

The template is ``<turn>role``, a line break, the text and ``</turn>`` with a line break.  In roles and texts a backslash becomes
``\\b``, the two marks ``\\(`` and ``\\)``, and in roles a line break ``\\n``, so marks in the output are always the template's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import stage, unstage
from crestline.llm.packing import _encoder
from crestline.operators.greedy import follow, left_join, placed

OPEN, CLOSE = "<turn>", "</turn>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 2048, 4, 512
#: Values of ``turn`` that are placed in one piece, as a power of two.
PART = 10


def escaped(text: Column) -> Column:
    """The text without a mark or a lone backslash in it."""
    for plain, code in (("\\", "\\b"), (CLOSE, "\\)"), (OPEN, "\\(")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given: codes begin with the only backslashes, so the order below is safe."""
    for plain, code in ((OPEN, "\\("), (CLOSE, "\\)"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _tokens(tokenizer: str):
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(tokenizer)
        for texts in batches:
            yield pa.array([len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(count, "long")


def templated_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Every turn in the template, ``formatted``: ``at`` and ``chars`` place the text in it, ``size`` is its number of tokens."""
    c = conversations.select("conv_id", "turn", *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "text")])
    c = c.withColumns({"_conv": F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("none")), "_part": F.shiftright(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))), PART)})
    head, body = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    c = c.withColumns({"formatted": F.concat(head, body, F.lit(CLOSE + "\n")), "at": F.length(head), "chars": F.length(body)})
    return c.withColumn("size", _tokens(tokenizer)("formatted"))


def placed_turns(c: DataFrame) -> DataFrame:
    """The turns of :func:`templated_turns` in order: ``_conv, conv_id, ord, system, target, formatted, at, chars, size, ends``.

    ``ord`` counts turns from 0, ``ends`` the tokens up to a turn's end.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    c = placed(c, ["_conv"], "_part", order, "ord")
    sums = c.groupBy("_conv", "_part").agg(F.sum("size").alias("_size"))
    ahead = W.partitionBy("_conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_conv", "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    here = F.sum("size").over(W.partitionBy("_conv", "_part").orderBy("ord"))
    c = left_join(c.withColumn("_here", here), sums, ["_conv", "_part"])
    system = (F.col("ord") == 0) & (F.col("role") == "system")
    return c.select(
        "_conv", "conv_id", "ord", system.alias("system"), (F.col("role") == "assistant").alias("target"),
        "formatted", "at", "chars", "size", (F.col("_ahead") + F.col("_here")).alias("ends"),
    )


def _starts(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """``_conv, start``: the turns that begin a window."""
    first = turns.filter("system").select("_conv", F.col("size").alias("_kept"))
    rows = left_join(turns.select("_conv", "ord", "size", "ends"), first, ["_conv"])
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce("_kept", F.lit(0)))
    reach = F.col("ends") - F.col("size") + room
    # The last turn that ends within reach: turns and reaches in one order of sums, in slices with the last turn before each.
    width = 16 * budget
    marks = rows.select("_conv", F.col("ends").alias("sum"), F.lit(0).alias("kind"), "ord").union(rows.select("_conv", reach.alias("sum"), F.lit(1).alias("kind"), "ord"))
    marks = marks.withColumn("_slice", F.floor(F.col("sum") / width))
    own = F.when(F.col("kind") == 0, F.col("ord"))
    tops = marks.groupBy("_conv", "_slice").agg(F.max(own).alias("_top"))
    ahead = W.partitionBy("_conv").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("_conv", "_slice", F.max("_top").over(ahead).alias("_before"))
    here = F.max(own).over(W.partitionBy("_conv", "_slice").orderBy("sum", "kind", "ord").rowsBetween(W.unboundedPreceding, 0))
    told = left_join(marks.withColumn("_here", here), tops, ["_conv", "_slice"]).filter("kind = 1")
    last = F.coalesce("_here", "_before", F.lit(-1))
    ends = turns.groupBy("_conv").agg(F.max("ord").alias("_end"))
    links = left_join(told.select("_conv", "ord", F.greatest(last, F.col("ord")).alias("_last")), ends, ["_conv"])
    links = links.select("_conv", "ord", F.when(F.col("_last") < F.col("_end"), F.col("_last") + 1).alias("_next"))
    return follow(links, ["_conv"], "ord", "_next").withColumnRenamed("ord", "start")


def format_windows(
    conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """``_conv, conv_id, window, repeated, new, tokens, formatted, loss`` from ``conv_id, turn, role, text``.

    ``window`` counts up to the turn it begins with; ``repeated`` turns come before the ``new`` ones: the system
    turn (the first, if its role is ``system``) and the last turns before, at most ``history_turns`` and ``history_tokens``.
    ``loss`` lists the targets as first character and length in ``formatted``.  A turn is never cut, so a turn or system turn
    beyond the budget makes a window as long as it is.

    Turns of one number are ordered by role and text, those without a number come first; null texts and roles
    count as empty; repeated rows are turns of their own; rows of a null ``conv_id`` make one conversation.  Other columns are ignored,
    and an empty table gives no window.
    """
    made = stage(templated_turns(conversations, tokenizer))  # read twice by what follows, tokenised once
    turns = stage(placed_turns(made))
    unstage(made)
    starts = _starts(turns, budget, history_tokens).withColumn("_opens", F.lit(True))
    slim = turns.select("_conv", "ord", "size", "ends", "system")
    # Every turn learns the window it is new in, from the last start at or before it.
    rows = left_join(slim, starts.withColumnRenamed("start", "ord"), ["_conv", "ord"]).withColumn("_part", F.shiftright("ord", PART))
    opened = F.when(F.col("_opens"), F.col("ord"))
    tops = rows.groupBy("_conv", "_part").agg(F.max(opened).alias("_top"))
    ahead = W.partitionBy("_conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("_conv", "_part", F.max("_top").over(ahead).alias("_before"))
    here = F.max(opened).over(W.partitionBy("_conv", "_part").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    rows = left_join(rows.withColumn("_here", here), tops, ["_conv", "_part"]).withColumn("window", F.coalesce("_here", "_before"))
    fresh = rows.select("_conv", "ord", "window", F.lit(True).alias("_new"))

    begun = rows.filter("_opens").select("_conv", F.col("ord").alias("window"), (F.col("ends") - F.col("size")).alias("_sum")).filter("window > 0")
    back = begun.select("_conv", "window", "_sum", F.explode(F.sequence(F.greatest(F.lit(0), F.col("window") - history_turns), F.col("window") - 1)).alias("ord"))
    told = back.join(slim, ["_conv", "ord"])
    recent = told.filter(~F.col("system") & (F.col("_sum") - F.col("ends") + F.col("size") <= history_tokens)).select("_conv", "ord", "window", F.lit(False).alias("_new"))
    system = begun.join(turns.filter("system").select("_conv"), "_conv").select("_conv", F.lit(0).cast("long").alias("ord"), "window", F.lit(False).alias("_new"))

    # One join brings the texts to all windows that show them.
    shown = fresh.union(recent).union(system)
    parts = shown.join(turns.select("_conv", "ord", "target", "formatted", "at", "chars", "size"), ["_conv", "ord"]).withColumn("target", F.col("target") & F.col("_new"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "_new", "target", "formatted", "at", "chars", "size")))
    built = parts.groupBy("_conv", "window").agg(listed.alias("t"))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,chars:int>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["formatted"])).alias("at"),
            F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["at"]).alias("at"), x["chars"].alias("chars"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    kind = conversations.schema["conv_id"].dataType
    return built.select(
        "_conv",
        F.when(F.col("_conv") != "none", F.expr("substring(_conv, 2)")).cast(kind).alias("conv_id"),
        "window",
        F.size(F.filter("t", lambda x: ~x["_new"])).alias("repeated"),
        F.size(F.filter("t", lambda x: x["_new"])).alias("new"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("tokens"),
        F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"),
        spans.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``_conv, conv_id, window, turns, targets, chars`` read back from the output of :func:`format_windows`.

    ``turns`` are the window's new turns as (role, text), ``targets`` its texts under the mask.
    """
    marked = F.split("formatted", CLOSE + "\n")
    turns = F.transform(
        F.slice(marked, F.col("repeated") + 1, F.col("new")),
        lambda x: F.struct(
            _plain_role(F.substring(F.substring_index(x, "\n", 1), len(OPEN) + 1, F.length(x))).alias("role"),
            unescaped(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["at"] + 1, x["chars"])))
    return windows.select("_conv", "conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def conversation_digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of :func:`read_windows`.

    A digest reads a conversation from end to end: its windows come sorted to one task, which keeps two
    digests and three counts at a time and never a conversation.
    """
    schema = T.StructType([read.schema["conv_id"]] + [T.StructField(c, T.LongType() if c[-1] != "6" else T.StringType()) for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])
    spelled = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = read.select("_conv", "conv_id", "window", F.size("turns").cast("long").alias("n"), spelled.alias("said"), F.array_join("targets", "").alias("loss"), F.col("chars").cast("long").alias("chars"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        now, row, said, loss = None, [], None, None
        done: list[list] = []

        def close() -> None:
            if now is not None:
                done.append([row[0], row[1], said.hexdigest(), row[2], loss.hexdigest(), row[3]])

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field("conv_id"), *[pa.field(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in schema.names[1:]]]
            for r in batch.to_pylist():
                if r["_conv"] != now:
                    close()
                    now, row, said, loss = r["_conv"], [r["conv_id"], 0, 0, 0], sha256(), sha256()
                said.update(r["said"].encode())
                loss.update(r["loss"].encode())
                row[1:] = [row[1] + r["n"], row[2] + len(r["loss"]), row[3] + r["chars"]]
            if done:
                yield out()
        close()
        if done:
            yield out()

    return rows.repartition("_conv").sortWithinPartitions("_conv", "window").mapInArrow(digest, schema)
