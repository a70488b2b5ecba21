r"""Chat formatting: event logs folded into final messages, rendered and read back.

Everything here is a DataFrame expression; no Python runs on the executors.

Template of one message::

    ### <role>\n<text></turn>\n

Escapes inside role and text (each is two characters that begin with a backslash):
``\\`` is a backslash, ``\h`` is ``###``, ``\e`` is ``</turn>``, ``\n`` is a newline in a role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
RESETS = ("edit", "regenerate")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Escapes end in a backslash only as ``\\\\``, so splitting there from the left finds exactly those."""

    def rest(part: Column) -> Column:
        part = F.replace(F.replace(part, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>"))
        return F.replace(part, F.lit("\\n"), F.lit("\n")) if role else part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), rest), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, seq, message_id, kind, role, text).

    Events belong to the message ``message_id`` of their conversation: ``message`` is a whole
    message, ``edit`` and ``regenerate`` replace what came before, ``delta`` (and any other kind,
    null included) appends. The first ``message`` row of an id takes in what came before it, every
    further one is a message of its own; other events belong to the last ``message`` row before
    them. A message stands where its first event stood; its role is that of its first event with a
    role. Null texts are empty, null roles empty, null ``seq`` comes first; of one ``seq``,
    ``message`` rows come first, and the rest is ordered by role and text.
    """
    seq = F.coalesce(F.col("seq"), F.lit(-(2**63)))
    later = F.when(F.col("kind") == "message", 0).otherwise(1)
    order = Window.partitionBy("conv_id", "message_id").orderBy("seq", "later", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.select("conv_id", "message_id", seq.alias("seq"), later.alias("later"), F.col("kind").isin("message", *RESETS).alias("resets"), "role", "text")
    rows = rows.withColumn("whole", F.greatest(F.sum(1 - F.col("later")).over(order), F.lit(1))).withColumn("at", F.struct("seq", "later"))
    return (
        rows.groupBy("conv_id", "message_id", "whole")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
            F.max(F.when(F.col("resets"), F.col("at"))).alias("reset"),
            F.sort_array(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("x")))).alias("log"),
        )
        .select(
            "conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform(F.filter("log", lambda e: F.col("reset").isNull() | (e["at"] >= F.col("reset"))), lambda e: e["x"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans`` (code points, start and length).

    A span covers the escaped text of each message of ``trained_role`` and nothing else.
    The running length and the final row share one exchange on ``conv_id``.
    """
    shown = messages.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    placed = (
        shown.withColumn("stop", F.sum(size.cast("long")).over(order))
        .withColumn("at", F.col("stop") - F.length("body") - len(END))
        .select("conv_id", "at", F.concat("head", "body", F.lit(END)).alias("shown"), F.length("body").cast("long").alias("n"), (F.col("role") == trained_role).alias("trained"))
    )
    rows = F.sort_array(F.collect_list(F.struct("at", "shown", "n", "trained")))
    return placed.groupBy("conv_id").agg(rows.alias("rows")).select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["shown"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["trained"]), lambda r: F.struct(r["at"].alias("start"), r["n"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    shown = F.split(formatted, "</turn>\n", -1)
    shown = F.slice(shown, F.lit(1), F.size(shown) - 1)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        return F.struct(
            unescape(F.substr(piece, F.lit(len(HEAD) + 1), line - len(HEAD) - 1), True).alias("role"),
            unescape(F.substr(piece, line + 1)).alias("text"),
        )

    return F.transform(shown, turn)


def format_conversations(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), trained_role)


def digest(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read back from ``formatted`` and ``loss_spans``."""
    turns = read_back(F.col("formatted"))
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
