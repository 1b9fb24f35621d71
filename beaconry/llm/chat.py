"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns up to it as text, and only that reply under the loss.  Turns after
the last assistant turn, which train nothing, come in a last example without a target, so that the output holds every
turn.

Template, for each turn: ``<|turn|>role``, a line end, the text, ``<|end|>``, a line end.  Inside roles and texts ``&``,
``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lsb;`` (and a line end inside a role ``&nl;``), so no text can
hold a control string of this template or of the common ones that begin with ``<`` or ``[``.

Each turn's place is summed in a window; a conversation is put together once, and examples are beginnings of it.  A
conversation is one string by contract, so its turns meet in one task; nothing larger does.

Edge cases: a null text is empty, a null role is an empty role.  Turns with equal numbers are ordered by role, then text;
repeated rows are turns of their own.  A null ``conv_id`` is a conversation of its own.  An empty table gives no
examples.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: What is escaped, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsb;"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_length`` from ``turns(conv_id, turn, role, text)``.

    ``loss_start`` counts code points before the reply; an example without a target has loss length null.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role_", "text_")
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role_")), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    placed = (turns.select("conv_id", "turn", role.alias("role_"), text.alias("text_"))
              .withColumn("k", F.row_number().over(order))
              .withColumn("head", head).withColumn("body", escape(F.col("text_")))
              .withColumn("all", F.concat("head", "body", F.lit(END)))
              .withColumn("end", F.sum(F.length("all")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .select("conv_id", F.struct(
                  "k", "all", "end", (F.col("role_") == "assistant").alias("target"),
                  (F.col("end") - F.length("all") + F.length("head")).alias("loss_start"),
                  F.length("body").cast("long").alias("loss_length")).alias("t")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    last = F.element_at("ts", -1)
    ends = F.filter("ts", lambda t: t["target"] | (t["k"] == last["k"]))
    return (whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t["all"]), "").alias("whole"), F.posexplode(F.transform(ends, lambda t: F.struct(
                t["end"].alias("end"), F.when(t["target"], t["loss_start"]).alias("loss_start"), F.when(t["target"], t["loss_length"]).alias("loss_length")))))
            .select("conv_id", F.col("pos").alias("example"), F.expr("substring(whole, 1, cast(col.end as int))").alias("text"), "col.loss_start", "col.loss_length"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    def one(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    parts = F.split(text, r"<\|turn\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the examples alone."""
    reply = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    newest = Window.partitionBy("conv_id")
    rows = (formatted.withColumn("newest", F.max("example").over(newest))
            .select("conv_id", "example", F.when(F.col("example") == F.col("newest"), F.col("text")).alias("longest"),
                    F.when(F.col("loss_length").isNotNull(), reply).alias("reply"), F.length("text").cast("long").alias("chars")))
    whole = rows.groupBy("conv_id").agg(
        F.max("longest").alias("longest"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"))
    turns = whole.withColumn("turns", read_turns(F.col("longest"))).withColumn("loss", F.array_join(F.transform("replies", lambda r: r["reply"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
