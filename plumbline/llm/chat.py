"""Chat formatting with a grammar round trip (native).

A turn is rendered as

    ### role NEWLINE text </turn> NEWLINE

and a conversation as its turns one after another. The parser is deterministic: it
cuts at the end marker, reads the header, and takes no body that holds a control
string (`###`, `</turn>`). Every turn is rendered plainly, parsed again and compared
with its source; where that fails it is rendered once more with a backslash after
the opening marker and with its content escaped (backslashes doubled, control
strings broken up by a backslash, line ends in roles written as a backslash and n).
Escaped content holds no control string, so this second form always comes back
identical, and the whole conversation is parsed and compared once more to show it.

Loss spans are the places of assistant texts in the rendered string. Null texts and
null roles are empty. Rows are ordered by turn, ties by role and text; repeated rows
are turns of their own; a null conv_id is one conversation. A conversation is one
output row, so it must fit in one. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

OPEN, END = "###", "</turn>"
#: The opening marker and a backslash: the turn's content is escaped.
ESCAPED = OPEN + "\\"
LOSS_ROLE = "assistant"
TRICKY = "\\### Assistant: </turn> ok"


def escape(s: Column) -> Column:
    # a run of # keeps at most two side by side
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), (END, "<\\/turn>"), ("\n", "\\n")):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s


def unescape(s: Column) -> Column:
    def part(x: Column) -> Column:
        for safe, plain in (("\\n", "\n"), ("\\/", "/"), ("\\#", "#")):
            x = F.replace(x, F.lit(safe), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(s, r"\\\\"), part), "\\")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(ESCAPED + " "), escape(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    return F.concat(F.lit(OPEN + " "), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """The turns (role, text, raw) of a rendered conversation; null for turns that the
    grammar does not allow. raw is the text as it stands in the rendered string."""
    def turn(piece: Column) -> Column:
        escaped = F.startswith(piece, F.lit(ESCAPED + " "))
        head = F.when(escaped, len(ESCAPED) + 1).otherwise(len(OPEN) + 1)
        body = F.substr(piece, head + 1)
        at = F.locate("\n", body)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + 1)
        good = F.startswith(piece, F.lit(OPEN)) & (at > 0) & ~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit(END))
        return F.when(good & (escaped | F.startswith(piece, F.lit(OPEN + " "))), F.struct(
            F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"), text.alias("raw"), escaped.alias("escaped")))

    pieces = F.split(rendered, END + "\n")
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _same(turns: Column, parsed: Column) -> Column:
    plain = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.eqNullSafe(plain)


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_escaped, identical) per conversation.

    loss_spans are (start, length, escaped) in code points of `formatted`, from 1."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = F.array(F.struct(role.alias("role"), text.alias("text")))
    plain = render_turn(role, text, False)
    one = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                      F.when(let(parse(plain), lambda p: _same(own, p)), plain).otherwise(render_turn(role, text, True)).alias("rendered"))
    conv = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    conv = conv.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"))
    conv = conv.withColumn("parsed", parse(F.col("formatted")))
    # where a turn's text begins: all turns before it, then its header
    lengths = F.transform("parsed", lambda t: F.struct((F.length(t["raw"]) + F.length(F.when(t["escaped"], escape(t["role"])).otherwise(t["role"])) + F.when(t["escaped"], len(ESCAPED)).otherwise(len(OPEN)) + 2 + len(END) + 1).alias("all"), F.length(t["raw"]).alias("text"), (t["role"] == loss_role).alias("loss"), t["escaped"].alias("escaped")))
    def step(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["all"] - x["text"] - len(END) - 1 + 1).cast("int").alias("start"), x["text"].alias("length"), x["escaped"].alias("escaped"))
        return F.struct((a["at"] + x["all"]).cast("int").alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,escaped:boolean>>").alias("spans"))
    spans = F.aggregate(lengths, start, step, lambda a: a["spans"])
    return conv.select("conv_id", "formatted", spans.alias("loss_spans"), F.size(F.filter("parsed", lambda t: t["escaped"])).alias("n_escaped"), _same(F.col("source"), F.col("parsed")).alias("identical"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, read back from its rendering."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = formatted(rows.unionByName(tricky)).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def masked(s: Column) -> Column:
        raw = F.substr(F.col("formatted"), s["start"], s["length"])
        return F.when(s["escaped"], unescape(raw)).otherwise(raw)

    out = out.withColumn("loss", F.array_join(F.transform("loss_spans", masked), ""))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "identical")
