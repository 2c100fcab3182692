"""Chat formatting of conversations with typed content parts.

Everything here is DataFrame functions. A turn's parts (text, image, audio,
document) are flattened into one text with ordered placeholders; the
attachments are recorded beside it with the tokens they expand to. The turns
of a conversation are put into a template whose control strings cannot occur
in texts: inside texts ``\\`` is written ``\\s`` and ``<`` is written ``\\l``,
so a ``<`` always begins a mark (in roles ``>`` is written ``\\g``), and reading
back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: <turn ROLE>\nTEXT</turn>\n ; a placeholder is <image N>,
# <audio N> or <document N>, N counting the turn's attachments from 0.
TURN_OPEN, TURN_MID, TURN_CLOSE = "<turn ", ">\n", "</turn>\n"

PART = ("struct<type:string,text:string,ref:string,width:bigint,height:bigint,"
        "seconds:double,pages:bigint>")
ATTACHMENT = "struct<placeholder:string,type:string,ref:string,n_tokens:bigint>"


def escape(text: Column) -> Column:
    """Control strings made harmless (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role also gives up ``>``, which ends its mark: written ``\\g``."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a.cast("double") / F.lit(b)).cast("bigint")


def part_tokens(part: Column, patch: int = 28, audio_per_second: int = 25,
                page_tokens: int = 512) -> Column:
    """Tokens that an attachment's placeholder expands to: image patches of
    ``patch`` pixels a side, audio frames, document pages; missing or negative
    measures count as the least, one token."""
    n = (F.when(part["type"] == "image",
                _ceil_div(part["width"], patch) * _ceil_div(part["height"], patch))
          .when(part["type"] == "audio",
                F.ceil(part["seconds"] * F.lit(audio_per_second)).cast("bigint"))
          .when(part["type"] == "document", part["pages"] * F.lit(page_tokens)))
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("bigint")


def flatten_parts(df: DataFrame, parts: str = "parts", **costs) -> DataFrame:
    """Add ``content`` (escaped text with placeholders, in order) and
    ``attachments`` (placeholder, type, ref, n_tokens) from an array of typed
    parts (``PART``). Null arrays and null parts are empty; null text is
    empty; a part of another type fails the job. Existing columns of the two
    names are replaced."""
    usable = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")),
                      lambda p: p.isNotNull())
    known = F.transform(usable, lambda p: F.when(
        F.coalesce(p["type"], F.lit("")).isin("text", "image", "audio", "document"), p).otherwise(
            F.raise_error(F.concat(F.lit("unknown part type: "),
                                   F.coalesce(p["type"], F.lit("null")))).cast(PART)))
    files = F.filter(known, lambda p: p["type"] != "text")
    # the place of a part among the attachments: those up to it, less itself
    numbered = F.transform(known, lambda p, i: F.struct(
        p.alias("p"), (F.size(F.filter(F.slice(known, 1, i), lambda q: q["type"] != "text")))
        .alias("n")))
    mark = lambda p, n: F.concat(F.lit("<"), p["type"], F.lit(" "),
                                 n.cast("string"), F.lit(">"))
    content = F.array_join(F.transform(numbered, lambda x: F.when(
        x["p"]["type"] == "text", escape(x["p"]["text"])).otherwise(mark(x["p"], x["n"]))), "")
    records = F.transform(files, lambda p, i: F.struct(
        mark(p, i).alias("placeholder"), p["type"].alias("type"), p["ref"].alias("ref"),
        part_tokens(p, **costs).alias("n_tokens")))
    return df.withColumns({"content": content, "attachments": records})


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", loss_roles: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation from flattened turns (``content`` and
    ``attachments`` of :func:`flatten_parts`): ``conv_id, formatted``,
    ``loss`` (array of start and length in code points of the text under the
    loss mask), ``attachments`` (with their turn's place) and
    ``attachment_tokens``.

    Turns are in the order of ``turn``, then role and content (ties and
    repeated rows are kept side by side); null turns come first, a null role
    is empty and roles are escaped like texts. Rows with a null conversation
    id form one conversation. A conversation is one training text, so its
    turns meet in one row; one shuffle by conversation does it all."""
    opening = F.concat(F.lit(TURN_OPEN), escape_role(F.col(role)), F.lit(TURN_MID))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), "content", "attachments",
        F.length(opening).cast("bigint").alias("head"),
        F.length("content").cast("bigint").alias("body"),
        F.concat(opening, F.col("content"), F.lit(TURN_CLOSE)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "conv_id", F.row_number().over(order).alias("place"), "role", "head", "body", "piece",
        "attachments", F.coalesce(F.sum(F.col("head") + F.col("body") + F.lit(len(TURN_CLOSE)))
                                  .over(before), F.lit(0)).alias("at"))
    kept = F.struct("place", "piece", F.when(F.col("role").isin(*loss_roles), F.struct(
        (F.col("at") + F.col("head")).alias("start"), F.col("body").alias("length")))
        .alias("span"), "attachments")
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t")["piece"], "").alias("formatted"),
        F.filter(F.col("t")["span"], lambda x: x.isNotNull()).alias("loss"),
        F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(
            i.cast("bigint").alias("turn_index"), a["placeholder"].alias("placeholder"),
            a["type"].alias("type"), a["ref"].alias("ref"),
            a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.col("t")["attachments"]), F.lit(0).cast("bigint"),
                    lambda n, a: n + a["n_tokens"]).alias("attachment_tokens"))


def parse_formatted(formatted: Column) -> Column:
    """The turns read back: ``array<struct<role, text>>`` (placeholders stay
    in the text as their marks)."""
    raw = F.split(formatted, TURN_CLOSE, -1)
    # the last piece is what follows the last mark: nothing
    turns = F.slice(raw, 1, F.size(raw) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(F.substr(t, F.lit(len(TURN_OPEN) + 1)), TURN_MID, 1))
        .alias("role"),
        unescape(F.substr(t, F.locate(TURN_MID, t) + F.lit(len(TURN_MID)))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
