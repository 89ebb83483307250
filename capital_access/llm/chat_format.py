"""Conversations as training text, with typed content parts and a loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from capital_access.functions.nulls import as_col

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Attachment kinds; each has its placeholder.
ATTACHMENTS = ("image", "audio", "document")

#: ``<`` and a control word, with any number of backslashes between them.
_CONTROL = r"<(\\*)(/?turn|image|audio|document)"
_ESCAPED = r"<\\(\\*)(/?turn|image|audio|document)"
_OPEN, _CLOSE = "<turn ", "\n</turn>\n"


@dataclass(frozen=True)
class TokenRule:
    """How many tokens a placeholder stands for; a missing or non-positive size counts as one unit."""

    tile: int = 336
    per_tile: int = 144
    per_image: int = 1
    per_second: float = 25.0
    per_page: int = 512


#: Characters of roles and their codes; the percent sign is first to go in and last to come out.
_ROLE_CODES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    """One more backslash in every control string: ``<turn`` to ``<\\turn``, ``<\\turn`` to ``<\\\\turn``; other text stays as it is."""
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def escape_role(role: Column) -> Column:
    """Percent signs, ``<``, ``>`` and line feeds as percent codes: a role ends at the first ``>`` and holds no mark of a turn."""
    for char, code in _ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def text_part(text: Column) -> Column:
    """The parts of a plain text turn: one of kind text; a missing text is empty."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"))
    return F.array(F.struct(part["kind"].alias("kind"), part["text"].alias("text"), *(
        F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(list(ATTACHMENTS)), F.lit(False))


def _visit(part: Column) -> Column:
    """What a part becomes in the text: an attachment its placeholder, anything else its escaped text."""
    return F.when(_is_attachment(part), F.concat(F.lit("<"), part["kind"], F.lit(">"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _positive(size: Column, least: float = 1) -> Column:
    return F.greatest(F.coalesce(size, F.lit(least)), F.lit(least))


def _tokens(part: Column, rule: TokenRule) -> Column:
    """Tokens that the placeholder of an attachment expands to."""
    def tiles(size: Column) -> Column:
        return F.ceil(_positive(size) / rule.tile)

    return (
        F.when(part["kind"] == "image", rule.per_image + tiles(part["width"]) * tiles(part["height"]) * rule.per_tile)
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * rule.per_second))
        .otherwise(_positive(part["pages"]) * rule.per_page).cast("long"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                         trained_roles: tuple[str, ...] = ("assistant",), rule: TokenRule = TokenRule()) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, n_turns, n_text_tokens, n_attachment_tokens.

    ``turns`` has a row per turn; its parts (``PART_TYPE``) are visited in order
    and set one to a line. A turn reads ``<turn ROLE>``, a line feed, its parts,
    a line feed, ``</turn>``, a line feed. Control strings inside texts and roles
    are escaped so that :func:`read_turns` gives back what was put in.

    ``loss_mask`` lists (start, end) in code points of ``formatted``, the end
    exclusive, for each text part of a trained role. ``attachments`` lists the
    others in the order of their placeholders: place among them, turn, kind,
    ref, tokens. Text tokens are runs of letters and digits, and single marks.

    Turns sort by ``turn_col`` (missing first), repeated ones by role and parts
    too. A missing role or text is empty, no parts are one empty line; a part of
    an unknown kind counts as text. Rows without a conversation id are a
    conversation. No other column is read. An empty table stays empty.

    A conversation is one text, so its turns meet in one row: one shuffle, and
    the offsets of turns come from a running sum in the same partitioning. What
    limits a conversation is the size of a text value; equal conversations stay
    apart, so a much repeated one burdens no task.
    """
    parts = F.coalesce(as_col(parts_col), F.array().cast(f"array<{PART_TYPE}>"))
    role = F.coalesce(as_col(role_col), F.lit(""))
    read = turns.select(as_col(conv_col).alias("conv_id"), as_col(turn_col).alias("turn"), role.alias("role"),
                        F.transform(parts, _visit).alias("lines"), parts.alias("parts"))
    head = F.concat(F.lit(_OPEN), escape_role(F.col("role")), F.lit(">\n"))
    ahead = F.transform("lines", lambda _, k: F.aggregate(F.slice("lines", F.lit(1), k), F.lit(0), lambda n, line: n + F.length(line) + 1))
    kinds = F.transform("parts", lambda p: F.struct(
        _is_attachment(p).alias("attached"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p, rule).alias("tokens")))
    pieces = read.select(
        "conv_id", "turn", "role", "lines", kinds.alias("kinds"), head.alias("head"), ahead.alias("ahead"),
        F.concat(head, F.array_join("lines", "\n"), F.lit(_CLOSE)).alias("piece"))
    in_turn = F.transform(F.arrays_zip("lines", "kinds", "ahead"), lambda x: F.struct(
        x["kinds"]["attached"].alias("attached"), (F.length("head") + x["ahead"]).cast("long").alias("start"),
        (F.length("head") + x["ahead"] + F.length(x["lines"])).cast("long").alias("end")))
    local = F.when(F.col("role").isin(list(trained_roles)), F.filter(in_turn, lambda s: ~s["attached"])).otherwise(F.array().cast(
        "array<struct<attached:boolean,start:bigint,end:bigint>>"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    words = F.aggregate(F.filter(F.arrays_zip("lines", "kinds"), lambda x: ~x["kinds"]["attached"]), F.lit(0).cast("long"),
                        lambda n, x: n + F.regexp_count(x["lines"], F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")))
    placed = (
        pieces.withColumns({"spans": local, "words": words, "attached": F.filter("kinds", lambda k: k["attached"])})
        .withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)).cast("long"))
        .withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end"))))
        .withColumn("attached", F.transform("attached", lambda a: F.struct(
            F.col("turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "piece", "spans", "attached"))).alias("turns"),
        F.count("*").alias("n_turns"), F.sum("words").alias("n_text_tokens"))
    attachments = F.transform(F.flatten("turns.attached"), lambda a, k: F.struct(
        (k + 1).alias("place"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return whole.select(
        "conv_id", F.array_join("turns.piece", "").alias("formatted"), F.flatten("turns.spans").alias("loss_mask"), attachments.alias("attachments"),
        "n_turns", "n_text_tokens").withColumn(
        "n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation, unescaped; placeholders stay in the text.

    Only a real turn begins with the opening mark, as texts and roles have it escaped.
    """
    def back(piece: Column) -> Column:
        role = F.substring_index(piece, ">", 1)
        body = F.substring(piece, F.length(role) + 3, F.length(piece) - F.length(role) - 2 - len(_CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.filter(F.split(formatted, _OPEN), lambda _, k: k > 0), back)


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the mask, unescaped, in order."""
    return F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
