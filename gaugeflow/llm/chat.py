"""Conversations of typed content parts as training texts, and back.

A visitor flattens the parts of every turn in order: text is escaped, an image, audio or
document part becomes a placeholder, and its reference, place and expanded number of
tokens are recorded. All of it is column expressions; turns and parts stay rows until
the text of a conversation is put together.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Control strings of common chat formats.
COMMON_CONTROLS = (
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
)

#: Schema of one content part. ``kind`` is text, image, audio or document.
PART = (
    "struct<kind: string, text: string, uri: string, width: int, height: int, "
    "seconds: double, pages: int>"
)


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of turns and placeholders, and the strings that no text may hold unescaped.

    A turn is ``opens`` role ``says`` body ``closes``. Role and body are escaped: a mark of
    ``escape`` goes behind the first character of every control string and is doubled where
    the text itself has it. So a control string in the formatted text is always the
    template's own, and dropping the marks gives the text back.
    """

    opens: str = "<|turn|>"
    says: str = "<|says|>"
    closes: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    escape: str = "␛"
    others: tuple[str, ...] = COMMON_CONTROLS
    #: Roles whose bodies are under the loss mask.
    learnt: tuple[str, ...] = ("assistant",)
    #: An image's tokens are its patches of so many pixels, an audio part's are these per
    #: second, a document's these per page; parts without a size count as one unit.
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024

    def __post_init__(self):
        if len(self.escape) != 1:
            raise ValueError("escape must be one character")
        for c in self.controls:
            if len(c) < 2 or self.escape in c:
                raise ValueError(f"{c!r} must have two characters or more and not the escape")
            if any(c[:n] == c[-n:] for n in range(1, len(c))):
                raise ValueError(f"{c!r} begins as it ends, so it could not be found again")

    @property
    def controls(self) -> tuple[str, ...]:
        own = (self.opens, self.says, self.closes, self.image, self.audio, self.document)
        return tuple(dict.fromkeys(own + self.others))

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(doubled, starts, "$0\\" + self.escape)

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, re.escape(self.escape) + r"([\s\S])", "$1")


TEMPLATE = ChatTemplate()


def _field(part: Column, name: str, present: set[str], kind: str) -> Column:
    return part[name] if name in present else F.lit(None).cast(kind)


def _visit(parts: Column, present: set[str], template: ChatTemplate) -> Column:
    """The parts of a turn as pieces: struct<kind, piece, uri, tokens>, in order.

    Kinds are compared in lower case; a missing or other kind is text. A text that follows
    another text gets a mark in front, lest both together spell a control string.
    """

    def kind(part: Column) -> Column:
        named = F.lower(_field(part, "kind", present, "string"))
        return F.when(named.isin("image", "audio", "document"), named).otherwise("text")

    def units(amount: Column) -> Column:
        return F.greatest(F.coalesce(amount, F.lit(1)), F.lit(1)).cast("long")

    def visit(part: Column, i: Column) -> Column:
        text = template.escaped(F.coalesce(_field(part, "text", present, "string"), F.lit("")))
        before = F.when(i > 0, kind(F.get(parts, i - 1)))
        split = (before == "text") & (F.length(text) > 0) & ~F.startswith(text, F.lit(template.escape))
        own = kind(part)
        width, height = (_field(part, n, present, "int") for n in ("width", "height"))
        patches = F.ceil(width / template.patch) * F.ceil(height / template.patch)
        seconds = F.ceil(_field(part, "seconds", present, "double") * template.per_second)
        pages = _field(part, "pages", present, "int").cast("long") * template.per_page
        return F.struct(
            own.alias("kind"),
            F.when(own == "image", F.lit(template.image))
            .when(own == "audio", F.lit(template.audio))
            .when(own == "document", F.lit(template.document))
            .otherwise(F.when(split, F.concat(F.lit(template.escape), text)).otherwise(text))
            .alias("piece"),
            F.when(own != "text", _field(part, "uri", present, "string")).alias("uri"),
            F.when(own == "image", units(patches))
            .when(own == "audio", units(seconds))
            .when(own == "document", units(pages))
            .alias("tokens"),
        )

    return F.transform(parts, visit)


def format_chat(rows: DataFrame, template: ChatTemplate = TEMPLATE, content: str | None = None) -> DataFrame:
    """Every conversation as one text.

    ``rows`` has conv_id, turn, role and either ``text`` or, named by ``content``, an array
    of parts (structs with any of the fields of ``PART``). Returns conv_id, n_turns,
    ``formatted``, ``loss`` (for every turn where it begins, and start and end of its body if
    that is to learn, else null, all in code points), ``attachments`` (an array of turn, part,
    kind, uri, at (code point of the placeholder), tokens) and ``expanded_tokens`` (their
    sum), in the order of the text.

    Turns stand in the order of turn, nulls first, then role and content; ``turn`` in
    the attachments counts them from 0. A repeated row is a turn of its own, a null text
    or content an empty body, a null role the empty role. Rows without conv_id are one
    conversation. Other columns are left out. An empty table gives no rows. A conversation
    is one value of the result, so it must fit in one (2 GB); it is put together from
    sorted rows that can spill.
    """
    if content is None:
        body, present = F.array(F.struct(F.col("text").cast("string").alias("text"))), {"text"}
    else:
        body, present = F.col(content), set(rows.schema[content].dataType.elementType.names)
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), body.alias("body"))
    at_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    numbered = turns.select("conv_id", "role", "body", (F.row_number().over(at_turn) - 1).alias("no"))

    def mark(kind: str, piece: Column) -> Column:
        nothing = (F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("tokens"))
        return F.array(F.struct(F.lit(kind).alias("kind"), piece.alias("piece"), *nothing))

    head = F.concat(F.lit(template.opens), template.escaped(F.col("role")), F.lit(template.says))
    visited = F.coalesce(_visit(F.col("body"), present, template), mark("text", F.lit("")))
    pieces = numbered.select(
        "conv_id",
        "no",
        F.col("role").isin(*template.learnt).alias("learnt"),
        F.posexplode(F.concat(mark("head", head), visited, mark("close", F.lit(template.closes)))).alias("part", "p"),
    ).select("conv_id", "no", "part", "learnt", "p.*")
    order = Window.partitionBy("conv_id").orderBy("no", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("*", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)).alias("at"))
    kind = F.col("kind")
    begins = F.struct("no", "at", F.when(F.col("learnt"), F.col("at") + F.length("piece")).alias("start"))
    ends = F.struct("no", F.when(F.col("learnt"), F.col("at")).alias("end"))
    attachment = F.struct("no", (F.col("part") - 1).alias("part"), "kind", "uri", "at", "tokens")

    def rows_of(which: Column, row: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(which, row)))

    gathered = placed.groupBy("conv_id").agg(
        F.sum((kind == "close").cast("long")).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("no", "part", "piece"))).alias("pieces"),
        rows_of(kind == "head", begins).alias("begins"),
        rows_of(kind == "close", ends).alias("ends"),
        rows_of(~kind.isin("head", "text", "close"), attachment).alias("found"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("expanded_tokens"),
    )
    span = F.zip_with("begins", "ends", lambda a, b: F.struct(a["at"].alias("at"), a["start"].alias("start"), b["end"].alias("end")))
    attachments = F.transform(
        "found",
        lambda a: F.struct(a["no"].alias("turn"), a["part"].alias("part"), *[a[c].alias(c) for c in ("kind", "uri", "at", "tokens")]),
    )
    return gathered.select(
        "conv_id",
        "n_turns",
        F.array_join("pieces.piece", "").alias("formatted"),
        span.alias("loss"),
        attachments.alias("attachments"),
        "expanded_tokens",
    )


def read_chat(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Roles and texts read back from what ``format_chat`` gives.

    Returns conv_id, formatted, ``turns`` (array of role and text, unescaped, placeholders
    as they stand) and ``learnt`` (array of the texts under the loss mask, unescaped).
    Every turn is cut out of its own piece of the text, so the work is in proportion to it.
    """
    closed = F.split("formatted", re.escape(template.closes), -1)
    own = F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0)))  # nothing is behind the last

    def turn(piece: Column) -> Column:
        cut = F.locate(template.says, piece)
        role = F.substring(piece, F.lit(len(template.opens) + 1), cut - len(template.opens) - 1)
        text = F.substring(piece, cut + len(template.says), F.length(piece))
        return F.struct(template.unescaped(role).alias("role"), template.unescaped(text).alias("text"))

    def learnt(piece: Column, span: Column) -> Column:
        first = (span["start"] - span["at"] + 1).cast("int")
        return template.unescaped(F.substring(piece, first, (span["end"] - span["start"]).cast("int")))

    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(own, turn).alias("turns"),
        F.filter(F.zip_with(own, "loss", learnt), lambda x: x.isNotNull()).alias("learnt"),
    )
