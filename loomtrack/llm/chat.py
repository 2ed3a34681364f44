"""Chat formatting with Spark expressions only.

A conversation becomes ``<s>`` + blocks + ``</s>``; a block is
``<|turn|>role<|text|>text<|end|>`` and adjacent turns of one role share a block, their
texts separated by ``<|also|>``. A control string inside a role or text is broken by a
backslash behind its first character (one more, where some stand there already), which
``unescape`` takes out again; other text is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, FINISH, TURN, TEXT, ALSO, END = "<s>", "</s>", "<|turn|>", "<|text|>", "<|also|>", "<|end|>"
#: What may follow the first character of a control string: of this template, and of other common ones.
_AFTER_ANGLE = r"/?s>|\|(?:turn|text|also|end|im_start|im_end|endoftext)\||</?SYS>>"
_AFTER_BRACKET = r"/?INST\]"
_ESCAPE = rf"(<)(\\*)({_AFTER_ANGLE})|(\[)(\\*)({_AFTER_BRACKET})"
_UNESCAPE = rf"(<)\\(\\*)({_AFTER_ANGLE})|(\[)\\(\\*)({_AFTER_BRACKET})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1$4\\$2$5$3$6"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit(r"$1$4$2$5$3$6"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    ``loss_spans`` lists start (from 0) and length, in code points of ``formatted``, of
    each text of ``learn_role``. Turns are ordered by (turn, role, text), nulls first, so ties
    and repeated rows have one defined order and all are kept. Null roles and texts count
    as empty; rows with a null conversation form one conversation of their own. An empty
    table gives an empty result.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = turns.select(F.col(conv_id).alias(conv_id), one.alias("t")).groupBy(conv_id).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    safe = ordered.select(conv_id, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("mark"), escape(t["text"]).alias("text"))).alias("turns"))
    # each turn beside the role before it: a turn of the same role goes on with the block, another opens a new one
    roles = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda t: t["role"]))
    opened = lambda t: F.concat(F.lit(TURN), t["mark"], F.lit(TEXT))
    lead = lambda t, before: F.when(before.isNull(), opened(t)).when(before == t["role"], F.lit(ALSO)).otherwise(F.concat(F.lit(END), opened(t)))
    pieces = safe.select(conv_id, F.zip_with("turns", roles, lambda t, before: F.struct(lead(t, before).alias("lead"), t["text"].alias("text"), (t["role"] == learn_role).alias("learn"))).alias("pieces"))
    sized = pieces.select(conv_id, "pieces", F.transform("pieces", lambda p: (F.length(p["lead"]) + F.length(p["text"])).cast("long")).alias("lengths"))
    # the length of all pieces before each, summed in parts of about the root of their number, so that no long array is copied at each step
    width = F.greatest(F.ceil(F.sqrt(F.size("lengths"))), F.lit(1)).cast("int")
    running = lambda values: F.aggregate(values, F.array(F.lit(0).cast("long")), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))
    parted = sized.select(conv_id, "pieces", F.transform(F.sequence(F.lit(0), F.ceil(F.size("lengths") / width).cast("int") - 1), lambda k: running(F.slice("lengths", k * width + 1, width))).alias("parts"))
    summed = parted.select(conv_id, "pieces", "parts", running(F.transform("parts", lambda p: F.element_at(p, -1))).alias("starts"))
    before = F.flatten(F.zip_with("parts", F.slice("starts", F.lit(1), F.size("starts") - 1), lambda sums, start: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda x: x + start)))
    span = lambda p, at: F.struct((F.lit(len(BEGIN)) + at + F.length(p["lead"])).cast("long").alias("start"), F.length(p["text"]).cast("long").alias("length"), p["learn"].alias("learn"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END + FINISH))
    spans = F.filter(F.zip_with("pieces", before, span), lambda s: s["learn"])
    return summed.select(conv_id, formatted.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def read_chats(chats: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds ``turns``, the (role, text) pairs read back from the formatted text."""
    body = F.expr(f"substring({formatted}, {len(BEGIN) + 1}, length({formatted}) - {len(BEGIN) + len(FINISH)})")
    found = F.split(body, r"<\|turn\|>")
    blocks = F.slice(found, F.lit(2), F.size(found) - 1)

    def turns_of(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        texts = F.split(F.regexp_replace(parts[1], F.lit(r"<\|end\|>\z"), F.lit("")), r"<\|also\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return chats.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
