r"""Chat formatting by event-sourced reconstruction.

A log holds events ``conv_id, seq, message, kind, role, text``; kinds are ``delta`` (text is appended), ``edit`` (text
replaces what the message holds), ``regenerate`` (the message starts again, with this text), and ``delete``. Logs are
dealt by conversation and sorted by sequence; a message is what its last edit, regeneration or deletion left and the
deltas after it. Messages are then rendered, in order, as::

    <turn ROLE>
    TEXT</turn>

Control strings inside a text are escaped reversibly: ``<turn`` and ``</turn``, with any number of backslashes after
``<``, get one backslash more there; reading back takes one away. No other text is changed. Roles escape ``\`` and ``>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm._session import pinned

TERMINATOR = "</turn>\n"
#: Kinds of events that replace all that came before in a message.
RESETS = ("edit", "regenerate", "delete")
LEARN_FROM = ("assistant",)
_HEAD = "<turn "
#: Turns whose lengths are summed at once.
_BLOCK = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of a log; deleted ones are gone.

    A null text counts as empty, a null role as empty, a null kind as ``delta``; null conversations, messages and
    sequence numbers are values of their own, nulls first. Equal sequence numbers within a message are taken in order of
    kind, role and text. The role is that of the message's last event that counts. ``message`` may be of any type that
    has an order. One shuffle by (conv_id, message): a conversation of any length is folded by many tasks.
    """
    e = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "kind", "role", "text")
    of_message = Window.partitionBy("conv_id", "message")
    e = e.withColumn("last_reset", F.max(F.when(F.col("kind").isin(*RESETS), order)).over(of_message))
    e = e.where(F.col("last_reset").isNull() | (order >= F.col("last_reset")))
    return (
        e.groupBy("conv_id", "message")
        .agg(F.sort_array(F.collect_list(order)).alias("log"))
        .where(F.expr("log[0].kind <> 'delete' OR size(log) > 1"))
        .select("conv_id", "message", F.expr("log[size(log) - 1].role").alias("role"), F.expr("array_join(transform(log, e -> IF(e.kind = 'delete', '', e.text)), '')").alias("text"))
    )


def render(messages: DataFrame, learn_from: tuple[str, ...] = LEARN_FROM) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` are (turn, start, end) of the texts in ``formatted`` that are learned from, those of ``learn_from``
    roles, in order: the turn's number from 1 and code points, end exclusive. Messages are ordered by ``message``, then
    role and text. A conversation becomes one value, so it must fit a row, as any training example must.
    """
    head = F.concat(F.lit(_HEAD), _escape_role(F.col("role")), F.lit(">\n"))
    m = messages.select("conv_id", "message", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("turn", F.concat("head", "body", F.lit(TERMINATOR)))
    in_order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    m = m.withColumn("n", F.row_number().over(in_order))
    m = m.withColumn("end", F.sum(F.char_length("turn").cast("bigint")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - len(TERMINATOR))
    span = F.when(F.col("role").isin(*learn_from), F.struct(F.col("n").alias("turn"), (F.col("end") - F.char_length("body")).alias("start"), "end"))
    return (
        m.withColumn("span", span)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "turn", "span"))).alias("turns"))
        .select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.expr("filter(turns.span, s -> s IS NOT NULL)").alias("loss_spans"))
    )


def read_back(formatted: DataFrame, learn_from: tuple[str, ...] = LEARN_FROM) -> DataFrame:
    """``conv_id, formatted, turns, loss_text`` out of a rendering.

    ``turns`` (role, text) are parsed from ``formatted`` alone. ``loss_text`` is what lies in ``formatted`` under
    ``loss_spans``, cut out by their places and unescaped. The mask is checked against what was parsed: an error is
    raised unless it has one span for each turn of a ``learn_from`` role, in order, that begins and ends where the turn's
    text does.
    """
    f = formatted.withColumn("_turns", pinned(F.split("formatted", TERMINATOR, -1)))
    f = f.withColumn("_turns", pinned(F.expr("slice(_turns, 1, size(_turns) - 1)")))
    f = f.withColumn("_parts", pinned(F.expr("transform(_turns, t -> split(t, '>\\n', 2))")))
    f = f.withColumn("_roles", pinned(F.transform("_parts", lambda p: _unescape_role(F.substr(p[0], F.lit(len(_HEAD) + 1))))))
    turns = F.transform("_parts", lambda p, i: F.struct(F.get("_roles", i).alias("role"), unescape(p[1]).alias("text")))
    # where a turn begins: the lengths of whole blocks of turns before it, then of those before it in its own block
    length, whole = f"(a, t) -> a + char_length(t) + {len(TERMINATOR)}", f"cast(size(_turns) AS int) div {_BLOCK}"
    f = f.withColumn("_blocks", pinned(F.expr(f"CASE WHEN {whole} = 0 THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, cast({whole} AS int)), b -> aggregate(slice(_turns, (b - 1) * {_BLOCK} + 1, {_BLOCK}), 0L, {length})) END")))
    begin = f"aggregate(slice(_blocks, 1, cast((s.turn - 1) div {_BLOCK} AS int)), 0L, (a, x) -> a + x) + aggregate(slice(_turns, cast((s.turn - 1) div {_BLOCK} AS int) * {_BLOCK} + 1, cast((s.turn - 1) % {_BLOCK} AS int)), 0L, {length})"
    f = f.withColumn("_learned", pinned(F.expr(f"transform(loss_spans, s -> named_struct('turn', cast(s.turn AS int), 'from', s.start - ({begin}), 'length', s.end - s.start))")))
    wanted = ", ".join("'" + r.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in learn_from)
    of_roles = F.expr(f"filter(transform(_roles, (r, i) -> IF(r IN ({wanted}), i + 1, 0)), n -> n > 0)") if learn_from else F.expr("cast(array() AS array<int>)")
    right = F.expr(f"forall(_learned, s -> s.from = char_length(get(_parts, s.turn - 1)[0]) + {len('>') + 1} AND s.from + s.length = char_length(get(_turns, s.turn - 1)))")
    mask = F.when((F.col("_learned.turn") == of_roles) & right, F.expr("transform(_learned, s -> substr(get(_turns, s.turn - 1), cast(s.from AS int) + 1, cast(s.length AS int)))"))
    cut = F.coalesce(mask, F.raise_error(F.lit("the loss mask does not cover the texts that are learned from")).cast("array<string>"))
    return f.select("conv_id", "formatted", turns.alias("turns"), F.array_join(F.transform(cut, unescape), "").alias("loss_text"))
