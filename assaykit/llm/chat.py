"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of a conversation in order of ``seq``: ``message`` starts a message,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` throws its text away
so that later deltas start afresh, and ``delete`` removes it.  Events name their message;
a message stands where its first event stands.  Folding an event log gives the final
messages; rendering joins them by a template that marks turns, and escapes the control
strings that texts contain, so that the output can be read back.

Folding is done per message and rendering per run of ``PIECE`` messages before a
conversation is put together, so a very long conversation arrives in few rows.

Cases: null texts and roles are empty; a null conversation id is a conversation of its
own; null ``seq`` sorts first; events of equal ``seq`` are ordered by message, operation, role
and text; repeated events are applied again.  Other columns are ignored.  An empty log
gives no rows.
"""

from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>"
# Control strings of common chat templates, which a text may hold.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|<SYS>>|\|im_start\|>|\|im_end\|>))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|<SYS>>|\|im_start\|>|\|im_end\|>))"
TRAINED = "assistant"
PIECE = 256


def escaped(text):
    """Each control string gets one more backslash after its first character."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text):
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_shown(role):
    """Roles have no line break and no bracket once rendered."""
    shown = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(shown, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_read(role):
    read = F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<"))
    return F.replace(read, F.lit("%25"), F.lit("%"))


def fold(events, conversation="conv_id", seq="seq", message="message_id", op="op", role="role", text="text"):
    """``(conv_id, place, message_id, role, text)``: the final messages of an event log.

    The role is that of the first event that gives one; unknown operations raise.
    """
    known = F.col(op).isin("message", "delta", "edit", "regenerate", "delete")
    checked = F.when(known, F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(F.col(op), F.lit("null")))))
    event = F.struct(
        F.col(seq).alias("seq"), checked.alias("op"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    grouped = events.groupBy(F.col(conversation).alias("conv_id"), F.col(message).alias("message_id")).agg(
        F.sort_array(F.collect_list(event)).alias("log")
    )
    # The last event that replaces the text, and what was appended since.
    resets = F.transform("log", lambda e, i: F.when(e["op"] != "delta", i + 1))
    last = F.coalesce(F.array_max(resets), F.lit(1))
    tail = F.slice("log", last, F.size("log") - last + 1)
    kept = F.filter(tail, lambda e: ~e["op"].isin("regenerate", "delete"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    folded = grouped.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("place"),
        "message_id",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
        (F.element_at(tail, 1)["op"] == "delete").alias("deleted"),
    )
    return folded.filter(~F.col("deleted")).drop("deleted")


def turns(conversations, conversation="conv_id", turn="turn", role="role", text="text"):
    """A table with a row per turn as messages: nothing to fold, so no shuffle."""
    return conversations.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("place"),
        F.lit(None).cast("long").alias("message_id"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def as_events(conversations, conversation="conv_id", turn="turn", role="role", text="text"):
    """A table with a row per turn as an event log: each row a message event of its own.

    Rows that share a turn are told apart by role and text; rows equal in all of it stay
    separate messages through their number.
    """
    key = [F.col(conversation).alias("conv_id"), F.col(turn).alias("seq"), F.col(role).alias("role"), F.col(text).alias("text")]
    rows = conversations.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(
        "conv_id", "seq", F.struct("seq", "role", "text", "copy").alias("message_id"), F.lit("message").alias("op"), "role", "text"
    )


def render(messages, trained=TRAINED, piece=PIECE):
    """``(conv_id, n_turns, formatted, mask)``; ``mask`` lists ``(start, length)`` of trained text, from 0.

    ``mask`` is in code points of ``formatted``, escapes included.
    """
    head = F.concat(F.lit(START), _role_shown(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    shown = F.concat(head, body, F.lit(END))
    marked = messages.select(
        "conv_id",
        F.struct("place", "message_id", "role", "text").alias("at"),
        shown.alias("shown"),
        F.length(head).alias("lead"),
        F.when(F.col("role") == trained, F.length(body)).alias("trained"),
    )
    one = F.struct("at", "shown", F.length("shown").alias("length"), "lead", "trained")
    run = F.floor(F.coalesce(F.col("at.place"), F.lit(-1)) / piece)
    pieces = marked.groupBy("conv_id", run.alias("run")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    pieces = pieces.select(
        "conv_id",
        "run",
        F.size("all").cast("long").alias("n"),
        F.array_join(F.transform("all", lambda m: m["shown"]), "").alias("shown"),
        _offsets("all").alias("spans"),
    )
    whole = F.struct("run", "n", "shown", F.length("shown").alias("length"), "spans")
    grouped = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(whole)).alias("all"))
    spans = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["length"]).alias("at"),
            F.concat(
                acc["out"],
                F.transform(p["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return grouped.select(
        "conv_id",
        F.aggregate("all", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.array_join(F.transform("all", lambda p: p["shown"]), "").alias("formatted"),
        spans.alias("mask"),
    )


def _offsets(name):
    """Spans of trained text in the joined texts of an array of messages."""
    return F.aggregate(
        name,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["length"]).alias("at"),
            F.when(m["trained"].isNull(), acc["out"])
            .otherwise(
                F.concat(acc["out"], F.array(F.struct((acc["at"] + m["lead"]).alias("start"), m["trained"].alias("length"))))
            )
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )


def parsed(formatted="formatted"):
    """The turns read back from formatted text: an array of ``(role, text)``."""
    parts = F.split(F.col(formatted), r"<\|im_end\|>")
    texts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(t):
        body = F.substr(t, F.lit(len(START) + 1))
        at = F.position(F.lit(MIDDLE), body)
        return F.struct(
            _role_read(F.substr(body, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(body, at + 1)).alias("text")
        )

    return F.transform(texts, turn)


def masked(formatted="formatted", mask="mask"):
    """All text under the loss mask, unescaped and joined."""
    under = F.transform(mask, lambda s: unescaped(F.substr(F.col(formatted), s["start"] + 1, s["length"])))
    return F.array_join(under, "")
