"""Conversations as training text: roles checked by a finite-state machine, segments with loss flags.

A declarative template says how a turn of each role is opened and closed, which roles are learnt from and
which role may follow which. A turn becomes three segments (opening, text, closing), and only the texts
of learnt roles carry the loss flag. Control strings inside texts are cut by an escape after their
first character, so none is left in an escaped text; as no control string overlaps another or
itself, the formatted text can be split at them and read back exactly.

The machine reads a conversation in pieces: a piece knows for every state in which state it ends and
where it breaks, and pieces are chained. So turns are dealt out by (conversation, turn), a long conversation
to many tasks, and only pieces that are formatted already meet in the conversation's row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"
#: The machine's state before the first turn, and the one that a turn out of order leads to for good.
START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """How turns are written. A state is the role of the turn before; ``ends`` are those in which a conversation may end."""

    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>"
    after: str = "\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learnt: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("tool", "assistant")}
    )
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for a in self.controls:
            if len(a) < 2 or ESCAPE in a or any(a[-k:] == b[:k] for b in self.controls for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"control strings must have two characters, no escape and no overlap: {a!r}")
        if any(self.named in x or x.startswith("@") for x in self.labels.values()):
            raise ValueError("labels may not hold what ends them, nor begin with @")

    @property
    def controls(self) -> tuple[str, str]:
        return self.opening, self.closing

    @property
    def states(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.follows, *(r for to in self.follows.values() for r in to), BROKEN]))

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(2 * ESCAPE))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
        return text

    def plain(self, text: Column) -> Column:
        """What ``escaped`` was given."""
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def label(self, role: Column) -> Column:
        """The label of a known role, else @ and the role in hex."""
        label = F.concat(F.lit("@"), F.hex(F.encode(role, "UTF-8")))
        for known, name in self.labels.items():
            label = F.when(role == known, F.lit(name)).otherwise(label)
        return label

    def role(self, label: Column) -> Column:
        role = F.decode(F.unhex(F.substring(label, 2, 2**31 - 1)), "UTF-8")
        for known, name in self.labels.items():
            role = F.when(label == name, F.lit(known)).otherwise(role)
        return role

    def segments(self, turn: Column) -> Column:
        opening = F.concat(F.lit(self.opening), self.label(turn["role"]), F.lit(self.named))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(self.escaped(turn["text"]), turn["role"].isin(*self.learnt)), part(F.lit(self.closing + self.after), F.lit(False)))

    def moved(self, turns: Column, state: str) -> Column:
        """(state, bad): where the machine is after ``turns`` from ``state``, and the number of the turn that broke it."""
        moves = F.create_map(*[F.lit(x) for a, to in self.follows.items() for b in to for x in (f"{a}>{b}", b)])
        first = F.struct(F.lit(state).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))

        def step(at: Column, turn: Column) -> Column:
            to = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit(">"), turn["role"])), F.lit(BROKEN))
            return F.struct(to.alias("state"), F.coalesce(at["bad"], F.when(to == BROKEN, at["n"])).alias("bad"), (at["n"] + 1).alias("n"))

        return F.aggregate(turns, first, step)


CHAT = Template()


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, in_order, bad_turn, formatted, segments (array of text, loss).

    ``segments`` joined are ``formatted``. ``in_order`` tells whether the machine accepts the roles, ``bad_turn`` which
    turn (from 0) it does not take; such conversations are formatted all the same. Turns go by number, nulls first,
    those of equal number by role and text; repeated rows are turns of their own. A null text is an empty one, so is a
    null role, and unknown roles keep their names. Null ids are one conversation. Other columns are ignored; empty in, empty out.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text")).repartitionByRange("conv_id", "turn", "role", "text")
    pieces = turns.groupBy("conv_id", F.spark_partition_id().alias("piece")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = pieces.select(
        "conv_id", F.array_min("turns").alias("first"), F.size("turns").alias("n"), F.flatten(F.transform("turns", template.segments)).alias("segments"),
        F.array(*[template.moved(F.col("turns"), s) for s in template.states]).alias("moves"),
    )
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first.turn", "first.role", "first.text", "n", "segments", "moves"))).alias("pieces"))

    def chained(at: Column, piece: Column) -> Column:
        move = F.get(piece["moves"], F.array_position(F.lit(list(template.states)), at["state"]).cast("int") - 1)
        return F.struct(move["state"].alias("state"), F.coalesce(at["bad"], at["n"] + move["bad"]).alias("bad"), (at["n"] + piece["n"]).alias("n"))

    first = F.struct(F.lit(START).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    read = whole.select("conv_id", F.aggregate("pieces", first, chained).alias("end"), F.flatten(F.transform("pieces", lambda p: p["segments"])).alias("segments"))
    return read.select(
        "conv_id", F.col("end.n").cast("long").alias("n_turns"), F.col("end.state").isin(*template.ends).alias("in_order"), F.col("end.bad").cast("long").alias("bad_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
    )


def parsed(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a ``formatted`` text."""
    parts = F.split(text, r"\Q" + template.closing + template.after + r"\E")
    head = F.length(F.lit(template.opening))

    def turn(part: Column) -> Column:
        named = F.locate(template.named, part)
        label = F.substr(part, head + 1, named - head - 1)
        return F.struct(template.role(label).alias("role"), template.plain(F.substr(part, named + len(template.named))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


#: A conversation that the query adds: both turns hold what looks like the template's own strings.
HOSTILE = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and digests of what is read back from that; odd rows as in ``formatted``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    out = formatted(rows.unionByName(added))
    turns = out.select("conv_id", "in_order", "bad_turn", "formatted", parsed(F.col("formatted")).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("learnt"))
    loss = F.array_join(F.transform("learnt", lambda s: CHAT.plain(s["text"])), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return turns.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "in_order", "bad_turn",
    )


#: Written from the turns directly: what is read back must equal what went in. The machine's verdict is the first turn that its predecessor doesn't allow.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
placed AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS is_last FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
written AS (SELECT *,
  '### ' || CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN upper(role[1]) || role[2:] ELSE '@' || hex(encode(role)) END || ': '
    || replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') || '</turn>' || chr(10) AS line,
  coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant') AS allowed
  FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars, bool_and(allowed) AND max_by(role, i) = 'assistant' AS in_order, min(i - 1) FILTER (NOT allowed) AS bad_turn
FROM written GROUP BY conv_id
"""

QUERIES = {"op12_chat_format": op12_chat_format}
ORACLES = {"op12_chat_format": SQL}
