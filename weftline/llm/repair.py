"""Conversation structure repair by a fold over turns.

Window functions give each row of a conversation its place and its first fault.
The turns of a conversation, a few bytes each and without their texts, are
collected in order, and ``aggregate()`` carries four (cost, audit) structs over
them, one for each state of the roles put out so far:

* 0 nothing, 1 a system turn alone, 2 the last is a user, 3 the last is an assistant.

A state's cheapest edits, and of these the ASCII-least, come from native
``least`` over structs. Two edit strings over the same turns that cost the same
are never one the beginning of the other, because what the other has more of
costs something; so what is least now stays least, whatever follows.

A conversation of more than ``BLOCK`` turns is folded in blocks: each later block
is folded from all four states, which gives a table of four times four structs,
and a second fold joins the tables. No array holds more than a block's turns or
a conversation's tables. Texts meet their edits by (conversation, place) and are
hashed as a stream of sorted rows, one at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Turns of one fold.
BLOCK = 2_048
#: Beyond any cost: a state that can't be reached.
NEVER = 1 << 60
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32(``conv_id:turn``) % 20; a null is one space in that key, in role and in text.

    0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the
    row, 4 sets the role to user. Ids and turns keep their nulls.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20)
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows with ``at`` (1, 2, ... by turn with nulls first, then role and text), ``fault`` and ``illegal``.

    fault is the first that holds: b, blank (no character but white space); d,
    duplicate (role and text as in an earlier row); t, truncated (the last
    character that isn't white space is none of ``.!?``); else an empty string.
    illegal says that the initials of the row before and of this one are not
    su, ua or au. A null conv_id is a conversation of its own.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    first = F.substring("role", 1, 1)
    rows = rows.withColumns({"at": F.row_number().over(whole), "before": F.lag(first).over(whole)})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    last = F.regexp_extract("text", _LAST, 1)
    fault = F.when(last == "", "b").when(F.col("again"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    rows = rows.withColumn("again", again).withColumn("fault", fault)
    illegal = F.col("before").isNotNull() & ~F.concat("before", first).isin("su", "ua", "au")
    return rows.withColumn("illegal", illegal).drop("again", "before")


def _edit(state: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _inserted(s: dict[str, Column]) -> dict[str, Column]:
    """The states after empty turns, if any, were put in: a user after all but a user, an assistant after a user."""
    u = F.least(s["u"], _edit(s["e"], 2, "I"), _edit(s["s"], 2, "I"), _edit(s["a"], 2, "I"))
    return s | {"u": u, "a": F.least(s["a"], _edit(u, 2, "I"))}


def _pack(s: dict[str, Column]) -> Column:
    return F.struct(*(s[k].alias(k) for k in "esua"))


def _unpack(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in "esua"}


def _turn(states: Column, turn: Column) -> Column:
    """The four states after one more turn. Each is built from the four before by one array, which is evaluated once."""
    late = F.when(turn["fault"] == "t", 1).otherwise(0)
    forced = turn["fault"].isin("b", "d")
    never = F.lit(NEVER)

    def step(s: Column) -> Column:
        s = _unpack(s)
        keeps = lambda initial: F.when(forced | (turn["initial"] != initial), never).otherwise(late)
        roles = F.when(forced, never).otherwise(2 + late)
        before_user = F.least(s["e"], s["s"], s["a"])
        return _pack(
            {
                "e": _edit(s["e"], 3, "D"),
                "s": F.least(_edit(s["s"], 3, "D"), _edit(s["e"], keeps("s"), "K")),
                "u": F.least(_edit(s["u"], 3, "D"), _edit(before_user, keeps("u"), "K"), _edit(before_user, roles, "R")),
                "a": F.least(_edit(s["a"], 3, "D"), _edit(s["u"], keeps("a"), "K"), _edit(s["u"], roles, "R")),
            }
        )

    # transform() over an array of one binds the states with inserts to a name, so they are not worked out again for each use
    with_inserts = F.transform(F.array(_pack(_inserted(_unpack(states)))), step)
    return F.element_at(with_inserts, 1)


def _from(state: str) -> Column:
    none = lambda k: F.struct(F.lit(0 if k == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _pack({k: none(k) for k in "esua"})


def _through(states: Column, table: Column) -> Column:
    """The four states after a block, from those before it and the block's table by its first state."""
    chain = lambda a, b: F.struct(F.least(a["cost"] + b["cost"], F.lit(NEVER)).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))
    s = _unpack(states)
    return _pack({to: F.least(*(chain(s[frm], table[i][to]) for i, frm in enumerate("esua"))) for to in "esua"})


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, n, blank, duplicate, truncated, illegal, gaps, cost and audit of every conversation among faults() rows.

    The audit has a letter for each edit in order: Keep, Rerole, Delete, Insert.
    """
    n_of = lambda f: F.count(F.when(F.col("fault") == f, 1))
    turn = F.struct("at", F.substring("role", 1, 1).alias("initial"), "fault")
    blocks = rows.withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).groupBy("conv_id", "block")
    # distinct turns: rows are sorted by turn, so a turn's first row is where it differs from the row before
    blocks = blocks.agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        n_of("b").alias("blank"),
        n_of("d").alias("duplicate"),
        n_of("t").alias("truncated"),
        F.count(F.when(F.col("illegal"), 1)).alias("illegal"),
        F.count(F.when(F.col("new_turn"), 1)).alias("turns_seen"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
    )
    fold = lambda state: F.aggregate("turns", _from(state), _turn)
    never = lambda: _pack({k: F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for k in "esua"})
    # a conversation begins in the first state: its first block needs no other
    table = F.array(fold("e"), *(F.when(F.col("block") > 0, fold(k)).otherwise(never()) for k in "sua"))
    blocks = blocks.withColumn("table", table)
    whole = blocks.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns_seen")),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sort_array(F.collect_list(F.struct("block", "table"))).alias("tables"),
    )
    ends = F.aggregate("tables", _from("e"), lambda s, b: _through(s, b["table"]), lambda s: F.least(s["e"], _inserted(_unpack(s))["a"]))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns_seen"), F.lit(0).cast("long"))
    return whole.withColumn("end", ends).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))


def _repair(batches):
    """Repaired messages from rows (conv_id, at, role, text, edits) in order; edits holds what is put in before the row, its letter, and after the last row what is put in at the end."""
    conv, last = None, ""
    for batch in batches:
        out = []
        for c, at, role, text, edits in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "at", "role", "text", "edits")), strict=True):
            if (c,) != conv or at == 1:
                conv, last = (c,), ""
            for e in edits:
                if e == "D":
                    continue
                said, by = ("" if e == "I" else text), (role if e == "K" else "assistant" if last == "u" else "user")
                last = by[:1]
                out.append((c, at, e, by, said))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["conv_id", "at", "edit", "role", "text"])


def _digests(batches):
    conv, sha, any_ = None, None, False
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if (c,) != conv:
                if conv:
                    out.append((*conv, sha.hexdigest()))
                conv, sha, any_ = (c,), hashlib.sha256(), False
            sha.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
            any_ = True
        yield _digest_rows(out)
    yield _digest_rows([(*conv, sha.hexdigest())] if conv else [])


def _digest_rows(out):
    cols = list(zip(*out, strict=True)) or [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string()), strict=True)], ["conv_id", "repaired_sha256"])


def _faulty(rows: DataFrame) -> DataFrame:
    """faults() of the rows, with new_turn, and written: the fold and the texts both need them."""
    by_turn = Window.partitionBy("conv_id").orderBy("at")
    found = faults(rows)
    before = F.lag("turn").over(by_turn)
    return keep(found.withColumn("new_turn", F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))))


def _messages(rows: DataFrame, found: DataFrame) -> DataFrame:
    edits = found.select("conv_id", F.posexplode(F.expr(r"regexp_extract_all(audit, 'I*[DKR](?:I+$)?', 0)")).alias("at", "edits")).withColumn("at", F.col("at") + 1)
    r, e = rows.alias("r"), edits.alias("e")
    joined = r.join(e, F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("r.at") == F.col("e.at")))
    joined = joined.select("r.conv_id", F.col("r.at").cast("long").alias("at"), "r.role", "r.text", "e.edits")
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(_repair, "conv_id long, at long, edit string, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired messages of conversations (conv_id, turn, role, text), sorted in each partition: conv_id, at, edit, role, text.

    Roles become ``(s?(ua)+)?`` by initials, by the cheapest edits: Keep costs 0,
    Rerole (to user or assistant) 2, Delete 3 (a must for blank and duplicate
    rows), Insert (an empty text of either) 2; a truncated row that stays costs 1.
    ``at`` is the row's place in its conversation, or that of the row beside
    which a turn was put in. Rows without role or text have one space.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _faulty(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role"), word("text")))
    return _messages(rows, audits(rows))


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of conversations about its rows, those that a log has kept of it: gaps, counts of faults, cost, audit, repaired_sha256.

    gaps counts the whole numbers between the least and the largest turn that no
    row has. A conversation without rows has zeros, an empty audit and the
    digest of an empty text. A null conv_id is a conversation of its own; no
    conversations give no rows. Rows with the same turn go by role, then text.
    """
    rows = _faulty(rows)
    found = keep(audits(rows))
    digests = _messages(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        F.col("id").alias("conv_id"),
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
