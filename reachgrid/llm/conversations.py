"""Repair of conversations by least edits.

Turns come together by conversation and in order through one shuffle and a sort,
and a task takes one conversation after the other from its stream. What would be
too long for that (many turns, or much text) is cut into segments of a fixed
number of turns, whose least paths between any two states of the grammar are
found apart and then joined; its text is never held, but passes a task once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.edit_lattice import ASSISTANT, MUST_GO, NEXT, OTHER, STEP, SYSTEM, TRUNCATED, USER, given_roles, joined, least_edits, ways
from reachgrid.llm.texts import ordered_sums, written
from reachgrid.operators.sizes import if_small

WHITE = " \t\n\x0b\x0c\r"
#: A conversation with more turns, or more bytes of text, is cut into segments.
MOST_TURNS = 10_000
MOST_BYTES = 64 << 20
#: Turns of a segment.
SEGMENT = 2_000
#: Bytes of repaired text that a task collects before it sends them on.
FLUSH = 8 << 20
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "array<struct<edit: string, role: string, text: string>>"


def _state(text: Column) -> Column:
    """1 for a blank text, 2 for a truncated one, else 0."""
    bare = F.rtrim(text, F.lit(WHITE))
    return F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): the columns that count, null roles and texts as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(True).alias("there"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """:func:`turns_of` with faults planted by crc32(conv_id:turn) % 20 (nulls as one space).

    0 drops a turn (it stays as a row that is not there, so that its
    conversation is known), 1 empties its text, 2 takes out . ! and ?, 3 repeats
    it and 4 gives it the role user.
    """
    turns = turns_of(conversations)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    hurt = turns.withColumn("_kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") != 0).alias("there"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return hurt.drop("_copy")


def _code(role: str, state: int, again: bool) -> int:
    return KINDS.get(role[:1], OTHER) | (MUST_GO if state == 1 or again else TRUNCATED if state == 2 else 0)


def _illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


class _Open:
    """The turns of one conversation as they come."""

    def __init__(self, conv):
        self.conv = conv
        self.turns: set = set()
        self.rows: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.codes = bytearray()
        self.counts = [0, 0, 0]

    def add(self, turn, role: str, text: str, state: int) -> None:
        again = (role, text) in self.seen
        self.seen.add((role, text))
        if turn is not None:
            self.turns.add(turn)
        self.rows.append((role, text))
        self.codes.append(_code(role, state, again))
        if state == 1 or again or state == 2:
            self.counts[0 if state == 1 else 1 if again else 2] += 1

    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0


def _repaired(rows: list[tuple[str, str]], codes: bytes, audit: str) -> Iterator[tuple[str, str, str]]:
    i = 0
    for letter, role in zip(audit, given_roles(codes, audit)):
        if letter == "I":
            yield letter, role, ""
            continue
        if letter != "D":
            yield letter, role or rows[i][0], rows[i][1]
        i += 1


def _streamed(turns: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit, turns): a row for each conversation; none may be too long for a task."""
    order = ["conv_id", "turn", "role", "text"]
    schema = f"conv_id long, {COUNTS}, turns {TURNS}"

    def repair(batches):
        out: list[tuple] = []
        size = 0

        def closed(one: _Open) -> tuple:
            codes = bytes(one.codes)
            cost, audit = least_edits(codes)
            return one.conv, one.gaps(), *one.counts, _illegal(codes), cost, audit, list(_repaired(one.rows, codes, audit))

        def sent() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out))
            flat = [t for turns in columns[8] for t in turns]
            parts = list(zip(*flat)) or [(), (), ()]
            ends = [0]
            for turns in columns[8]:
                ends.append(ends[-1] + len(turns))
            structs = pa.StructArray.from_arrays([pa.array(p, pa.string()) for p in parts], names=["edit", "role", "text"])
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)]
            out, size = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])

        now = None
        for batch in batches:
            for conv, turn, role, text, there, state in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(closed(now))
                    if size > FLUSH:
                        yield sent()
                    now = _Open(conv)
                if there:
                    now.add(turn, role, text, state)
                    size += len(text)
        if now is not None:
            out.append(closed(now))
            yield sent()

    together = turns.select(*order, "there", _state(F.col("text")).alias("state")).repartition("conv_id")
    return together.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").mapInArrow(repair, schema)


def _segmented(turns: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, counts, cost, audit), numbered turns with their codes) of long conversations."""
    kept = turns.where("there").select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("dated"), "turn", "role", "text", _state(F.col("text")).alias("state"), F.lit(1).alias("one"),
        F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "role", "text").alias("k2"),
    )
    placed = written(ordered_sums(kept, ["conv_id", "dated", "turn", "role", "text"], {"pos": "one"}, "long-turns"), "long-places")
    again = placed.where("state != 1").groupBy("conv_id", "k1", "k2").agg(F.min("pos").alias("first"), F.count("*").alias("size")).where("size > 1")
    t, s = placed.alias("t"), if_small(again).alias("s")
    same = F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("t.k1") == F.col("s.k1")) & (F.col("t.k2") == F.col("s.k2")) & (F.col("t.state") != 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    duplicate = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("state") == 1, "blank").when(duplicate, "duplicate").when(F.col("state") == 2, "truncated")
    marked = t.join(s, same, "left").select("t.conv_id", "turn", "role", "text", "pos", fault.alias("fault"), kind.alias("kind"))
    flag = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    coded = written(marked.withColumn("code", (F.col("kind") + flag).cast("int")), "long-codes")

    def part(batches):
        for batch in batches:
            conv, seg, cells = (c.to_pylist() for c in batch.columns)
            codes = [bytes(c["code"] for c in sorted(x, key=lambda c: c["pos"])) for x in cells]
            found = [[{"p": p, "q": q, "cost": c, "letters": a} for p, q, c, a in ways(x)] for x in codes]
            kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
            ends = [pa.array([x[i] for x in codes], pa.int32()) for i in (0, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(seg, pa.int64()), *ends, pa.array([_illegal(x) for x in codes], pa.int64()), pa.array(found, kind)],
                names=["conv_id", "seg", "first", "last", "illegal", "ways"],
            )

    # Segments are cut at multiples of all places, so no group has more turns than that.
    cells = coded.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(F.collect_list(F.struct("pos", "code")).alias("cells"))
    segments = written(
        cells.mapInArrow(part, "conv_id long, seg long, first int, last int, illegal long, ways array<struct<p: int, q: int, cost: long, letters: string>>"),
        "long-segments",
    )

    def join(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        cost, audit = joined([[(w["p"], w["q"], w["cost"], w["letters"]) for w in r["ways"]] for r in rows])
        between = sum((a["last"] & 3, b["first"] & 3) not in LEGAL for a, b in zip(rows, rows[1:]))
        return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "illegal": pa.array([between + sum(r["illegal"] for r in rows)]), "cost": [cost], "audit": [audit]})

    # A group holds a few letters a turn, which its audit holds too.
    audits = segments.groupBy("conv_id").applyInArrow(join, "conv_id long, illegal long, cost long, audit string")
    days = coded.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = days.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = coded.groupBy("conv_id").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])

    def on(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.withColumnRenamed("conv_id", "_conv")
        return a.join(b, F.col("conv_id").eqNullSafe(F.col("_conv")), how).drop("_conv")

    report = on(on(audits, faults, "inner"), gaps, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), coded


def _passed(report: DataFrame, coded: DataFrame, digest: bool) -> DataFrame:
    """The repaired turns of long conversations (conv_id, place, edit, role, text), or (conv_id, repaired_sha256) of their text.

    Each conversation passes one task as a stream behind its audit, since a
    digest can only be taken in order.
    """

    def stream(batches):
        conv = hashed = None
        audit, at, place, state, first = "", 0, 0, 0, True
        done: list[tuple] = []

        for batch in batches:
            for c, pos, role, text, code in zip(*(x.to_pylist() for x in batch.columns)):
                if pos < 0:
                    if hashed is not None and digest:
                        done.append((conv, hashed.hexdigest()))
                    conv, audit, at, place, hashed, first, state = c, text, 0, 0, hashlib.sha256(), True, 0
                take = pos >= 0
                # Inserted turns stand before the one that an edit takes.
                while at < len(audit) and (audit[at] == "I" or take):
                    letter = audit[at]
                    at += 1
                    given, kept = None, letter != "D"
                    if letter in "RI":
                        state = NEXT[state]
                        given = "user" if state == 2 else "assistant"
                    elif letter == "K":
                        state = STEP[state][code & 3]
                    take = take and letter == "I"
                    if kept:
                        r, x = given or role, "" if letter == "I" else text
                        if digest:
                            hashed.update(("" if first else "\n").encode() + f"{r}:{x}".encode())
                        else:
                            done.append((c, place, letter, r, x))
                        first = False
                        place += 1
            if done and not digest:
                yield made(done)
                done = []
        if hashed is not None and digest:
            done.append((conv, hashed.hexdigest()))
        if done:
            yield made(done)

    types = [("conv_id", pa.int64()), ("repaired_sha256", pa.string())] if digest else [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    none = F.lit(None)
    heads = report.select("conv_id", F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("int").alias("code"))
    both = heads.unionByName(coded.select("conv_id", "pos", "role", "text", "code"))
    schema = "conv_id long, repaired_sha256 string" if digest else "conv_id long, place long, edit string, role string, text string"
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos").mapInArrow(stream, schema)


class Repair:
    """The repair of *turns* (:func:`turns_of`, :func:`damaged`), as tables.

    Turns of a conversation are taken by turn (nulls first), then by role and
    text, and each is blank (no byte but white space), a duplicate (role and text
    were there before) or truncated (it does not end in . ! or ?), whichever
    comes first. Roles count by their first letter: s, u and a have places in
    the grammar, all others, empty ones too, must be renamed or deleted. Null
    conv_ids are one conversation. Rows that repeat are turns of their own.
    Turns that are not there only name their conversation. No rows give no rows.
    """

    def __init__(self, turns: DataFrame, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES, segment: int = SEGMENT):
        sizes = turns.where("there").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("size"))
        long = written(sizes.where((F.col("n") > most_turns) | (F.col("size") > most_bytes)).select(F.col("conv_id").alias("_long")), "long-conversations")
        self.long = None
        short = turns
        if not long.isEmpty():
            # At most one row for each most_turns turns or most_bytes bytes.
            marked, same = if_small(long), F.col("conv_id").eqNullSafe(F.col("_long"))
            short = turns.join(marked, same, "left_anti")
            report, coded = _segmented(turns.join(marked, same, "left_semi"), segment)
            self.long = written(report, "long-report"), coded
        self.short = _streamed(short)

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

        The digest is of the repaired turns as role:text, joined by line feeds.
        """
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        out = self.short.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")
        if self.long is not None:
            report, coded = self.long
            digests = _passed(report, coded, True).withColumnRenamed("conv_id", "_conv")
            out = out.unionByName(report.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
        return out

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired turns; place counts from 0, edit is K, R or I."""
        exploded = self.short.select("conv_id", F.posexplode("turns").alias("place", "t"))
        out = exploded.select("conv_id", F.col("place").cast("long").alias("place"), "t.edit", "t.role", "t.text")
        return out if self.long is None else out.unionByName(_passed(*self.long, False))
