"""Repair of conversation structure by a dynamic program that streams over sorted turns.

A sound conversation has role initials ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant turns.
Edits are Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and duplicate rows) and Insert of an
empty user or assistant turn (3); a truncated row that stays adds 3.  The cheapest edits win, ties by the ASCII order of
their initials.

1. Faults of a row alone are columns.  Rows seen earlier in their conversation are found by a combining aggregate of
   digests; only digests that occur more than once are joined back.
2. Rows are dealt by conversation and sorted by turn.  ``mapInPandas`` carries the state of the program across Arrow
   batches: per place in the pattern the cost and the rank of its edits so far, and four bytes of way back per row.  A
   conversation within ``buffer_bytes`` ends right there.
3. A longer one is spilled as it comes: chunks of its ways back and turns become rows of the shared table.  A second
   stream walks its chunks backwards and turns ways back into edits, a third one applies them in order.  So a task holds
   one buffer at a time, whatever the conversation; one conversation is still one task, since its digest is sequential.

Edge cases: a null role or text is one space; a null turn sorts first and is left out of gaps; a null ``conv_id`` is a
conversation.  Rows of the same turn are taken by role, then text.  Only the first letter of a role counts, as it stands;
an empty role has none and cannot be kept.  An empty table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import stored

BUFFER_BYTES = 16 << 20
BLANKS = " \t\n\x0b\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED, LOST = range(5)

#: Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: From each place, the places that inserted turns lead to, with their number; going round costs more than staying.
INSERTS = {EMPTY: ((EMPTY, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)),
           USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
KEEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LETTERS = "DKR"
START = ((0, 0), None, None, None)


def _next(place: int) -> int:
    return ASSISTANT if place == USER else USER


@lru_cache(maxsize=1 << 16)
def step(state: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
    """The state after one row, what the cheapest place paid more, and the way back from each place.

    A state has ``(cost above the cheapest, rank of the edits so far)`` per place, None where none is reached.  Edits up
    to a row end in that row's letter, so none are a prefix of others and ranks decide every later tie.
    """
    best: dict[int, tuple] = {}
    for place, known in enumerate(state):
        if known is None:
            continue
        for at, inserted in INSERTS[place]:
            spent, fix = known[0] + 3 * inserted, 3 * (fault == TRUNCATED)
            moves = [("D", at, 4)]
            if fault not in (BLANK, DUPLICATE):
                moves.append(("R", _next(at), 3 + fix))
                if (at, initial) in KEEPS:
                    moves.append(("K", KEEPS[at, initial], fix))
            for letter, to, cost in moves:
                entry = (spent + cost, known[1], "I" * inserted + letter, place)
                if to not in best or entry < best[to]:
                    best[to] = entry
    order = {entry[1:3]: rank for rank, entry in enumerate(sorted(best.values(), key=lambda e: e[1:3]))}
    least = min(entry[0] for entry in best.values())
    after = tuple((best[p][0] - least, order[best[p][1:3]]) if p in best else None for p in range(4))
    back = bytes(best[p][3] | (len(best[p][2]) - 1) << 2 | LETTERS.index(best[p][2][-1]) << 4 if p in best else 255 for p in range(4))
    return after, least, back


def ending(state: tuple) -> tuple[int, int, int]:
    """What the end adds to the cost, the place before the last inserts, and how many these are."""
    needed = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    cost, _, _, place = min((known[0] + 3 * needed[p], known[1], needed[p], p) for p, known in enumerate(state) if known)
    return cost, place, needed[place]


def edits_of(back: bytes, place: int) -> tuple[bytearray, int]:
    """One byte per row, inserts before it and its letter, and the place before the first row."""
    edits = bytearray(len(back) // 4)
    for row in range(len(edits) - 1, -1, -1):
        code = back[4 * row + place]
        edits[row] = code >> 2
        place = code & 3
    return edits, place


class Editor:
    """Applies edits to turns in order: the audit, the digest of what stays and, if asked for, the turns themselves."""

    def __init__(self, keep_turns: bool):
        self.place, self.first, self.hash, self.keep_turns = EMPTY, True, hashlib.sha256(), keep_turns
        self.begin()

    def begin(self) -> None:
        self.audit, self.turns = [], []

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        if self.keep_turns:
            self.turns.append((role, text))

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.place = _next(self.place)
            self._put("user" if self.place == USER else "assistant", "")
            self.audit.append("I")

    def apply(self, edits: bytes, roles: list[str], texts: list[str]) -> None:
        for edit, role, text in zip(edits, roles, texts):
            self.insert(edit & 3)
            letter = LETTERS[edit >> 2]
            self.audit.append(letter)
            if letter == "R":
                self.place = _next(self.place)
                self._put("user" if self.place == USER else "assistant", text)
            elif letter == "K":
                self.place = KEEPS[self.place, role[:1]]
                self._put(role, text)


class Walk:
    """One conversation on its way through the stream."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost, self.chunks = conv_id, START, 0, 0
        self.counts = [0] * 5
        self.least = self.last = self.turn = None
        self.rows = self.distinct = self.illegal = 0
        self.before = None
        self.clear()

    def clear(self) -> None:
        self.back, self.roles, self.texts, self.size = bytearray(), [], [], 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == LOST:
            return
        if fault != BLANK and self.before == (turn, role, text):
            fault = DUPLICATE
        if turn is not None:
            self.distinct += turn != self.last
            self.least = turn if self.least is None else self.least
            self.last = turn
        if self.rows:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        self.rows += 1
        self.counts[fault] += 1
        self.state, paid, back = step(self.state, role[:1], fault)
        self.cost += paid
        self.back += back
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + 100

    def report(self) -> dict:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
                "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": self.cost + ending(self.state)[0]}


TURNS = "turns array<struct<role string, text string>>"
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LONGS = ", ".join(f"{c} long" for c in REPORT)
_SPILLED = "back binary, roles array<string>, texts array<string>, place int, inserts int"
STREAMED = f"{_LONGS}, part long, audit string, repaired_sha256 string, {TURNS}, {_SPILLED}"


_NUMBERS = [*REPORT, "part", "place", "inserts"]


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [*REPORT, "part", "audit", "repaired_sha256", "turns", "back", "roles", "texts", "place", "inserts"]
    return pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype="Int64" if c in _NUMBERS else object) for c in names})


def _streamed(frames: Iterator[pd.DataFrame], buffer_bytes: int, keep_turns: bool) -> Iterator[pd.DataFrame]:
    walk: Walk | None = None

    def spilled() -> dict:
        row = {"conv_id": walk.conv_id, "part": walk.chunks, "back": bytes(walk.back), "roles": walk.roles, "texts": walk.texts}
        walk.chunks += 1
        walk.clear()
        return row

    def ended() -> list[dict]:
        _, place, inserts = ending(walk.state)
        if walk.chunks:
            rows = [spilled()] if walk.roles else []
            return rows + [walk.report() | {"part": walk.chunks, "place": place, "inserts": inserts}]
        editor = Editor(keep_turns)
        editor.apply(edits_of(walk.back, place)[0], walk.roles, walk.texts)
        editor.insert(inserts)
        return [walk.report() | {"audit": "".join(editor.audit), "repaired_sha256": editor.hash.hexdigest(), "turns": editor.turns}]

    for frame in frames:
        out: list[dict] = []
        convs, turns = ([None if pd.isna(v) else int(v) for v in frame[c]] for c in ("conv_id", "turn"))
        for conv_id, turn, role, text, fault in zip(convs, turns, frame["role"], frame["text"], frame["fault"]):
            if walk is None or walk.conv_id != conv_id:
                out += ended() if walk else []
                walk = Walk(conv_id)
            walk.add(turn, role, text, fault)
            if walk.size >= buffer_bytes:
                out.append(spilled())
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)
    if walk:
        yield _frame(ended())


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of a conversation from the last to the first, its report before them; the edits of each chunk."""
    place = EMPTY
    for frame in frames:
        rows = []
        for conv_id, part, back, end in zip(frame["conv_id"], frame["part"], frame["back"], frame["place"]):
            if back is None:
                place = int(end)
                continue
            edits, place = edits_of(back, place)
            rows.append((conv_id, part, bytes(edits)))
        yield pd.DataFrame(rows, columns=["conv_id", "part", "edits"]).astype({"conv_id": "Int64", "part": "Int64"})


def _applied(frames: Iterator[pd.DataFrame], keep_turns: bool) -> Iterator[pd.DataFrame]:
    """Chunks of a conversation in order, its report after them; a piece of the audit and the turns of each."""
    editor = Editor(keep_turns)
    for frame in frames:
        rows = []
        for conv_id, part, edits, roles, texts, inserts in zip(*(frame[c] for c in ("conv_id", "part", "edits", "roles", "texts", "inserts"))):
            ends = edits is None
            if ends:
                editor.insert(int(inserts))
            else:
                editor.apply(edits, roles, texts)
            rows.append((conv_id, part, "".join(editor.audit), editor.hash.hexdigest() if ends else None, editor.turns))
            editor = Editor(keep_turns) if ends else editor
            editor.begin()
        yield pd.DataFrame(rows, columns=["conv_id", "part", "piece", "repaired_sha256", "turns"]).astype({"conv_id": "Int64", "part": "Int64"})


def marked(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault`` without nulls in role and text; a true ``lost`` column marks rows that are gone."""
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost"))
    ended = F.rtrim("text", F.lit(BLANKS))
    alone = (F.when(F.col("lost"), LOST).when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256)
    # Rows that cannot repeat anything get keys of their own turn, so that they do not meet in one task.
    own = F.concat_ws(":", F.lit("own"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("string"))
    rows = rows.withColumn("alone", alone).drop("lost").withColumn("digest", F.when(F.col("alone").isin(SOUND, TRUNCATED), key).otherwise(own))
    repeated = (rows.filter(F.col("alone").isin(SOUND, TRUNCATED)).groupBy("digest")
                .agg(F.count("*").alias("n"), F.bool_or(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("first"))
                .filter("n > 1").drop("n"))
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("from_null") | (F.col("turn") > F.col("first"))), F.lit(False))
    return (rows.join(repeated, "digest", "left").withColumn("fault", F.when(later, DUPLICATE).otherwise(F.col("alone")).cast("int"))
            .select("conv_id", "turn", "role", "text", "fault"))


def _dealt(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def repaired(rows: DataFrame, keep_turns: bool = False, buffer_bytes: int = BUFFER_BYTES) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and its repaired turns (empty unless ``keep_turns``) in parts.

    Report: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Turns: ``conv_id, part,
    turns``; a conversation within the buffer has one part.
    """
    streamed = stored(_dealt(marked(rows), F.asc_nulls_first("turn"), "role", "text")
                      .mapInPandas(lambda frames: _streamed(frames, buffer_bytes, keep_turns), STREAMED), "repair")
    columns = [*REPORT, "audit", "repaired_sha256"]
    ended, spilled = streamed.filter("part is null"), streamed.filter("part is not null")
    if spilled.isEmpty():
        return ended.select(columns), ended.select("conv_id", F.lit(0).cast("long").alias("part"), "turns")
    edits = _dealt(spilled.select("conv_id", "part", "back", "place"), F.desc("part")).mapInPandas(_backwards, "conv_id long, part long, edits binary")
    same = spilled["conv_id"].eqNullSafe(edits["conv_id"]) & (spilled["part"] == edits["part"])
    joined = spilled.join(edits, same, "left").select(spilled["conv_id"], spilled["part"], "edits", "roles", "texts", "inserts")
    pieces = stored(_dealt(joined, "part").mapInPandas(lambda frames: _applied(frames, keep_turns), f"conv_id long, part long, piece string, repaired_sha256 string, {TURNS}"),
                    "repaired")
    audits = pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"])).alias("audit"),
                                           F.max("repaired_sha256").alias("repaired_sha256"))
    reports = spilled.filter("place is not null")
    full = reports.join(audits, reports["conv_id"].eqNullSafe(audits["conv_id"])).select(*[reports[c] for c in REPORT], audits["audit"], audits["repaired_sha256"])
    return (ended.select(columns).union(full),
            ended.select("conv_id", F.lit(0).cast("long").alias("part"), "turns").union(pieces.select("conv_id", "part", "turns")))


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query: by crc32 of ``conv_id:turn`` modulo 20 a row is lost, emptied, unpunctuated, doubled or said by the user."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") == 0).alias("lost"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
