"""Conversation structure repair: a dynamic programme over the turns that stay.

A repair keeps or re-roles some turns and deletes the others; what lies between two that stay has a price of its own:
deletions by a prefix sum, inserted turns by the pair of roles. Going backwards, the best continuation behind a turn is
the least of one running minimum for each role, so a conversation takes linear time. Of equally cheap repairs the one
with the least audit string wins, which the next turn that stays decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.store import arrow_rows, stash, unused
from pagelake.llm.text import SPACES

#: Prices of edits, and what a truncated turn adds if it stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Turns to insert between one role and the next: `^` is the start and `$` the end; pairs that no insert can mend are left out.
BETWEEN = {
    "^": {"s": 0, "u": 0, "a": 1, "$": 0},
    "s": {"u": 0, "a": 1, "$": 2},
    "u": {"u": 1, "a": 0, "$": 1},
    "a": {"u": 0, "a": 1, "$": 0},
}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}
#: Bytes of one conversation's texts that a task holds; the texts of a longer one are read again in order, and hashed as they pass.
HELD = 1 << 25
ROWS = 1000


def cheapest(initials: Sequence[str], faults: Sequence[str]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair. Faults: `blank` and `duplicate` have to go, `truncated` costs if it stays, the empty one is none."""
    n = len(initials)
    ahead: dict[str, tuple[int, int]] = {}  # role -> least of (deletions before a turn + its best cost), and the turn
    follow: list[dict[str, tuple[int, str]]] = [{}] * n
    deleted = range(0, DELETE * (n + 1), DELETE)  # prefix sums

    def behind(j: int, role: str) -> tuple[int, int, str, str]:
        """Cost behind turn j as `role`, the next turn that stays (n: none) negated, the audit up to it, its role."""
        options = []
        for then, inserts in BETWEEN[role].items():
            value, k = ahead.get(then, (None, n)) if then != "$" else (deleted[n], n)
            if value is not None:
                letter = "" if then == "$" else "K" if initials[k] == then else "R"
                options.append((value - deleted[j + 1] + INSERT * inserts, -k, "I" * inserts + letter, then))
        return min(options)  # of equal costs the longer run of deletions, as D comes before all other letters

    for k in range(n - 1, -1, -1):
        if faults[k] in ("blank", "duplicate"):
            continue
        best = {role: behind(k, role) for role in {"u", "a", initials[k]} & BETWEEN.keys()}
        follow[k] = {role: (-after, then) for role, (_, after, _, then) in best.items()}
        for role, (cost, *_) in best.items():
            value = deleted[k] + cost + (0 if initials[k] == role else REROLE) + (TRUNCATED if faults[k] == "truncated" else 0)
            if role not in ahead or value < ahead[role][0]:
                ahead[role] = (value, k)
    cost, after, letters, then = behind(-1, "^")
    audit, j, k = [], -1, -after
    while True:
        audit.append("D" * (k - j - 1) + letters)
        if k == n:
            return cost, "".join(audit)
        role, (following, then_) = then, follow[k][then]
        inserts = BETWEEN[role][then_]
        letters = "I" * inserts + ("" if then_ == "$" else "K" if initials[following] == then_ else "R")
        j, k, then = k, following, then_


def mended(rows: Iterator[tuple[bytes, bytes]], audit: str) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of the repaired turns. The roles of new and re-roled ones follow from the turn before."""
    before = b""
    for edit in audit:
        role, text = (b"", b"") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = b"assistant" if before == b"u" else b"user"
        before = role[:1]
        yield role, text


def digest(turns: Iterator[tuple[bytes, bytes]]) -> str:
    """Hex SHA-256 of `role:text`, joined by line ends."""
    h = hashlib.sha256()
    for i, (role, text) in enumerate(turns):
        h.update((b"\n" if i else b"") + role + b":")
        h.update(text)
    return h.hexdigest()


class _Conversation:
    """What is kept of one conversation while its turns pass in order: some bytes a turn, and the texts up to HELD bytes."""

    def __init__(self, held: int):
        self.held, self.initials, self.faults, self.seen, self.rows = held, [], [], set(), []
        self.least = self.most = self.last_turn = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn, self.most = turn, turn
            self.least = turn if self.least is None else self.least
        said = text.rstrip(SPACES)
        own = hashlib.blake2b(b"%d:" % len(role) + role + text, digest_size=16).digest()
        fault = "blank" if not said else "duplicate" if own in self.seen else "" if said[-1:] in (b".", b"!", b"?") else "truncated"
        self.seen.add(own)
        initial = role.decode(errors="replace")[:1]
        if self.initials and (self.initials[-1], initial) not in LEGAL:
            self.illegal += 1
        self.initials.append(initial), self.faults.append(fault)
        self.held -= len(role) + len(text)
        if self.held >= 0:
            self.rows.append((role, text))
        else:
            self.rows = []

    def report(self) -> list:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, hash; no hash if the texts were too long to hold."""
        cost, audit = cheapest(self.initials, self.faults)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, *(self.faults.count(f) for f in ("blank", "duplicate", "truncated")), self.illegal, cost, audit, digest(mended(iter(self.rows), audit)) if self.held >= 0 else None]


def repair(turns: DataFrame, present: Column | None = None, held: int = HELD) -> DataFrame:
    """One row a conversation: its faults, and the cheapest edits that make its roles `(s?(ua)+)?`.

    Turns have conv_id, turn, role and text; those for which `present` isn't true only name their conversation. Returns conv_id,
    gaps (numbers missing between the first and the last turn), blank, duplicate, truncated, illegal (neighbours whose roles
    can't follow each other), cost, audit (K keep, R re-role, D delete, I insert, in order) and repaired_sha256 (of the repaired
    `role:text`, joined by line ends). Turns go by number, nulls first, then by role and text; a null role or text is one space.
    A null conv_id is a conversation like others; equal rows are duplicates. A conversation without turns has zeros, an empty
    audit and the hash of nothing. Further columns are ignored; an empty table gives none.

    A conversation is an ordered whole, so it passes through one task, as a stream: of each turn some bytes stay until its end,
    of the texts at most `held` bytes. Longer ones are read again, behind their audit, and hashed as they pass.
    """
    own = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(
        "conv_id", own.alias("present"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).cast("binary").alias(c) for c in ("role", "text")]
    )
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([turns.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        out: list = []
        talk: _Conversation | None = None
        kind = None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])], names=schema.names)
            ids.clear(), out.clear()
            return batch

        now = None
        for b in batches:
            kind = b.column(0).type
            for conv_id, here, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if talk is None or conv_id != now:
                    if talk:
                        ids.append(now), out.append(talk.report())
                    talk, now = _Conversation(held), conv_id
                if here:
                    talk.add(turn, role, text)
            if len(ids) >= ROWS:
                yield made()
        if talk:
            ids.append(now), out.append(talk.report())
        if ids:
            yield made()

    spark = turns.sparkSession
    with arrow_rows(spark, ROWS):
        ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)
        found = stash(ordered, "turns")
        long = found.where(F.col("repaired_sha256").isNull())
        if long.isEmpty():
            return found
        hashed = stash(_hashed(rows.where("present"), long.select("conv_id", "audit")), "turns")
    return found.where(F.col("repaired_sha256").isNotNull()).unionByName(long.drop("repaired_sha256").join(hashed.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))


def _hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: turns stream past behind the audit of their conversation, one at a time in memory."""
    mark = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("role"), F.col("audit").cast("binary").alias("text"))
    c = unused("c", audits.columns)
    some = rows.join(audits.select(F.col("conv_id").alias(c)), F.col("conv_id").eqNullSafe(F.col(c)), "left_semi")
    stream = mark.unionByName(some.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    schema = T.StructType([audits.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list = []

        def passing() -> Iterator[tuple]:
            for b in batches:
                kind[:] = [b.column(0).type]
                for k in range(b.num_rows):  # one text at a time
                    yield tuple(col[k].as_py() for col in b.columns)

        source = passing()
        head = next(source, None)
        while head is not None:
            conv_id, _, _, _, audit = head
            head = None

            def own() -> Iterator[tuple[bytes, bytes]]:
                nonlocal head
                for row in source:
                    if not row[1]:  # the next conversation's audit
                        head = row
                        return
                    yield row[3], row[4]

            mine = own()
            made = digest(mended(mine, audit.decode()))
            for _ in mine:  # on to the next audit
                pass
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind[0]), pa.array([made])], names=schema.names)

    return stream.mapInArrow(run, schema)
