"""Repairing the turn structure of conversations by a cheapest audit, kept in a persistent tree of edits."""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import small_batches, tidied

#: White space of the contract; everything else is content.
SPACE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}

# What follows the roles written so far: 0 nothing written, 1 a system turn, 2 a user turn, 3 an assistant turn.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
DELETE, REROLE, INSERT = 3, 2, 2

PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79_2468ACE1 % ((1 << 61) - 1)


class Audits:
    """Strings of edits as nodes of a tree: a longer audit shares all nodes of the one it continues.

    A node knows its depth, a rolling hash of its whole string and its ancestors 1, 2, 4, … steps up.  Two strings are
    ordered by the longest prefix they share, found by jumping up while hashes differ; what the hashes call equal is
    then walked letter by letter up to the node where both meet, so a collision cannot decide.
    """

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        up = [node]
        step = 0
        while step < len(self.up[up[step]]):
            up.append(self.up[up[step]][step])
            step += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % PRIME)
        self.up.append(up)
        return len(self.letter) - 1

    def at_depth(self, node: int, depth: int) -> int:
        above = self.depth[node] - depth
        step = 0
        while above:
            if above & 1:
                node = self.up[node][step]
            above >>= 1
            step += 1
        return node

    def _apart(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair of differing letters above two nodes of one depth, themselves included; None if there is none."""
        found = None
        while a != b:
            if self.letter[a] != self.letter[b]:
                found = (a, b)
            a, b = self.up[a][0], self.up[b][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` sorts before that of ``b``."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if self.hash[x] == self.hash[y]:
            pair = self._apart(x, y)
            if pair is None:
                return self.depth[a] < self.depth[b]
        else:
            for step in range(len(self.up[x]) - 1, -1, -1):
                if step < len(self.up[x]) and self.hash[self.up[x][step]] != self.hash[self.up[y][step]]:
                    x, y = self.up[x][step], self.up[y][step]
            pair = self._apart(self.up[x][0], self.up[y][0]) or (x, y)
        return self.letter[pair[0]] < self.letter[pair[1]]

    def text(self, node: int, above: int = 0) -> str:
        """Letters from below the ancestor ``above`` down to ``node``."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shared(self, nodes: list[int]) -> int:
        """Deepest common ancestor."""
        depth = min(self.depth[n] for n in nodes)
        nodes = {self.at_depth(n, depth) for n in nodes}
        while len(nodes) > 1:
            nodes = {self.up[n][0] for n in nodes}
        return nodes.pop()


class Repair:
    """Cheapest audit of one conversation, fed turn by turn.

    For each of the four states the cheapest audit that ends in it is kept, of equal ones the least in ASCII order.
    (Of two audits of one cost that end in one state after the same rows neither begins with the other, since the
    rest could only be paid inserts; so the lesser one stays the lesser one, whatever follows.)  A state that another
    state can imitate for less is dropped.  What all states left have in common is final: it is written to ``put`` and
    its nodes are let go, so memory holds the turns still undecided and one letter a decided turn.
    """

    def __init__(self, put, settle: int = 256):
        self.put, self.settle = put, settle
        self.tree, self.cost, self.node = Audits(), [0, None, None, None], [0, 0, 0, 0]
        self.pending: deque = deque()
        self.state, self.since, self.audit = 0, 0, []

    def _best(self, offers: list[tuple[int, int, str]]) -> tuple[int, int]:
        """Cost and node of the best of (cost, node, letter); an empty letter stands for the node itself."""
        low = min(o[0] for o in offers)
        tree, best = self.tree, None
        for cost, node, letter in offers:
            if cost == low:
                new = tree.add(node, letter) if letter else node
                if best is None or tree.less(new, best):
                    best = new
        return low, best

    def _insert(self) -> None:
        """Turns inserted here: a user turn after any state but itself, an assistant turn after a user turn."""
        cost, node = self.cost, self.node
        for target, sources in ((2, (0, 1, 3)), (3, (2,))):
            offers = [(cost[q] + INSERT, node[q], "I") for q in sources if cost[q] is not None]
            if cost[target] is not None:
                offers = [o for o in offers if o[0] <= cost[target]]
                if not offers:
                    continue
                offers.append((cost[target], node[target], ""))
            if offers:
                cost[target], node[target] = self._best(offers)

    def feed(self, role: str, text: str, goes: bool, truncated: bool) -> None:
        self._insert()
        self.pending.append((role, text))
        offers: list[list] = [[], [], [], []]
        initial = role[:1]
        for q, cost in enumerate(self.cost):
            if cost is None:
                continue
            node = self.node[q]
            offers[q].append((cost + DELETE, node, "D"))
            if not goes:
                kept = KEEP[q].get(initial)
                if kept is not None:
                    offers[kept].append((cost + truncated, node, "K"))
                offers[NEXT[q]].append((cost + REROLE + truncated, node, "R"))
        for q, found in enumerate(offers):
            self.cost[q], self.node[q] = self._best(found) if found else (None, 0)
        self._prune()
        self.since += 1
        if self.since >= self.settle:
            self._commit(self.tree.shared([n for c, n in zip(self.cost, self.node) if c is not None]))

    def _prune(self) -> None:
        """Drops states whose every way on is dearer than the same way from another one.

        From "assistant" one can go on as from "nothing" (a kept system turn is deleted instead, 3 more at most) and as
        from "system"; "user" and "assistant" turn into one another by an insert.
        """
        c = self.cost
        done = min([x for x in (c[3], None if c[2] is None else c[2] + INSERT) if x is not None], default=None)
        if done is None:
            return
        for q, allowed in ((0, DELETE), (1, 0), (3, 0)):
            if c[q] is not None and c[q] > done + allowed:
                c[q] = None
        if c[2] is not None and c[3] is not None and c[2] > c[3] + INSERT:
            c[2] = None

    def _commit(self, node: int) -> None:
        """Writes the edits down to ``node`` and makes it the root of a new tree."""
        letters = self.tree.text(node)
        live = [(q, self.tree.text(self.node[q], node)) for q, c in enumerate(self.cost) if c is not None]
        self.tree, self.since = Audits(), 0
        shared: dict[tuple[int, str], int] = {}
        for q, rest in live:
            at = 0
            for letter in rest:
                if (at, letter) not in shared:
                    shared[at, letter] = self.tree.add(at, letter)
                at = shared[at, letter]
            self.node[q] = at
        self.audit.append(letters)
        for letter in letters:
            if letter == "I":
                self.state = NEXT[self.state]
                self.put(letter, ROLE[self.state], "")
                continue
            role, text = self.pending.popleft()
            if letter == "D":
                self.put(letter, None, text)
                continue
            self.state = KEEP[self.state][role[:1]] if letter == "K" else NEXT[self.state]
            self.put(letter, role if letter == "K" else ROLE[self.state], text)

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation."""
        self._insert()
        cost, node = self._best([(self.cost[q], self.node[q], "") for q in (0, 3) if self.cost[q] is not None])
        self.cost, self.node = [cost, None, None, None], [node, 0, 0, 0]
        self._commit(node)
        return cost, "".join(self.audit)


class _Conversation:
    """Faults, audit and digest of one conversation, from its rows in order."""

    def __init__(self, key, put=None):
        self.key, self.rows, self.turns = key, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.before, self.last = None, None
        self.turn, self.seen = None, set()
        self.sha, self.written = hashlib.sha256(), False
        self.repair = Repair(put or self._hash)

    def _hash(self, letter, role, text):
        if letter != "D":
            self.sha.update((("\n" if self.written else "") + role + ":" + text).encode())
            self.written = True

    def add(self, turn, kind, role, text, mark):
        if turn != self.turn:
            self.turn, self.seen = turn, set()
        if kind == 0:  # this role and text stood in an earlier turn
            self.seen.add(mark)
            return
        if kind == 2:
            return
        self.rows += 1
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn]
            self.distinct += self.rows == 1 or turn != self.last
            self.turns[1] = turn
        self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        content = text.rstrip(SPACE)
        blank = not content
        duplicate = not blank and mark in self.seen
        truncated = not blank and not duplicate and not content.endswith(STOPS)
        self.seen.add(mark)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.feed(role, text, blank or duplicate, truncated)

    def row(self):
        cost, audit = self.repair.finish()
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (self.key, min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.sha.hexdigest())


def _digests(batches, kind):
    """One row per conversation; rows come ordered by conversation, turn and kind."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", *names])

    current, out, held = None, [], 0
    for batch in batches:
        for key, turn, k, role, text, h1, h2 in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            if current is None or key != current.key:
                if current is not None:
                    out.append(current.row())
                    held += len(out[-1][7])
                    if len(out) >= 1000 or held > 1 << 20:
                        yield packed(out)
                        out, held = [], 0
                current = _Conversation(key)
            current.add(turn, k, role, text, (h1, h2))
    if current is not None:
        out.append(current.row())
    if out:
        yield packed(out)


def _edits(batches, kind):
    """One row per edit: what was written, or deleted, in order."""
    for rows in _edit_rows(batches):
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "place", "edit", "role", "text"])


def _edit_rows(batches, most: int = 1000):
    out: list[tuple] = []
    current, place = None, 0

    def put(letter, role, text):
        nonlocal place
        out.append((current.key, place, letter, role, text))
        place += 1

    for batch in batches:
        for key, turn, k, role, text, h1, h2 in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            if current is None or key != current.key:
                if current is not None:
                    current.repair.finish()
                place, current = 0, _Conversation(key, put)
            current.add(turn, k, role, text, (h1, h2))
            if len(out) >= most:
                yield out
                out.clear()
    if current is not None:
        current.repair.finish()
    if out:
        yield out


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults put in by crc32 of ``id:turn`` modulo 20; ``dropped`` marks those taken away.

    0 drops a turn, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user turn.  Nulls count
    as one space in the key, in roles and in texts.
    """
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(spaced(role_col)).alias("role"),
        text.alias("text"), (fault == 0).alias("dropped"), F.explode(times).alias("time"),
    ).drop("time")


def _marks(role: Column, text: Column) -> list[Column]:
    both = F.concat(role, F.lit("\n"), text)
    return [F.xxhash64(role, text).alias("h1"), (F.shiftleft(F.crc32(both.cast("binary")), 31) + F.length(both)).alias("h2")]


def _ordered(turns: DataFrame, id_col, turn_col, role_col, text_col, dropped_col) -> DataFrame:
    """Rows of each conversation together and in order, with marks where a role and text stood in an earlier turn."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    gone = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    rows = small_batches(turns).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(gone, 2).otherwise(1).alias("kind"),
        F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), *_marks(role, text),
    )
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    narrow = rows.where("kind = 1").select("conv_id", "turn", "h1", "h2")
    spread = narrow.groupBy("conv_id", "h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high")
    again = spread.select(F.col("conv_id").alias("of"), F.col("h1").alias("s1"), F.col("h2").alias("s2"), "low")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))
    later = narrow.join(again, same).where(place > F.col("low")).select("conv_id", "turn", "h1", "h2").distinct()
    nothing = F.lit(None).cast("string")
    marks = later.select("conv_id", "turn", F.lit(0).alias("kind"), nothing.alias("role"), nothing.alias("text"), "h1", "h2")
    return rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "kind", "role", "text")


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def audit(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """Faults, cheapest audit and repaired text of every conversation.

    Turns are taken by ``turn_col``, nulls first; turns of one number by role, then text.  A turn's first fault counts:
    blank (only white space), duplicate (role and text stood earlier in the conversation), truncated (does not end in
    ``.!?``).  Edits, in order, give roles whose initials are ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 2,
    Delete 3 (a must for blank and duplicate turns), Insert of an empty turn 2; a truncated turn that stays adds 1.
    The cheapest audit wins, of equal ones the least in ASCII order.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal (neighbouring roles other than su, ua, au), cost, audit
    and repaired_sha256 (``role:text`` lines joined by newlines).

    One shuffle brings a conversation's turns together in order; duplicates are found before it by hashes (128 bits), so
    a long conversation passes through its task as a stream: memory holds the turns still undecided, one letter a turn
    and the duplicates of one turn number.  (SHA-256 of a conversation is one chain, so its rows meet in one task.)

    Null ids are one conversation; null roles and texts count as one space.  Rows that ``dropped_col`` marks only keep
    their conversation in the result: without other rows it has zeros, an empty audit and the hash of nothing.  Rows
    that repeat one another wholly are duplicates.  Other columns are ignored; no rows give no rows.
    """
    rows = _ordered(turns, id_col, turn_col, role_col, text_col, dropped_col)
    kind = _arrow(rows, "conv_id")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return rows.mapInArrow(tidied(lambda b: _digests(b, kind)), schema)


def edits(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """The edits of ``audit`` one by one: conv_id, place (from 0), edit (D I K R), the role written (null if deleted) and text.

    The rows without D, by place, are the repaired conversation.  Rules and edge cases are those of ``audit``.
    """
    rows = _ordered(turns, id_col, turn_col, role_col, text_col, dropped_col)
    kind = _arrow(rows, "conv_id")
    return rows.mapInArrow(tidied(lambda b: _edits(b, kind)), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string")
