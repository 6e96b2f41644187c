"""Repair of conversations at least cost by dynamic programming over block tables (the method of the Four Russians).

A conversation's rows become symbols: the initial of the role and the row's fault. Costs of repairing the rest of a
conversation, one for each of four states (at the start, after a system, a user, an assistant row), differ from each
other by a few units only. So the vectors of costs, less their first entry, are a small closed set, and what a block of
BLOCK symbols does to any of them is precomputed: which vector it becomes and by how much the costs grow. Conversations
are processed from the last block to the first by lookup. To trace the edits, each block is expanded backward from the
vector at its end, row by row, and then read forward: the least edit that keeps the cost is taken, which is right for
ties, since the edits so far determine the state.

Rows are light on the way: their texts are replaced by digests until the repaired text is put together. They are dealt by
ranges of (conversation, turn, role, digest), so a crowded conversation lies in many partitions; of each partition the
driver sees the first and the last conversation's cost matrix and how states pass through it, and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from thermocline.llm.common import NO_ID, SPACE_BYTES, partitions, public_id
from thermocline.session import durable

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Symbols of a block that is looked up at once.
BLOCK = 4
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State that an inserted or changed row leads to.
_NEXT = (USER, USER, ASSISTANT, USER)
#: A symbol is 2 * initial + (1 if truncated), initials being s, u, a and any other; GONE must be deleted.
INITIALS, GONE = "sua", 8
_SYMBOLS = 9
#: Costs after the last row: nothing to add at the start or after an assistant row.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40


def _kept(state: int, initial: int) -> int | None:
    """State after keeping a row, None if it may not stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def _options(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What can be done to a row in a state: (edit, cost, state after it), in the order of ties."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED * (symbol % 2)
        if (after := _kept(state, symbol // 2)) is not None:
            out.append(("K", extra, after))
        out.append(("R", REROLE + extra, _NEXT[state]))
    return out


def _with_inserts(costs) -> tuple:
    once = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[_NEXT[s]]) for s, c in enumerate(once))


def step(symbol: int, after: tuple) -> tuple:
    """Costs of the four states before a row from those behind it."""
    return _with_inserts([min(cost + after[then] for _, cost, then in _options(s, symbol)) for s in range(4)])


def _normal(costs) -> tuple[tuple, int]:
    """Costs less the least, and the least; a state that cannot reach the end stays far."""
    least = min(costs)
    return tuple(c - least if c < _FAR else _FAR for c in costs), least


class Tables:
    """All normalised vectors, what one symbol and what a block does to each, and the edits each state takes."""

    def __init__(self, block: int = BLOCK):
        units = [tuple(0 if s == t else _FAR for s in range(4)) for t in range(4)]
        self.vectors, self.ids = [], {}
        todo = [_normal(x)[0] for x in (END, *(_with_inserts(u) for u in units))]
        moves = {}
        while todo:
            v = todo.pop()
            if v in self.ids:
                continue
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
            moves[v] = [_normal(step(x, v)) for x in range(_SYMBOLS)]
            todo += [w for w, _ in moves[v] if w not in self.ids]
        self.end = self.ids[_normal(END)[0]]
        self.units = [self.ids[_normal(_with_inserts(u))[0]] for u in units]
        self.next = np.array([[self.ids[w] for w, _ in moves[v]] for v in self.vectors])
        self.grow = np.array([[g for _, g in moves[v]] for v in self.vectors])
        # A block's code is its symbols to base 9, the first highest; its last symbol acts first.
        self.block = block
        self.block_next, self.block_grow = self.next, self.grow
        for _ in range(block - 1):
            later, grown = self.block_next, self.block_grow
            lead = self.next[later]  # vector, code of the later symbols, symbol before them
            self.block_next = lead.transpose(0, 2, 1).reshape(len(lead), -1)
            self.block_grow = (grown[:, :, None] + self.grow[later]).transpose(0, 2, 1).reshape(len(lead), -1)
        self.edits = [[[self._edits(v, x, s) for s in range(4)] for x in range(_SYMBOLS)] for v in self.vectors]

    def _edits(self, after: tuple, symbol: int, state: int) -> tuple[str, int] | None:
        """Edits up to and with this row, least of those of least cost, and the state behind it."""
        before, made = step(symbol, after), ""
        if before[state] >= _FAR:
            return None
        while True:
            here = before[state]
            for edit, cost, then in _options(state, symbol)[:1]:
                if cost + after[then] == here:
                    return made + edit, then
            if INSERT + before[_NEXT[state]] == here:
                made, state = made + "I", _NEXT[state]
                continue
            for edit, cost, then in _options(state, symbol)[1:]:
                if cost + after[then] == here:
                    return made + edit, then

    def _codes(self, symbols: np.ndarray) -> list[int]:
        """Codes of the whole blocks that end with the last symbol."""
        whole = symbols[len(symbols) % self.block:].reshape(-1, self.block)
        return (whole @ (_SYMBOLS ** np.arange(self.block - 1, -1, -1))).tolist()

    def costs(self, symbols: np.ndarray, after: int) -> tuple[int, int, list[int]]:
        """(vector before the symbols, growth, vectors behind each whole block from the last to the first)."""
        ends, grown, v = [], 0, after
        for code in reversed(self._codes(symbols)):
            ends.append(v)
            grown += int(self.block_grow[v, code])
            v = int(self.block_next[v, code])
        for x in symbols[:len(symbols) % self.block][::-1].tolist():
            grown += int(self.grow[v, x])
            v = int(self.next[v, x])
        return v, grown, ends

    def trace(self, symbols: np.ndarray, after: int, state: int) -> tuple[list[str], int]:
        """Edits of each row and the state behind the last."""
        _, _, ends = self.costs(symbols, after)
        made, head = [], len(symbols) % self.block
        starts = [0, *range(head, len(symbols), self.block)] if head else list(range(0, len(symbols), self.block))
        stops = [*starts[1:], len(symbols)]
        tails = ends[::-1]
        if head:
            first = after if not tails else int(self.block_next[tails[0], self._codes(symbols)[0]])
            tails = [first, *tails]
        for start, stop, tail in zip(starts, stops, tails):
            row, behind = symbols[start:stop].tolist(), [tail]
            for x in row[:0:-1]:
                behind.append(int(self.next[behind[-1], x]))
            for x, v in zip(row, behind[::-1]):
                edit, state = self.edits[v][x][state]
                made.append(edit)
        return made, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Edits behind the last row."""
    return "I" * (END[state] // INSERT)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id (null as NO_ID), turn, role, text and m (times it stands there): rows with the planned damage.

    Null texts and roles become one space. By crc32(`conv_id:turn`) % 20, a null among them as one space: 0 drops a row, 1
    empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    return (rows.withColumn("_k", kind).where("_k <> 0").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_k") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(_text(), "[.!?]", "")).otherwise(_text()).alias("text"),
        F.when(F.col("_k") == 3, 2).otherwise(1).cast("long").alias("m")))


def as_they_are(rows: DataFrame) -> DataFrame:
    """Rows as `repair` takes them, without damage."""
    return rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), _text().alias("text"),
                       F.lit(1).cast("long").alias("m"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(" "))


def _light(rows: DataFrame) -> DataFrame:
    """Distinct rows by digest with their number m, blank, cut, and first (no earlier turn has the same role and text)."""
    last = F.substring(F.rtrim("text", F.lit(SPACE_BYTES.decode())), -1, 1)
    light = (rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"),
                         (~last.isin(".", "!", "?")).alias("cut"), "m")
             .groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("m").alias("m")))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("least"))
    return (light.join(firsts, ["conv_id", "role", "digest"])
            .select("conv_id", "turn", "role", "digest", "blank", "cut", "m", at.eqNullSafe(F.col("least")).alias("first")))


_RUN = "conv_id long, edge int, part int, matrix array<long>, path array<int>"


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each distinct row, how many further copies of it follow, all to be deleted)."""
    role, blank, cut, first, m = (batch.column(i) for i in (2, 4, 5, 7, 6))
    initial = np.fromiter((INITIALS.find(r[:1]) if r else -1 for r in role.to_pylist()), "i8", len(role))
    symbol = 2 * np.where(initial < 0, 3, initial) + cut.to_numpy(zero_copy_only=False)
    gone = blank.to_numpy(zero_copy_only=False) | ~first.to_numpy(zero_copy_only=False)
    return np.where(gone, GONE, symbol), m.to_numpy() - 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bool, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of one conversation in a sorted partition: (conv_id, is the first, is the last, rows, symbols, copies)."""
    held, first = [], True

    def run(last):
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole.column(0)[0].as_py(), first, last, whole, *_symbols(whole)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != int(ids[a]):
                yield run(False)
                held, first = [], False
            held.append(batch.slice(a, b - a))
    if held:
        yield run(True)


def _spread(symbols: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Symbols with the copies that follow them."""
    if not copies.any():
        return symbols
    out = np.full(int(len(symbols) + copies.sum()), GONE)
    out[np.arange(len(symbols)) + np.r_[0, np.cumsum(copies)[:-1]]] = symbols
    return out


def _edges(ends=None):
    """What the first and the last conversation of a partition do: the cost of going from each state to each end; with
    `ends` (vectors behind those runs), the state that each state leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, out = tables(), TaskContext.get().partitionId(), []
        for conv_id, first, last, _, symbols, copies in _runs(batches):
            if not (first or last):
                continue
            row = _spread(symbols, copies)
            if ends is None:
                columns = []
                for u in own.units:
                    v, grown, _ = own.costs(row, u)
                    columns.append([c + grown if c < _FAR else _FAR for c in own.vectors[v]])
                out.append((conv_id, 0 if first else 1, part, np.array(columns).T.ravel().tolist(), []))
            else:
                tail = ends.value[part, conv_id]
                out.append((conv_id, 0 if first else 1, part, [], [own.trace(row, tail, s)[1] for s in range(4)]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                         names=["conv_id", "edge", "part", "matrix", "path"])

    return run


def _edits(borders):
    """conv_id, turn, role, digest, edits (up to this row and its copies), behind (after the last row), blank, cut, m, first."""
    names = ["conv_id", "turn", "role", "digest", "edits", "behind", "blank", "cut", "m", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tables(), TaskContext.get().partitionId()
        held, size = [], 0
        for conv_id, first, last, rows, symbols, copies in _runs(batches):
            tail, state, ends_here = borders.value.get((part, conv_id), (own.end, START, True))
            made, state = own.trace(_spread(symbols, copies), tail, state)
            if copies.any():
                at = np.r_[0, np.cumsum(copies + 1)].tolist()
                made = ["".join(made[a:b]) for a, b in zip(at, at[1:])]
            behind = [""] * len(symbols)
            behind[-1] = closing(state) if ends_here else ""
            held.append(pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(made), pa.array(behind), *rows.columns[4:]], names=names))
            size += len(symbols)
            if size >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _chain(pieces: list) -> dict:
    """Vector behind each border piece (part, conv_id), from the matrices of the pieces behind it in the conversation."""
    own, ends = tables(), {}
    behind: dict[int, tuple] = {}
    for r in sorted(pieces, key=lambda r: -r.part):
        after = behind.get(r.conv_id, END)
        ends[r.part, r.conv_id] = own.ids[_normal(after)[0]]
        costs = np.array(r.matrix).reshape(4, 4)
        behind[r.conv_id] = tuple(int(min(c + a for c, a in zip(row, after))) for row in costs)
    return ends


def _solve(light: DataFrame) -> DataFrame:
    """Least edits of every row of `light`, in partitions of (conv_id, turn, role, digest) ranges."""
    sc = light.sparkSession.sparkContext
    dealt = durable(light.repartitionByRange(partitions(light.sparkSession), "conv_id", "turn", "role", "digest")
                    .sortWithinPartitions("conv_id", "turn", "role", "digest"))
    pieces = dealt.mapInArrow(_edges(), _RUN).collect()  # two rows a partition at most
    many = {c for c, n in zip(*np.unique([r.conv_id for r in pieces], return_counts=True)) if n > 1} if pieces else set()
    pieces = [r for r in pieces if r.conv_id in many]
    borders = {}
    if pieces:
        ends = _chain(pieces)
        whole = sc.broadcast(_Default(ends))
        paths = {(r.part, r.conv_id): r.path for r in dealt.mapInArrow(_edges(whole), _RUN).collect()}
        state: dict[int, int] = {}
        last = {r.conv_id: max(p.part for p in pieces if p.conv_id == r.conv_id) for r in pieces}
        for r in sorted(pieces, key=lambda r: r.part):
            start = state.get(r.conv_id, START)
            borders[r.part, r.conv_id] = (ends[r.part, r.conv_id], start, r.part == last[r.conv_id])
            state[r.conv_id] = paths[r.part, r.conv_id][start]
    schema = ("conv_id long, turn long, role string, digest binary, edits string, behind string, blank boolean, cut boolean, "
              "m long, first boolean")
    return dealt.mapInArrow(_edits(sc.broadcast(borders)), schema)


class _Default(dict):
    """Runs that lie in one partition end with their conversation."""

    def __missing__(self, key):
        return tables().end


_OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")
_COST = {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}


class _Report:
    """One conversation as its rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.hash, self.empty = conv_id, START, [], hashlib.sha256(), True
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.least = self.most = self.initial = None

    def _line(self, role: str, text: str):
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self):
        self.state = _NEXT[self.state]
        self._line(ROLES[self.state], "")

    def add(self, turn, role, edits, behind, blank, cut, m, first, text):
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        fine = first and not blank
        self.blank += m if blank else 0
        self.duplicate += 0 if blank else m - 1 if first else m
        self.truncated += 1 if fine and cut else 0
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += m - 1
        self.initial = initial
        self.audit.append(edits + behind)
        self.cost += sum(_COST[e] for e in edits + behind)
        for e in edits:
            if e == "I":
                self._insert()
            elif e != "D":
                self.state = _kept(self.state, INITIALS.find(initial)) if e == "K" else _NEXT[self.state]
                self._line(role if e == "K" else ROLES[self.state], text)
                self.cost += TRUNCATED if cut else 0
        for _ in behind:
            self._insert()

    def row(self):
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, place and kind: a row of edits, then the texts that have its digest."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    report, row, done = None, None, []

    def settle(text):
        if row is not None:
            report.add(*row, text)

    for batch in batches:
        for conv_id, turn, role, kind, edits, behind, blank, cut, m, first, text in zip(*(batch.column(i).to_pylist() for i in range(11))):
            if kind:  # the text of the row before it; further copies are alike
                settle(text)
                row = None
                continue
            if report is None or report.conv_id != conv_id:
                if report is not None:
                    done.append(report.row())
                report = _Report(conv_id)
            row = (turn, role, edits, behind, blank, cut, m, first)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
            done = []
    if report is not None:
        done.append(report.row())
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation.

    `rows` are those of `damage` or `as_they_are`; `conversations` (conv_id) names all of them, also those without rows.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows stand by turn (nulls first), those of one turn by role and the SHA-256 of their text, equal rows side by side. A
    null or empty text is blank, a null role stands for one space and can only be given another role or deleted. Edits are
    Delete 4, Insert 3, Keep 0 and Rerole 3, a truncated row that stays 3 more; ties fall to the audit least by ASCII. A
    null conv_id is a conversation of its own. A conversation without rows has zeros, an empty audit and the hash of an
    empty text; an empty table gives no rows. Columns other than conv_id, turn, role and text are ignored.

    A conversation's audit and digest are one value each, so its texts pass through one task in order, one at a time; no
    task holds them together. Its rows are otherwise dealt by ranges, however many it has.
    """
    edits = _solve(_light(rows))
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    columns = ("conv_id", "turn", "role", "digest", "kind", "edits", "behind", "blank", "cut", "m", "first", "text")
    both = (edits.withColumns({"kind": F.lit(0), "text": F.lit(None).cast("string")}).select(*columns)
            .unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True))
    dealt = (both.repartition(partitions(rows.sparkSession), "conv_id")
             .sortWithinPartitions("conv_id", "turn", "role", "digest", "kind").drop("digest"))
    found = dealt.mapInArrow(_reports, _OUT)
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id")).distinct()
    full = every.join(found, "conv_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return full.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")),
                             "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)), "conv_id": public_id("conv_id")})
