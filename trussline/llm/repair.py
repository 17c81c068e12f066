"""Repair of conversation structure at least cost, by Viterbi over chunks of rows that run in parallel.

A repaired conversation's roles are an optional system turn and then turns of user and assistant, or nothing. The states are what was put out last: START (nothing), S, U, A; a
conversation may end in START or A. Each row is kept, gets another role, or is deleted; an empty turn may be inserted anywhere. The cost-to-go of the four states is worked out from the end of a conversation
to its beginning; then the edits are traced from START, always by the letter of least ASCII code that still reaches the least cost. A letter determines the next state, so this gives the least audit.

A conversation may have any number of rows, so it is cut into chunks. All chunks run at once, each from a speculative cost vector; a fix-up pass runs those again whose successor begins with another vector than
was assumed, backwards and only until old and new vectors differ by a constant: from there on all costs are shifted, no choice changes (rank convergence). Where passes don't settle a conversation (rows that no state gains from
never pull the vectors together), its chunks' 4 x 4 cost matrices are multiplied in doubling steps, so rounds grow with the logarithm of its chunks. Stitched end vectors then let each chunk trace its edits from
each of the four states; a chunk's state at entry is known as soon as a chunk before it leaves in one state whatever it was entered in, else the state maps are composed in doubling steps as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.common import cut, written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a chunk; fix-up passes before matrices are used.
CHUNK_ROWS, CHUNK_BYTES, PASSES = 4096, 1 << 20, 4
#: Conversations of one chunk whose edits a worker remembers by their rows' codes.
REMEMBERED = 1 << 16
START, S, U, A = range(4)
FAR = 1 << 60
#: Costs to go at the end of a conversation: from U an assistant turn is inserted, from S both.
TERMINAL, SPECULATIVE = (0, 2 * INSERT, INSERT, 0), (0, 0, 0, 0)
#: State after a user or assistant turn is put out, by state; and whether it is the user's.
_NEXT, _IS_USER = (U, U, A, U), (True, True, False, True)
#: State after a row of this initial is kept, by state; None: it may not stand there.
_KEPT = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None), "x": (None,) * 4}
WHITE = " \t\n\x0b\x0c\r"

# A row's code: the initial of its role (s, u, a, else x), as a capital if the text is truncated, or d if it has to be deleted.


def _before(code: str, h: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, from those after it."""
    if code == "d":
        return tuple(x + DELETE for x in h)
    kept, extra = _KEPT[code.lower()], TRUNCATED * code.isupper()
    out = [min(h[i] + DELETE, h[_NEXT[i]] + REROLE + extra, FAR if kept[i] is None else h[kept[i]] + extra) for i in range(4)]
    return _inserted(out)


def _inserted(h) -> tuple[int, ...]:
    u, a = min(h[U], h[A] + INSERT), min(h[A], h[U] + INSERT)
    return (min(h[START], u + INSERT), min(h[S], u + INSERT), u, a)


def costs(codes: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go before each row of a chunk and, last, at its end."""
    out = [end]
    for code in reversed(codes):
        out.append(_before(code, out[-1]))
    return out[::-1]


def alike(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether two vectors differ by a constant alone."""
    return len({x - y for x, y in zip(a, b, strict=True)}) == 1


def fixed_up(codes: str, assumed: tuple[int, ...], begin: tuple[int, ...], end: tuple[int, ...]) -> tuple[int, ...]:
    """The vector at a chunk's begin for another vector at its end than was assumed, run only as far as it takes the two to differ by a constant."""
    for code in reversed(codes):
        if alike(assumed, end):
            break
        assumed, end = _before(code, assumed), _before(code, end)
    shift = end[0] - assumed[0]
    return tuple(x + shift for x in begin) if alike(assumed, end) else end


def matrix(codes: str) -> list[int]:
    """Least cost from each state at the begin to each at the end, row by row."""
    columns = [costs(codes, tuple(0 if i == j else FAR for i in range(4)))[0] for j in range(4)]
    return [min(columns[j][i], FAR) for i in range(4) for j in range(4)]


def trace(codes: str, h: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int, list[int]]:
    """Edits from a state on, the state at the end, and whose each put out turn is: 0 the row's own, 1 user, 2 assistant (for letters other than D)."""
    letters, whose, i, n = [], [], 0, len(codes)
    while i < n or last and state in (S, U):
        here = h[i][state]
        if i < n and here == h[i + 1][state] + DELETE:
            letters.append("D")
            i += 1
            continue
        nxt = _NEXT[state]
        if here == h[i][nxt] + INSERT:
            letters.append("I"), whose.append(1 if _IS_USER[state] else 2)
            state = nxt
            continue
        code = codes[i]
        kept, extra = _KEPT[code.lower()][state], TRUNCATED * code.isupper()
        if kept is not None and here == h[i + 1][kept] + extra:
            letters.append("K"), whose.append(0)
            state = kept
        else:
            letters.append("R"), whose.append(1 if _IS_USER[state] else 2)
            state = nxt
        i += 1
    return "".join(letters), state, whose


@lru_cache(REMEMBERED)
def _whole(codes: str) -> tuple[str, list[int]]:
    letters, _, whose = trace(codes, costs(codes, TERMINAL), START, True)
    return letters, whose


_NAMES = (None, "user", "assistant")


def repaired(letters: str, whose: list[int], codes: str, roles: list[str], texts: list[str]) -> tuple[int, list[str]]:
    """Cost of the edits and the lines of the repaired rows. roles, texts: of the rows that need not be deleted."""
    lines, total, own, put, at = [], 0, 0, 0, 0
    for letter in letters:
        if letter == "I":
            total += INSERT
            lines.append(f"{_NAMES[whose[put]]}:")
            put += 1
            continue
        code = codes[at]
        at += 1
        if letter == "D":
            total += DELETE
        else:
            total += (REROLE if letter == "R" else 0) + TRUNCATED * code.isupper()
            lines.append(f"{_NAMES[whose[put]] or roles[own]}:{texts[own]}")
            put += 1
        own += code != "d"
    return total, lines


_CHUNK = "conv_id long, part int, seq long, codes string, roles array<string>, texts array<string>, first string, last string, low long, high long, nulls boolean, turns long, rows long, blank long, duplicate long, truncated long, illegal long, more boolean"
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    """A chunk in the making."""

    def __init__(self, conv, part: int, seq: int):
        self.conv, self.part, self.seq = conv, part, seq
        self.codes, self.roles, self.texts, self.size = [], [], [], 0
        self.first = self.last = self.low = self.high = self.turn = None
        self.nulls, self.turns, self.blank, self.duplicate, self.truncated, self.illegal = False, 0, 0, 0, 0, 0

    def add(self, turn, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.codes:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is None:
            self.nulls = True
        elif turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if blank or duplicate:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            self.codes.append("d")
            return
        code = initial if initial in ("s", "u", "a") else "x"
        self.truncated += truncated
        self.codes.append(code.upper() if truncated else code)
        self.roles.append(role), self.texts.append(text)
        self.size += len(text)

    def row(self, more: bool) -> tuple:
        return (self.conv, self.part, self.seq, "".join(self.codes), self.roles, self.texts, self.first, self.last, self.low, self.high, self.nulls, self.turns, len(self.codes), self.blank, self.duplicate, self.truncated, self.illegal, more)


def _chunks(chunk_rows: int, chunk_bytes: int):
    """Rows in order, cut into chunks; `more`: the conversation goes on in this partition."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, chunk = TaskContext.get().partitionId(), 0, None
        done: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], _CHUNK_NAMES)
            done.clear()
            return out

        for batch in batches:
            columns = [batch[c] for c in ("conv_id", "turn", "role", "text", "copies", "blank", "repeated", "truncated")]
            for at in range(0, batch.num_rows, 1024):
                for conv, turn, role, text, copies, blank, repeated, truncated in zip(*(c.slice(at, 1024).to_pylist() for c in columns), strict=True):
                    for k in range(copies):
                        if chunk is not None and (chunk.conv != conv or len(chunk.codes) >= chunk_rows or chunk.size >= chunk_bytes):
                            done.append(chunk.row(chunk.conv == conv))
                            held += chunk.size
                            chunk = None
                            if held >= chunk_bytes or len(done) >= 4096:
                                yield made()
                                held = 0
                        if chunk is None:
                            chunk = _Chunk(conv, part, seq)
                            seq += 1
                        chunk.add(turn, role, text, blank, repeated or k > 0, truncated)
        if chunk is not None:
            done.append(chunk.row(False))
        if done:
            yield made()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that a conversation's id and turn call for: dropped (copies 0), emptied, without full stops, doubled, or with role user."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.pmod(F.crc32(F.concat_ws(":", filled[0], filled[1])), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled[2].alias("role"), filled[3].alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _doubling(df: DataFrame, joined: str, value, reach: int) -> DataFrame:
    """df (g, conv, value, ...) with value composed with that of the row `reach` numbers away where it is of the same conversation."""
    other = df.select((F.col("g") - reach).alias("g"), F.col("conv_id").alias("__conv"), F.col(joined).alias("__far"))
    there = F.col("__far").isNotNull() & F.col("conv_id").eqNullSafe(F.col("__conv"))
    return written(df.join(other, "g", "left").withColumn(joined, F.when(there, value(F.col(joined), F.col("__far"))).otherwise(F.col(joined))).drop("__conv", "__far"), "repair-steps")


def _product(m, n):
    """Product of two 4 x 4 matrices of costs."""
    cell = lambda at: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: m[F.floor(at / 4).cast("int") * 4 + k] + n[k * 4 + at % 4]))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda at: F.least(cell(at), F.lit(FAR)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass, and fix-ups where a chunk has a begin already."""
    for batch in batches:
        begin = []
        for codes, assumed, old, end in zip(*(batch[c].to_pylist() for c in ("codes", "assumed", "begin", "end")), strict=True):
            begin.append(list(costs(codes, tuple(end))[0] if old is None else fixed_up(codes, tuple(assumed), tuple(old), tuple(end))))
        yield pa.RecordBatch.from_arrays([batch["g"], batch["conv_id"], batch["n"], batch["place"], batch["codes"], batch["end"], pa.array(begin, pa.list_(pa.int64()))], ["g", "conv_id", "n", "place", "codes", "assumed", "begin"])


_RUN = "g long, conv_id long, n long, place long, codes string, assumed array<long>, begin array<long>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["g"], batch["conv_id"], pa.array([matrix(c) for c in batch["codes"].to_pylist()], pa.list_(pa.int64()))], ["g", "conv_id", "m"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each chunk by that at its begin."""
    for batch in batches:
        out = []
        for codes, end, last in zip(*(batch[c].to_pylist() for c in ("codes", "end", "is_last")), strict=True):
            h = costs(codes, tuple(end))
            out.append([trace(codes, h, s, last)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch["g"], batch["conv_id"], pa.array(out, pa.list_(pa.int32()))], ["g", "conv_id", "to"])


def _array(values) -> F.Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def end_vectors(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """g, end: the true costs to go at each chunk's end, up to a constant. chunks: g (numbers of a conversation's chunks follow one another), conv_id, n, place, codes."""
    first = F.when(F.col("place") == F.col("n") - 1, _array(TERMINAL)).otherwise(_array(SPECULATIVE))
    none = F.lit(None).cast("array<long>")
    state = written(chunks.select("g", "conv_id", "n", "place", "codes", none.alias("assumed"), none.alias("begin"), first.alias("end")).mapInArrow(_run, _RUN), "repair-pass")

    def with_true_end(state: DataFrame) -> DataFrame:
        after = state.select((F.col("g") - 1).alias("g"), F.col("begin").alias("end"))
        inner = state.where("place < n - 1").join(after, "g")
        off = F.size(F.array_distinct(F.zip_with("assumed", "end", lambda x, y: x - y))) > 1
        return inner.withColumn("off", off)

    for _ in range(passes):
        seen = written(with_true_end(state), "repair-ends")
        if not seen.where("off").head(1):
            return seen.select("g", "end").union(state.where("place = n - 1").select("g", F.col("assumed").alias("end")))
        again = seen.where("off").drop("off").mapInArrow(_run, _RUN)
        state = written(state.join(seen.where("off").select("g"), "g", "left_anti").select(again.columns).union(again), "repair-pass")
    # a chunk's end is the product of all matrices after it, from the terminal vector
    m = cut(chunks.select("g", "conv_id", "codes").mapInArrow(_matrices, "g long, conv_id long, m array<long>"))
    reach, longest = 1, chunks.agg(F.max("n")).first()[0] or 0
    while reach < longest:
        m = _doubling(m, "m", _product, reach)
        reach *= 2
    begin = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.col("m")[i * 4 + j] + _array(TERMINAL)[j])))
    inner = m.select((F.col("g") - 1).alias("g"), begin.alias("end")).join(chunks.where("place < n - 1").select("g"), "g", "left_semi")
    return inner.union(chunks.where("place = n - 1").select("g", _array(TERMINAL).alias("end")))


def entry_states(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """g, end, entry: the state in which each chunk is entered."""
    with_end = cut(chunks.join(ends, "g").select("g", "conv_id", "n", "place", "codes", "end", (F.col("place") == F.col("n") - 1).alias("is_last")))
    maps = with_end.select("g", "conv_id", "codes", "end", "is_last").mapInArrow(_maps, "g long, conv_id long, to array<int>")
    maps = cut(maps.join(with_end.select("g", "place"), "g"))
    reach, longest = 1, chunks.agg(F.max("n")).first()[0] or 0
    # maps of a chunk and those before it; one that leaves in a single state needs none before it
    settled = (F.size(F.array_distinct("to")) == 1) | (F.col("place") < reach)
    while reach < longest and maps.where(~settled).head(1):
        maps = _doubling(maps, "to", lambda own, far: F.transform(far, lambda x: own[x]), -reach)
        reach *= 2
        settled = (F.size(F.array_distinct("to")) == 1) | (F.col("place") < reach)
    left = maps.select((F.col("g") + 1).alias("g"), F.col("to")[START].alias("entry"))
    return with_end.join(left, "g", "left").select("g", "end", F.when(F.col("place") == 0, START).otherwise(F.col("entry")).alias("entry"))


_PIECE = "g long, conv_id long, place long, n long, cost long, audit string, lines string, sha string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired text of each chunk; of a conversation of one chunk the hash in place of the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            total, audits, bodies, shas = [], [], [], []
            for n, place, codes, roles, texts, end, entry in zip(*(part[c].to_pylist() for c in ("n", "place", "codes", "roles", "texts", "end", "entry")), strict=True):
                if n == 1:
                    letters, whose = _whole(codes)
                else:
                    letters, _, whose = trace(codes, costs(codes, tuple(end)), entry, place == n - 1)
                spent, lines = repaired(letters, whose, codes, roles, texts)
                body = "\n".join(lines)
                total.append(spent), audits.append(letters)
                bodies.append(body if n > 1 and lines else None)
                shas.append(hashlib.sha256(body.encode()).hexdigest() if n == 1 else None)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("g", "conv_id", "place", "n")), pa.array(total, pa.int64()), *(pa.array(x, pa.string()) for x in (audits, bodies, shas))], [x.split()[0] for x in _PIECE.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one row a conversation; only the audit is held, the text goes through the hash."""
    conv = sha = None
    audit: list[str] = []
    total, some = 0, False

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([total], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "cost", "audit", "sha"])

    for batch in batches:
        for i in range(batch.num_rows):
            own, place, spent, letters, body = (batch[c][i].as_py() for c in ("conv_id", "place", "cost", "audit", "lines"))
            if place == 0:
                if sha is not None:
                    yield made()
                conv, sha, audit, total, some = own, hashlib.sha256(), [], 0, False
            total += spent
            audit.append(letters)
            if body is not None:
                sha.update((b"\n" if some else b"") + body.encode())
                some = True
    if sha is not None:
        yield made()


def numbered_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Conversations in order as chunks, with g (dense in that order), n (chunks of the conversation) and place (0 for its first).

    rows: conv_id, turn, role, text, copies. Equal rows are counted before they are sorted, so a row that comes millions of times is one. A row is repeated if its role and text stand at a smaller turn of the conversation.
    Partitions are ranges of (conv_id, turn, role, text): a long conversation is spread over many.
    """
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    merged = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    again = merged.groupBy(F.col("conv_id").alias("__conv"), F.col("key").alias("__key")).agg(F.min(turn).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    marked = merged.join(again, (F.col("key") == F.col("__key")) & F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    trimmed = F.rtrim("text", F.lit(WHITE))
    marked = marked.select("conv_id", "turn", "role", "text", "copies", (trimmed == "").alias("blank"), F.coalesce(turn > F.col("__first"), F.lit(False)).alias("repeated"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = ["conv_id", "turn", "role", "text"]
    chunks = cut(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks(chunk_rows, chunk_bytes), _CHUNK))
    # one small row for each partition
    base = chunks.groupBy("part").agg(F.count("*").alias("size")).select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("base"))
    numbered = chunks.join(base, "part").withColumn("g", F.col("base") + F.col("seq")).drop("base", "seq", "part", "more")
    span = numbered.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("g").alias("__low"), F.count("*").alias("n"))
    return cut(numbered.join(span, F.col("conv_id").eqNullSafe(F.col("__conv"))).withColumn("place", F.col("g") - F.col("__low")).drop("__conv", "__low"))


def conversation_facts(chunks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal: sums over chunks, and what stands where two of them meet."""
    after = chunks.where("n > 1").select((F.col("g") - 1).alias("g"), F.col("first").alias("then"), F.col("low").alias("low_then"))
    meet = chunks.where("place < n - 1").join(after, "g").select(
        "conv_id", (~F.concat("last", "then").isin(*_LEGAL)).cast("long").alias("illegal"), F.coalesce((F.col("high") == F.col("low_then")).cast("long"), F.lit(0)).alias("same_turn")
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    zero = F.lit(0).cast("long")
    every = chunks.select("conv_id", "low", "high", "blank", "duplicate", "truncated", "illegal", "turns").union(meet.select("conv_id", F.lit(None), F.lit(None), zero, zero, zero, "illegal", -F.col("same_turn")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), zero)
    return every.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *sums).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def repair_pieces(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """Edits, cost and repaired text of each chunk: g, conv_id, place, n, cost, audit, lines (null: none), sha (of a conversation of one chunk, instead of lines)."""
    long = cut(chunks.where("n > 1").select("g", "conv_id", "n", "place", "codes"))
    fields = ["g", "conv_id", "place", "n", "codes", "roles", "texts"]
    short = chunks.where("n = 1").select(*fields, F.lit(None).cast("array<long>").alias("end"), F.lit(START).alias("entry"))
    if long.head(1):
        short = short.union(chunks.where("n > 1").select(fields).join(entry_states(long, end_vectors(long, passes)), "g").select(*fields, "end", "entry"))
    return short.mapInArrow(_pieces, _PIECE)


def repair_conversations(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, passes: int = PASSES) -> DataFrame:
    """Cheapest repair of each conversation: one row for each conv_id, null being one of them.

    Input: conv_id (integer), turn (integer), role, text (strings without nulls), copies (how often the row stands there; 0: a row that is gone). Rows are taken by turn, nulls first; rows of one turn by
    role and text. Output: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired_sha256 (of the lines `role:text`). A conversation without rows has zeros, no edits and the hash of
    nothing. Empty tables give no rows. A conversation's audit is one cell, and the hash of one that has many chunks runs through one task, chunk by chunk: that is the nature of such a hash.
    """
    chunks = numbered_chunks(rows.select("conv_id", "turn", "role", "text", "copies"), chunk_rows, chunk_bytes)
    pieces = cut(repair_pieces(chunks, passes))
    whole = pieces.where("n = 1").select("conv_id", "cost", "audit", "sha")
    many = pieces.where("n > 1")
    if many.head(1):
        many = many.select("conv_id", "place", "cost", "audit", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "place")
        whole = whole.union(many.mapInArrow(_joined, "conv_id long, cost long, audit string, sha string"))
    facts = conversation_facts(chunks).withColumnRenamed("conv_id", "__conv")
    zero = F.lit(0).cast("long")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = whole.join(facts, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", *names, "audit", F.col("sha").alias("repaired_sha256"))
    gone = rows.groupBy("conv_id").agg(F.max("copies").alias("copies")).where("copies = 0")
    return found.union(gone.select("conv_id", *[zero.alias(c) for c in names], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
