"""Cheapest repair of conversation structure by a rank-convergence parallel Viterbi search.

A repaired conversation is an optional system turn and then user and assistant turns in pairs.
Each row is kept, given another role or deleted, empty turns may be put in anywhere, and the
cheapest edits are wanted. With four places in that grammar, backward costs are vectors of four
numbers, and a row is a (min, +) product with such a vector.

Rows are range-partitioned in order and cut into chunks of bounded rows and bytes, so that a
conversation with a third of all rows is spread like any other. Each chunk is solved backwards
from a *speculative* cost vector, that of a conversation's end. What is left of it after a few
rows mostly differs from the true one by a constant, which no choice depends on: the products
have converged to rank one. Fix-up passes run over chunk borders only: a chunk whose successor
turned out to hand it a vector of another direction is run again, until its inner vectors differ
from those before only by a constant. A pass that leaves no chunk to run again ends this; then
every chunk knows its true vector but for a constant.

Tracing goes forwards by these stitched vectors and takes the least edit letter that keeps the
cost. A chunk's trace depends on the place it is entered in: chunks say where each of the four
places leads, a stream over the borders gives the true one, and the chunks are traced at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow, kept

CHUNK_ROWS, CHUNK_BYTES = 4_096, 1 << 20

#: Places: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads from each place, and its role.
_ON = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Costs to finish from each place when no row is left.
END = (0, 6, 3, 0)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
#: What a row is to the search: a deletion that is forced, or initial and truncation.
_FORCED = 8
_INITIALS = "sua"


def _closed(w: list[int]) -> list[int]:
    """Costs once turns may be put in before the row."""
    u, a = min(w[USER], INSERT + w[ASSISTANT]), min(w[ASSISTANT], INSERT + w[USER])
    return [min(w[START], INSERT + u), min(w[SYSTEM], INSERT + u), u, a]


def _edits(code: int, place: int) -> list[tuple[str, int, int]]:
    """`letter, cost, place after` of the edits of a row, by letter."""
    if code == _FORCED:
        return [("D", DELETE, place)]
    cut, out = TRUNCATED * (code & 1), [("D", DELETE, place)]
    kept_at = _KEEP.get(_INITIALS[code >> 1], {}).get(place) if code >> 1 < 3 else None
    if kept_at is not None:
        out.append(("K", cut, kept_at))
    return [*out, ("R", RELABEL + cut, _ON[place])]


class Viterbi:
    """Backward products and forward choices on cost vectors whose least entry is 0. There are
    few such vectors, so both are looked up once they have been worked out."""

    def __init__(self):
        self._back: dict[tuple, tuple] = {}
        self._choice: dict[tuple, tuple] = {}

    def back(self, code: int, after: tuple) -> tuple[tuple, int]:
        """The vector before a row, and the constant taken off it."""
        known = self._back.get((code, after))
        if known is None:
            w = _closed([min(c + after[to] for _, c, to in _edits(code, p)) for p in range(4)])
            known = self._back[code, after] = tuple(x - min(w) for x in w), min(w)
        return known

    def choice(self, code: int, after: tuple, place: int) -> tuple[str, int, int]:
        """Letters up to and with the row's own edit, the place after, and their cost."""
        known = self._choice.get((code, after, place))
        if known is None:
            before, taken = self.back(code, after)
            letters, p, spent = "", place, 0
            while True:
                best = before[p] + taken
                here = next(((x, c, to) for x, c, to in _edits(code, p) if c + after[to] == best), None)
                # Letters in order are D, I, K, R: a turn is put in unless deleting is as cheap.
                if (here is None or here[0] != "D") and INSERT + before[_ON[p]] + taken == best:
                    letters, p, spent = letters + "I", _ON[p], spent + INSERT
                    continue
                known = letters + here[0], here[2], spent + here[1]
                break
            self._choice[code, after, place] = known
        return known

    def run(self, codes: bytes, after: tuple) -> tuple:
        for code in reversed(codes):
            after = self.back(code, after)[0]
        return after

    def again(self, codes: bytes, after: tuple, earlier: tuple, result: tuple) -> tuple:
        """The vector before the chunk for another one after it: once the inner vectors differ
        from those of an earlier run by a constant only, its result holds."""
        for code in reversed(codes):
            if after == earlier:
                return result
            after, earlier = self.back(code, after)[0], self.back(code, earlier)[0]
        return after

    def vectors(self, codes: bytes, after: tuple) -> list[tuple]:
        out = [after]
        for code in reversed(codes):
            out.append(self.back(code, out[-1])[0])
        return out[::-1]

    def leads(self, codes: bytes, after: tuple) -> list[int]:
        """Where each place on entry leads."""
        vectors, places = self.vectors(codes, after), [0, 1, 2, 3]
        for k, code in enumerate(codes):
            places = [self.choice(code, vectors[k + 1], p)[1] for p in places]
        return places


def solve(v: Viterbi, chunk: dict, after: tuple, place: int, last: bool) -> tuple[str, list[str], int]:
    """Audit letters, repaired lines and cost of a chunk entered in `place`."""
    codes, lines, audit, cost = chunk["codes"], [], [], 0
    vectors = v.vectors(codes, after)
    for k, (code, copies, role, text) in enumerate(zip(codes, chunk["copies"], chunk["roles"], chunk["texts"])):
        letters, to, spent = v.choice(code, vectors[k + 1], place)
        for _ in range(len(letters) - 1):
            place = _ON[place]
            lines.append(f"{_ROLES[place]}:")
        if letters[-1] == "K":
            lines.append(f"{role}:{text}")
        elif letters[-1] == "R":
            lines.append(f"{_ROLES[to]}:{text}")
        place, cost = to, cost + spent + DELETE * (copies - 1)
        audit.append(letters + "D" * (copies - 1))
    while last and END[place]:
        place, cost = _ON[place], cost + INSERT
        audit.append("I")
        lines.append(f"{_ROLES[place]}:")
    return "".join(audit), lines, cost


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of `key, turn, role, text, copies` with faults put in by a checksum of key and turn:
    of 20 values 0 drops a row (0 copies), 1 empties its text, 2 takes `.`, `!` and `?` out, 3
    doubles it (2 copies), 4 makes it the user's. A missing role, text or part of the checked
    string counts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    gone = h == 0
    return rows.select(
        F.col(key).alias("key"), F.when(~gone, F.col(turn).cast("bigint")).alias("turn"),
        F.when(gone, "").when(h == 4, "user").otherwise(space(role)).alias("role"),
        F.when(gone | (h == 1), "").when(h == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias("text"),
        F.when(gone, 0).when(h == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order, with equal neighbours as one run and whether role and text came before."""
    runs = kept(rows.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turn-runs")
    runs = runs.withColumn("mark", F.md5(F.col("text").cast("binary")))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("at"))).alias("first")
    again = (
        runs.filter("copies > 0").groupBy("key", "role", "mark").agg(first, F.count(F.lit(1)).alias("c")).filter("c > 1")
        .select(*[F.col(c).alias(f"r_{c}") for c in ("key", "role", "mark")], F.col("first.at").alias("at"), F.lit(True).alias("again"))
    )
    same = F.col("key").eqNullSafe(F.col("r_key")) & (F.col("role") == F.col("r_role")) & (F.col("mark") == F.col("r_mark"))
    seen = F.coalesce(F.col("again") & ~F.col("turn").eqNullSafe(F.col("at")), F.lit(False))
    flagged = runs.join(again, same, "left").select("key", "turn", "role", "text", "copies", "mark", seen.alias("seen"))
    order = ["key", "turn", "role", "text"]
    return flagged.repartitionByRange("key", "turn", "role", "mark").sortWithinPartitions(*order)


_CHUNK = ("key {key}, part int, seq int, edge boolean, forced boolean, codes binary, copies array<bigint>, roles array<string>, "
          "texts array<string>, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "first string, last string, low bigint, high bigint, turns bigint, after array<int>, before array<int>")


class _Chunk:
    def __init__(self):
        self.codes, self.copies, self.roles, self.texts = bytearray(), [], [], []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        if not copies:
            return
        body, initial, code = text.strip(_SPACE), role[:1], _FORCED
        if not body:
            self.blank += copies
        elif seen:
            self.duplicate += copies
        else:
            cut = body[-1] not in ".!?"
            self.truncated += cut
            self.duplicate += copies - 1
            code = 2 * (_INITIALS.find(initial) if initial and initial in _INITIALS else 3) + cut
        if self.n and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += (copies - 1) * (2 * initial not in _LEGAL)
        self.first = initial if self.n == 0 else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.n += copies
        self.codes.append(code)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append("" if code == _FORCED else text)
        self.size += len(text) + len(role) + 16

    def full(self) -> bool:
        return len(self.codes) >= CHUNK_ROWS or self.size >= CHUNK_BYTES


def _chunks(key_type: pa.DataType, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, part, seq, chunk, key, opened, out, held = Viterbi(), TaskContext.get().partitionId(), 0, None, None, False, [], 0

        def close(edge: bool) -> None:
            nonlocal seq, held
            out.append({
                "key": key, "part": part, "seq": seq, "edge": edge, "codes": bytes(chunk.codes), "after": END,
                "forced": all(c == _FORCED for c in chunk.codes),
                "before": v.run(chunk.codes, END),
                **{n: getattr(chunk, n) for n in ("copies", "roles", "texts", "n", "blank", "duplicate", "truncated",
                                                   "illegal", "first", "last", "low", "high", "turns")}})
            seq, held = seq + 1, held + chunk.size + 200

        schema = _arrow(_CHUNK, key_type)
        split, first = False, True  # first: the partition before may hold more of this conversation
        for batch in batches:
            for row_key, turn, role, text, copies, seen in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5).to_pylist()):
                if chunk is not None and (row_key != key or len(chunk.codes) >= rows or chunk.size >= size):
                    split = split or row_key == key
                    close(split or first)
                    if row_key != key:
                        split = first = False
                    chunk = None
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
                if chunk is None:
                    chunk, key = _Chunk(), row_key
                chunk.add(turn, role, text, copies, seen)
        if chunk is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(schema: str, key_type: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, key_type if t == "{key}" else kinds[t]) for n, t in (f.split() for f in schema.split(", "))])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, n: int = 2_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("piece") or b"") + len(row.get("audit") or "")
        if len(held) >= n or size > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_RUNS = "key {key}, part int, seq int, forced boolean, after array<int>, before array<int>"
_WANTED = "key {key}, part int, seq int, after array<int>, final boolean, earlier array<int>, result array<int>"


def _stitch(key_type: pa.DataType):
    """Streams the borders of each conversation from its end: the vector every chunk is handed and,
    if it has not been run with one of that direction, an earlier run to compare with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            at, runs = None, {}
            for r in _rows_of(batches):
                if at is not None and at[:3] != (r["key"], r["part"], r["seq"]):
                    yield at, runs
                    runs = {}
                at = r["key"], r["part"], r["seq"], r["forced"]
                runs[tuple(r["after"])] = tuple(r["before"])
            if at is not None:
                yield at, runs

        def rows() -> Iterator[dict]:
            key, opened, vector = None, False, END
            for (k, part, seq, forced), runs in chunks():
                final = not opened or k != key
                if final:
                    key, opened, vector = k, True, END
                earlier, result = next(iter(runs.items()))
                known = forced or vector in runs
                yield {"key": k, "part": part, "seq": seq, "after": vector, "final": final,
                       "earlier": None if known else earlier, "result": None if known else result}
                if not forced:  # forced deletions hand on what they get; an unknown result is guessed
                    vector = runs.get(vector, result)

        return _batched(rows(), _arrow(_WANTED, key_type))

    return run


def _rerun(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Viterbi()
        return _batched(
            ({"key": r["key"], "part": r["part"], "seq": r["seq"], "forced": False, "after": r["after"],
              "before": v.again(r["codes"], tuple(r["after"]), tuple(r["earlier"]), tuple(r["result"]))}
             for r in _rows_of(batches)), _arrow(_RUNS, key_type))

    return run


_LEADS = "key {key}, part int, seq int, final boolean, after array<int>, leads array<int>"
_ENTRIES = "key {key}, part int, seq int, final boolean, after array<int>, place int"


def _leads(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Viterbi()
        return _batched(({**r, "leads": v.leads(r["codes"], tuple(r["after"]))} for r in _rows_of(batches)),
                        _arrow(_LEADS, key_type))

    return run


def _entries(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            place = START
            for r in _rows_of(batches):
                yield {**r, "place": place}
                place = START if r["final"] else r["leads"][place]

        return _batched(rows(), _arrow(_ENTRIES, key_type))

    return run


_PIECE = ("key {key}, part int, seq int, piece binary, lines bigint, audit string, cost bigint, n bigint, blank bigint, "
          "duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint")
RESULT = ("key {key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired binary, repaired_sha256 string")


def _traced(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Viterbi()

        def rows() -> Iterator[dict]:
            for r in _rows_of(batches):
                audit, lines, cost = solve(v, r, tuple(r["after"]), r["place"], r["final"])
                yield {**r, "piece": "\n".join(lines).encode(), "lines": len(lines), "audit": audit, "cost": cost}

        return _batched(rows(), _arrow(_PIECE, key_type))

    return run


def _ends(key_type: pa.DataType, texts: bool):
    """One row a conversation from its pieces in order; digests are fed piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = (1 << 63) - 1

        def rows() -> Iterator[dict]:
            now = None
            for r in _rows_of(batches):
                if now is not None and now["key"] != r["key"]:
                    yield done(now)
                    now = None
                if now is None:
                    now = {"key": r["key"], "digest": hashlib.sha256(), "held": [], "audits": [], "lines": 0, "turns": 0,
                           "low": None, "high": None, "last": None, "n": 0,
                           **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)}
                if r["lines"]:
                    piece = (b"\n" if now["lines"] else b"") + r["piece"]
                    now["digest"].update(piece)
                    now["lines"] += r["lines"]
                    if texts:
                        now["held"].append(piece)
                now["audits"].append(r["audit"])
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += r[c]
                if r["n"]:
                    now["illegal"] += now["n"] > 0 and now["last"] + r["first"] not in _LEGAL
                    now["n"], now["last"] = now["n"] + r["n"], r["last"]
                if r["low"] is not None:
                    now["turns"] += r["turns"] - (now["high"] == r["low"])
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            if now is not None:
                yield done(now)

        def done(now: dict) -> dict:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return {**now, "gaps": min(gaps, top), "audit": "".join(now["audits"]), "repaired_sha256": now["digest"].hexdigest(),
                    "repaired": b"".join(now["held"]) if texts else None}

        return _batched(rows(), _arrow(RESULT, key_type))

    return run


def repair(rows: DataFrame, texts: bool = True, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The cheapest repair of every conversation in rows of `key, turn, role, text, copies`.

    `key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256` and, with
    `texts`, `repaired`: its `role:text` lines. Keeping a row costs 0, another role 3, deleting it
    4 (forced for blank rows and for repeats of an earlier role and text), an empty user or
    assistant turn put in anywhere 3, a truncated row that stays 3. `audit` has a letter an edit:
    Keep, Rerole, Delete, Insert; of equally cheap ones the least.

    Rows are taken by turn, those without one first, ties by role and then text; equal rows are
    interchangeable. A role that begins with none of s, u and a (also an empty one) cannot be
    kept. Rows of 0 copies only say that there is such a conversation. One without any row has
    zeros, an empty audit and the digest of nothing. A missing key is a conversation of its own.
    The digest of a conversation is one stream through its chunks, which hold bounded rows and
    bytes; all else is done by chunk. An empty table gives an empty result.
    """
    field = rows.select("key").schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, named = to_arrow_type(field), field.simpleString()
    ddl = lambda s: s.replace("{key}", named)
    columns = ("key", "turn", "role", "text", "copies", "seen")
    chunks = kept(
        in_arrow(_ordered(rows).select(*columns), _chunks(key_type, chunk_rows, chunk_bytes), ddl(_CHUNK)), "chunks")
    at, edges = ["key", "part", "seq"], chunks.filter("edge")

    # Borders: a few rows for every partition and for every chunk of a long conversation.
    runs = kept(edges.select(*at, "forced", "after", "before"), "chunk-runs")
    while True:
        streamed = runs.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq"))
        wanted = kept(in_arrow(streamed, _stitch(key_type), ddl(_WANTED)), "chunk-vectors")
        again = wanted.filter("earlier is not null")
        if again.isEmpty():
            break
        runs = kept(runs.unionByName(in_arrow(
            _with(again, edges.select(*at, "codes"), at), _rerun(key_type), ddl(_RUNS))), "chunk-runs")
    vectors = wanted.select(*at, "final", "after")
    leads = in_arrow(_with(vectors, edges.select(*at, "codes"), at), _leads(key_type), ddl(_LEADS))
    entries = in_arrow(
        leads.repartition("key").sortWithinPartitions(*at), _entries(key_type), ddl(_ENTRIES))

    whole = chunks.filter("not edge").withColumns({"final": F.lit(True), "place": F.lit(START)})
    parted = in_arrow(_with(kept(entries, "chunk-entries"), edges.drop("after"), at), _traced(key_type), ddl(_PIECE))
    last = lambda pieces: in_arrow(pieces, _ends(key_type, texts), ddl(RESULT))
    made = last(in_arrow(whole, _traced(key_type), ddl(_PIECE))).unionByName(
        last(parted.repartition("key").sortWithinPartitions(*at)))
    return made.withColumn("repaired", F.col("repaired").cast("string")) if texts else made.drop("repaired")


def _with(small: DataFrame, chunks: DataFrame, at: list[str]) -> DataFrame:
    """Chunk rows and what is known about them, by part and number, which no two chunks share."""
    mine = [F.col(c).alias(f"c_{c}") for c in at] + [F.col(c) for c in chunks.columns if c not in at]
    met = (F.col("part") == F.col("c_part")) & (F.col("seq") == F.col("c_seq"))
    return small.join(chunks.select(*mine), met).drop(*[f"c_{c}" for c in at])
