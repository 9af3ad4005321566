"""Fill-in-the-middle texts by secondary sort.

A text is cut into a prefix, a middle and a suffix at two places drawn from its id, and leaves
the map side as pieces: runs of whole units, each with its document and its position in the
*output*. One shuffle by document with a sort by position inside the partitions (the DataFrame
form of `repartitionAndSortWithinPartitions`) brings them to tasks that read them as a stream:
a digest is fed piece by piece, so a task holds one Arrow batch of pieces, never a text.

Restoration works on the assembled pieces: the markers found in them say which part a piece
belongs to, the pieces get the position of the *original* and are sorted again. They are already
with their document, so this sort needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow
from labelscope.llm.words import Block, blocks, byte_set

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Where a part stands in the original.
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
TRANSFORMED, SUFFIX_FIRST = 90, 20  # of 100 texts; of 100 transformed texts
PIECE_UNITS, PIECE_BYTES = 4_096, 1 << 14
BLOCK_BYTES = 1 << 20

_LETTER = byte_set((65, 90), (97, 122))
_CONTINUES = byte_set((128, 191))
_KEY = "doc_id bigint, print binary"
PIECES = f"{_KEY}, position int, data binary, copies bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_ORDERED = (f"{_KEY}, part int, position int, data binary, copies bigint, n bigint, form string, "
            "prefix_chars bigint, middle_chars bigint, output_sha256 string")
RESULT = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
          "output_sha256 string, restored_sha256 string")


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from an id; a missing id draws as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


class _Units:
    """Where the units of a block's texts begin: runs of ASCII letters, else single characters."""

    def __init__(self, block: Block):
        letter = _LETTER[block.data]
        after = np.zeros_like(letter)
        after[1:] = letter[:-1]
        after[block.offsets[:-1][block.offsets[:-1] < len(after)]] = False
        self.block, self.rest = block, _CONTINUES[block.data]
        self.starts = np.flatnonzero(np.where(letter, ~after, ~self.rest))
        self.bounds = np.searchsorted(self.starts, block.offsets)

    def of(self, i: int) -> np.ndarray:
        """Begins of text i's units in the block, and its end."""
        own = self.starts[self.bounds[i] : self.bounds[i + 1]]
        return np.append(own, self.block.offsets[i + 1])

    def chars(self, begin: int, end: int) -> int:
        return int(end - begin - np.count_nonzero(self.rest[begin:end]))


def _runs(at: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """Byte ranges of units first..last in runs of bounded units and bytes."""
    marks = [int(x) for x in at[first:last:PIECE_UNITS]] + [int(at[last])]
    out = []
    for begin, end in zip(marks, marks[1:]):
        out += [(b, min(b + PIECE_BYTES, end)) for b in range(begin, end, PIECE_BYTES)]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for block in blocks(batch.column(1), BLOCK_BYTES):
            units, rows, seen = _Units(block), [], {}
            for i, doc_id in enumerate(ids.slice(block.first, block.n).to_pylist()):
                text = block.text(i)
                mark = hashlib.blake2b(text, digest_size=16).digest()
                if (doc_id, mark) in seen:  # copies leave a task as one row
                    for k in seen[doc_id, mark]:
                        rows[k][4] += 1
                    continue
                at = units.of(i)
                n = len(at) - 1
                h1, h2, h3, h4 = draws(doc_id)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                if not text or h3 % 100 >= TRANSFORMED or any(m in text for m in RANK):
                    form, parts, sizes = "plain", [(b"", 0, n)], (None, None)
                else:
                    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                    prefix, suffix, middle = (PREFIX, 0, low), (SUFFIX, high, n), (MIDDLE, low, high)
                    parts = [suffix, prefix, middle] if form == "spm" else [prefix, suffix, middle]
                    sizes = units.chars(at[0], at[low]), units.chars(at[low], at[high])
                made = []
                for marker, first, last in parts:
                    cuts = _runs(at, first, last) or [(0, 0)]
                    base = int(block.offsets[i])
                    data = [text[b - base : e - base] if e else b"" for b, e in cuts]
                    made += [marker + data[0], *data[1:]]
                seen[doc_id, mark] = range(len(rows), len(rows) + len(made))
                rows += [[doc_id, mark, k, data, 1, n, form, *sizes] for k, data in enumerate(made)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=[f.split()[0] for f in PIECES.split(", ")])


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The output of every text as pieces, keyed by document and position in the output."""
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _cut, PIECES)


def assembled(cut: DataFrame) -> DataFrame:
    """Pieces with each document's together, in the order of its output."""
    return cut.repartition("doc_id", "print").sortWithinPartitions("doc_id", "print", "position")


def _documents(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, bool]]:
    """Rows of sorted pieces, one at a time, and whether a row opens its document."""
    before = None
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]):
            yield row, row[:2] != before
            before = row[:2]


def _arrow_rows(rows: Iterator[list], schema: str, flush_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows of bounded size; `data`, where there is one, is the fifth column."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[4]) if isinstance(row[4], bytes) else 0)
        if size > flush_bytes:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the output, and its pieces under the part and position they restore to."""

    def rows() -> Iterator[list]:
        digest, last, key, part, k, copies, about = None, -1, None, 0, 0, 0, ()
        columns = ["doc_id", "print", "position", "data", "copies", "n", "form", "prefix_chars", "middle_chars"]
        for row, opens in _documents(batches, columns):
            if opens:
                if digest is not None:
                    yield [*key, 3, 0, b"", copies, *about, digest.hexdigest()]
                digest, last, key, part, k, copies, about = hashlib.sha256(), -1, row[:2], 0, 0, 0, row[5:]
            position, data = row[2:4]
            if position == 0:
                copies += row[4]
            if position == last:  # a copy from another task
                continue
            last = position
            digest.update(data)
            if about[1] != "plain" and data[:3] in RANK:
                part, k, data = RANK[data[:3]], 0, data[3:]
            yield [*key, part, k, data, None, None, None, None, None, None]
            k += 1
        if digest is not None:
            yield [*key, 3, 0, b"", copies, *about, digest.hexdigest()]

    return _arrow_rows(rows(), _ORDERED)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of the table, from pieces in the order of the original."""

    def rows() -> Iterator[list]:
        digest = hashlib.sha256()
        columns = ["doc_id", "print", "part", "data", "copies", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
        for row, opens in _documents(batches, columns):
            if opens:
                digest = hashlib.sha256()
            if row[2] < 3:
                digest.update(row[3])
                continue
            for _ in range(row[4]):
                yield [row[0], *row[5:], digest.hexdigest()]

    return _arrow_rows(rows(), RESULT)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256` of every row.

    Null and empty texts are plain, with n = 0 and the digest of nothing. Texts that hold a
    marker are plain. Repeated rows (same id and text) come back as often as they occur; rows of
    one id with different texts are texts of their own; a row without an id draws as the empty
    id. Text may be of any length: it is never held whole after the map side. An empty table
    gives an empty result. Other columns are not read.
    """
    out = in_arrow(assembled(pieces(docs, key, text)), _back, _ORDERED)
    return in_arrow(out.sortWithinPartitions("doc_id", "print", "part", "position"), _ends, RESULT)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list]:
        held, last, key, copies, about = [], -1, None, 0, ()
        columns = ["doc_id", "print", "position", "data", "copies", "n", "form", "prefix_chars", "middle_chars"]
        for row, opens in _documents(batches, columns):
            if opens:
                for _ in range(copies):
                    yield [key[0], *about, b"".join(held)]
                held, last, key, copies, about = [], -1, row[:2], 0, row[5:]
            if row[2] == 0:
                copies += row[4]
            if row[2] != last:
                held.append(row[3])
            last = row[2]
        for _ in range(copies):
            yield [key[0], *about, b"".join(held)]

    return _arrow_rows(([*r[:5], r[5].decode()] for r in rows()), TEXTS)


TEXTS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` of every row, with the texts
    themselves; rows as in `digests`."""
    return in_arrow(assembled(pieces(docs, key, text)), _joined, TEXTS)


def restored(outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`doc_id, text` of every row of `key, form, output`: the markers are taken out and the parts
    put back in the order of the original. Needs nothing but output and form."""
    first = lambda marker: F.instr("output", marker.decode())
    between = lambda a, b: F.substring("output", a + 3, b - a - 3)
    p, s, m = (first(x) for x in (PREFIX, SUFFIX, MIDDLE))
    rest = F.substring("output", m + 3, F.length("output"))
    text = (
        F.when(F.col("form") == "psm", F.concat(between(p, s), rest, between(s, m)))
        .when(F.col("form") == "spm", F.concat(between(p, m), rest, between(s, p)))
        .otherwise(F.col("output"))
    )
    return outputs.select(F.col(key).alias("doc_id"), text.alias("text"))
