"""Byte-level BPE encoding and decoding by recursive SQL inside each partition.

A task splits its texts with the vocabulary's pattern and hands the distinct words it has not
seen yet to an in-process DuckDB. There, token-position rows of all words join the merge table;
each step contracts the leftmost pair of minimum rank of every word, and a word leaves the
recursion when no pair of it can merge. Ordered aggregates give its ids and decode them again.
Texts are then put together from their words. A memo of bounded size spares words the worker
has done before; emptying it costs time and never changes a result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow

MEMO_WORDS = 800_000
CHUNK_WORDS = 40_000
GROUP_CHARS = 1 << 21
#: Longer words would need as many recursion steps as they have bytes; the same contractions
#: are then picked from a heap.
LONG_BYTES = 2_048

# A row is a token and its neighbour to the right, with the rank of merging the two. A step finds
# each word's pair (p, q) of lowest rank, leftmost first, gives row p the merged token and q's
# neighbour, drops row q, and looks up ranks only for the two pairs that this changes.
_STEPS = """
WITH RECURSIVE step(it, w, pos, id, npos, nid, rank) AS (
  SELECT 0, b.w, b.pos, b.id, b.npos, b.nid, m.rank
  FROM (SELECT w, pos, id, lead(pos) OVER q AS npos, lead(id) OVER q AS nid
        FROM bytes_of WINDOW q AS (PARTITION BY w ORDER BY pos)) b
  LEFT JOIN merges m ON m.pair = ((b.id::BIGINT << 32) | b.nid)
  UNION ALL
  (WITH best AS (
     SELECT w, min((rank::BIGINT << 20) | pos) AS b, arg_min(npos, (rank::BIGINT << 20) | pos) AS q
     FROM step WHERE rank IS NOT NULL GROUP BY w),
   pair AS (
     SELECT best.w, (b & 1048575)::INT AS p, q, (b >> 20)::INT AS merged, s.npos AS q_npos, s.nid AS q_nid
     FROM best JOIN step s ON s.w = best.w AND s.pos = best.q),
   moved AS (
     SELECT s.it + 1 AS it, s.w, s.pos,
            CASE WHEN s.pos = p THEN merged ELSE s.id END AS id,
            CASE WHEN s.pos = p THEN q_npos ELSE s.npos END AS npos,
            CASE WHEN s.pos = p THEN q_nid WHEN s.npos = p THEN merged ELSE s.nid END AS nid,
            s.rank AS old, (s.pos = p OR s.npos = p) AS changed
     FROM step s JOIN pair USING (w) WHERE s.pos <> q)
   SELECT v.it, v.w, v.pos, v.id, v.npos, v.nid, CASE WHEN changed THEN m.rank ELSE old END
   FROM moved v LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN (v.id::BIGINT << 32) | v.nid END)
), final AS (SELECT w, pos, id FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it)
  UNION ALL SELECT w, pos, id FROM known)
SELECT w, array_to_string(list_transform(l, lambda x: x.i), ',') AS ids,
       array_to_string(list_transform(l, lambda x: x.h), '') AS decoded
FROM (SELECT w, list({'i': id::VARCHAR, 'h': t.hex} ORDER BY pos) AS l FROM final JOIN tokens t USING (id) GROUP BY w)
"""


class Codec:
    """The ranks of a file `base64-token rank` per line, as tables of a private DuckDB."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ids: dict[str, str] = {}  # of each word known: its ids, and what they decode to
        self.decoded: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pair, rank = [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pair.append((a << 32) | b)
                    rank.append(i)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())})
        self._table("tokens", {"id": pa.array(self.ranks.values(), pa.int32()),
                               "hex": pa.array([t.hex() for t in self.ranks])})

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def learn(self, words: set[str]) -> None:
        """Put ids and decoded bytes of `words` into the memo."""
        if len(self.ids) > MEMO_WORDS:
            self.ids.clear()
            self.decoded.clear()
        new = list(words)
        for at in range(0, len(new), CHUNK_WORDS):
            part = new[at : at + CHUNK_WORDS]
            raw, known = [x.encode() for x in part], []  # of known words: word, place and id
            for w, data in enumerate(raw):
                whole = self.ranks.get(data)
                if whole is not None:  # a word of the vocabulary is one token, whatever its merges
                    known.append((w, 0, whole))
                elif len(data) > LONG_BYTES:
                    known += [(w, k, i) for k, i in enumerate(self.contract(data))]
            given = {w for w, _, _ in known}
            open_ = np.array([w for w in range(len(part)) if w not in given], dtype=np.int32)
            size = np.array([len(raw[w]) for w in open_], dtype=np.int64)
            data = np.frombuffer(b"".join(raw[w] for w in open_), dtype=np.uint8)
            begin = np.cumsum(size) - size
            self._table("bytes_of", {
                "w": pa.array(np.repeat(open_, size), pa.int32()),
                "pos": pa.array((np.arange(len(data)) - np.repeat(begin, size)).astype(np.int32)),
                "id": pa.array(self.byte_ids[data]),
            })
            self._table("known", {n: pa.array([r[k] for r in known], pa.int32()) for k, n in enumerate(("w", "pos", "id"))})
            # Every word, also those whose ids were known, is decoded by its ids.
            for w, ids, decoded in self.con.execute(_STEPS).fetchall():
                self.ids[part[w]], self.decoded[part[w]] = ids, bytes.fromhex(decoded)

    def contract(self, data: bytes) -> list[int]:
        """The same contractions for one very long word, in n log n steps."""
        token = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        alive, heap = [True] * len(data), []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(data) and (rank := self.ranks.get(token[i] + token[j])) is not None:
                heapq.heappush(heap, (rank, i, token[i], token[j]))

        for i in range(len(data) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else len(data)
            if not alive[i] or j >= len(data) or token[i] != left or token[j] != right:
                continue
            token[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] < len(data):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[t] for t, here in zip(token, alive) if here]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = codec(path), _splitter(pattern)

        def group(texts: list[list[str]]):
            used = set().union(*texts)
            while new := used.difference(coder.ids):  # a second time if the memo was emptied meanwhile
                coder.learn(new)
            ids_of, bytes_of = coder.ids.__getitem__, coder.decoded.__getitem__
            ids = [",".join(map(ids_of, words)) for words in texts]
            data = [b"".join(map(bytes_of, words)) for words in texts]
            n = [x.count(",") + 1 if x else 0 for x in ids]
            return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.binary())]

        for batch in batches:
            texts, first, held, size = batch.column(1), 0, [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                held.append(split(text))
                size += len(text)
                if size >= GROUP_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(held)), *group(held)],
                        names=["doc_id", "n_tokens", "ids", "decoded"])
                    first, held, size = i + 1, [], 0

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_tokens, ids, decoded` of every row: token ids as decimals joined by commas, and
    the bytes those ids stand for.

    Null and empty texts have no token and decode to nothing. Rows come back one for one, also
    repeated ones and those without an id; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _encode(path, pattern), "doc_id bigint, n_tokens bigint, ids string, decoded binary")
