"""Conversation repair, exact top-k search and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import conversation_repair as cr
from labelscope.llm import fill_in_middle as fim
from labelscope.llm import top_k as tk

SPACE = " \t\n\x0b\x0c\r"


# Conversation repair


def brute_repair(rows):
    """All edits of every conversation, searched forwards with whole audits and lines."""
    found = defaultdict(list)
    for c, t, r, x in rows:
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x, own = " " if r is None else r, " " if x is None else x, found[c]
        if mark == 0:
            continue
        x = "" if mark == 1 else re.sub("[.!?]", "", x) if mark == 2 else x
        own += [(t, "user" if mark == 4 else r, x)] * (2 if mark == 3 else 1)
    return {c: _repaired(own) for c, own in found.items()}


def _repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        body = x.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    after, said = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user:", 3: "assistant:"}
    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def filled(state):
        for _ in range(3):
            for p in list(state):
                cost, audit, lines = state[p]
                state[after[p]] = min(state.get(after[p], (10**9,)), (cost + 3, audit + "I", (*lines, said[after[p]])))
        return state

    state = {0: (0, "", ())}
    for (_, r, x), fault in zip(rows, faults):
        state, new = filled(state), {}
        for p, (cost, audit, lines) in state.items():
            options = [(p, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                cost += 3 * (fault == "truncated")
                options.append((after[p], (cost + 3, audit + "R", (*lines, said[after[p]] + x))))
                if p in keep.get(r[:1], {}):
                    options.append((keep[r[:1]][p], (cost, audit + "K", (*lines, f"{r}:{x}"))))
            for q, value in options:
                new[q] = min(new.get(q, (10**9,)), value)
        state = new
    cost, audit, lines = min(v for p, v in filled(state).items() if p in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _repair(table, **options):
    got = [tuple(r) for r in cr.repair(cr.damaged(table), texts=False, **options).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_repair_equals_brute_force_in_any_chunks(spark):
    draw, data = random.Random(5), []
    for c in range(50):
        roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""] if c % 2 else ["user", "assistant"]
        for t in range(draw.choice([1, 2, 5, 9, 40, 150])):
            text = draw.choice(["Hi.", "ok", "yes!", "", " \n", f"Word {t}.", f"w {t}", None, "ü?"])
            data.append((c or None, draw.choice([t, t, t, t // 2, None]), draw.choice(roles), text))
    data += [(1000, t, "tool", f"Word {t}.") for t in range(400)]  # places alternate and never converge
    data += [(1001, t, "user", "same.") for t in range(400)]  # nearly all forced deletions
    data += [(1002, 5, "user", "same.")] * 300
    data += [(1003, 2**62, "user", "a"), (1003, -(2**62), "assistant", "b")]
    table = spark.createDataFrame(data, SCHEMA).repartition(7)
    want = brute_repair(data)
    assert _repair(table, chunk_rows=16) == want
    assert _repair(table) == want


def test_repair_of_one_long_conversation_is_cut(spark):
    draw = random.Random(9)
    data = [(1, t, draw.choice(["user", "assistant", "assistant"]), f"turn {t}" + draw.choice([".", ""])) for t in range(3_000)]
    table = spark.createDataFrame(data, SCHEMA)
    ordered = cr._ordered(cr.damaged(table)).select("key", "turn", "role", "text", "copies", "seen")
    import pyarrow as pa

    chunks = ordered.mapInArrow(cr._chunks(pa.int64(), 100, 1 << 20), cr._CHUNK.replace("{key}", "bigint")).collect()
    assert len(chunks) >= 25 and all(len(c.codes) <= 100 and c.edge for c in chunks)
    assert _repair(table, chunk_rows=100) == brute_repair(data)


def test_repair_odd_rows(spark):
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    data = [(dropped, 0, "user", "Gone."), (None, None, None, None), (-7, 1, "assistant", "y" * 3_000_000 + ".")]
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "copies", "part", "seen", "n")})
    got = _repair(table)
    assert got == brute_repair(data)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _repair(table.filter("1 = 0")) == {}
    named = table.select(F.col("conv_id").cast("string").alias("name"), "turn", "role", "text")
    made = {r.key: r for r in cr.repair(cr.damaged(named, key="name")).collect()}
    for r in made.values():
        assert hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256
    assert made["-7"].audit == got[-7][6]


def test_runs_stop_where_vectors_are_parallel():
    v, draw = cr.Viterbi(), random.Random(3)
    codes = bytes(draw.choice([2, 4, 2, 4, 3, 5, 8]) for _ in range(500))
    other = next(x for x in [(0, 3, 3, 0), (3, 3, 0, 3), (0, 0, 0, 0)] if x != cr.END)
    earlier = v.run(codes, cr.END)
    assert v.again(codes, other, cr.END, earlier) == v.run(codes, other)
    seen = []
    v.back = lambda code, after, f=v.back: seen.append(code) or f(code, after)
    v.again(codes, other, cr.END, earlier)
    assert len(seen) < 2 * len(codes)


# Exact top-k search


def brute_top(rows, k=10, every=100):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for i, v in good:
            for j, w in good:
                if i == q and j != q and len(v) == len(w):
                    best[j] = max(best.get(j, -(2**63)), sum(a * b for a, b in zip(v, w)))
        top = 2**63 - 1
        ranked = sorted((-max(-top, min(top, s)), j) for j, s in best.items())[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    return out


def _top(spark, data, kind="array<float>", k=10, every=100, **options):
    table = spark.createDataFrame(data, f"vec_id bigint, embedding {kind}").repartition(5)
    table = table.withColumns({c: F.lit("x") for c in ("id", "dim", "length", "score", "rank", "part")})
    got = tk.top_k(table.filter(F.col("vec_id") % every == 0), table, k, **options).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("block", [1 << 20, 2_000])
def test_top_k_equals_brute_force(spark, block):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    data = []
    for i in range(600):
        v = centres[i % 12] + 0.02 * draw.normal(size=16)
        data.append((i, (v * draw.choice([0.01, 0.5, 1.0, 3.0])).astype("f4").tolist()))
    data += [(1_000 + i, data[7][1]) for i in range(40)]  # ties
    assert _top(spark, data, block_bytes=block) == brute_top(data)


def test_top_k_odd_rows(spark):
    draw = np.random.default_rng(6)
    data = [(i, draw.normal(size=4).tolist()) for i in range(30)]
    data += [(0, data[3][1]), (5, data[9][1]), (5, data[9][1]), (None, data[1][1]), (100, None), (101, [1.0, None, 0.0, 0.0]),
             (102, [float("nan"), 0.0, 0.0, 0.0]), (200, [float("inf")] * 4), (300, []), (301, []), (302, [0.0] * 4),
             (400, [1.0, 2.0]), (401, [-3.0, 1.0]), (500, [7.0]), (600, [0.0] * 4), (700, [3e12] * 4), (701, [-2e12, 1e-3, 5e12, 1.0]),
             (800, [1e200, 0.0, 0.0, -1e200]), (800, [1e200, 0.0, 0.0, -1e200])]
    assert _top(spark, data, "array<double>", k=4) == brute_top(data, k=4)
    assert _top(spark, [], "array<double>") == []


def test_pruning_takes_every_way_and_loses_nothing():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.floor(1000 * (centres[draw.integers(0, 40, 4_000)] + 0.015 * draw.normal(size=(4_000, 24))))
    x = np.floor(x * draw.choice([0.5, 1.0, 1.0, 1.0], size=(4_000, 1)))
    x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")]
    ids = np.arange(4_000)
    asked = draw.choice(4_000, 60, replace=False)
    block = tk.Queries(24, ids[asked].astype("<i8").tobytes(), x[asked].tobytes(), 5)
    took = defaultdict(int)
    for at in range(0, 4_000, 500):
        for k, n in block.search(tk.Bucket(24, ids[at : at + 500].astype("<i8").tobytes(), x[at : at + 500].tobytes())).items():
            took[k] += n
    assert took["skipped"] and took["coordinate"] and took["length"]
    assert took["verified"] < 0.6 * 60 * 4_000
    for row, i in enumerate(asked):
        scores = (x @ x[i]).astype(np.int64)
        others = ids[ids != i]
        order = np.lexsort((others, -scores[others]))[:5]
        assert block.best[row][0].tolist() == others[order].tolist()
        assert block.best[row][1].tolist() == scores[others][order].tolist()


# Fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def _texts():
    draw = random.Random(11)
    pool = ["ab", "C", " ", "\n", "é", "漢", "😀", "<", "P", ">", "<S", "1", "x" * 50, "\x00"]
    rows = [(i, "".join(draw.choice(pool) for _ in range(draw.randrange(60)))) for i in range(300)]
    rows += [(400, "<P>"), (401, "a<M>b"), (402, None), (403, ""), (None, "no id, but text."), (404, "z" * 100_000), (405, "é" * 70_000),
             (406, "a b" * 60_000), (407, "a b" * 60_000), (1, "other text of one id"), *[(408, "a copy " * 4)] * 30, *[(402, None)] * 3]
    return rows


def test_middle_equals_brute_force(spark):
    data = _texts()
    table = spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)
    table = table.withColumns({c: F.lit(1) for c in ("print", "position", "data", "form", "part", "n")})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, x in data:
        n, form, p, m, out = brute_middle(d, x)
        want.append((d, n, form, p, m, sha(out), sha(x or "")))
    assert sorted(map(repr, map(tuple, fim.digests(table).collect()))) == sorted(map(repr, want))
    texts = sorted(repr((r.doc_id, r.output)) for r in fim.fill_in_middle(table).collect())
    assert texts == sorted(repr((d, brute_middle(d, x)[4])) for d, x in data)
    back = fim.restored(fim.fill_in_middle(table)).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((d, x or "")) for d, x in data)
    assert fim.digests(table.filter("1 = 0")).collect() == []


def test_middle_pieces_are_bounded(spark):
    table = spark.createDataFrame([(404, "z" * 100_000), (406, "a b" * 60_000), (5, "é" * 70_000)], "doc_id bigint, text string")
    sizes = [len(r.data) for r in fim.pieces(table).collect()]
    assert len(sizes) > 20 and max(sizes) <= fim.PIECE_BYTES + 3
    plan = fim.digests(table)._jdf.queryExecution().toString()
    assert plan.count("RepartitionByExpression") >= 1
