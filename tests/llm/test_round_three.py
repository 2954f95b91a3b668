"""Vector codes, the filter audit and sharding against plain versions of themselves."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sievefold.llm import filter_audit, sharding, vector_codes
from sievefold.llm._spark import join_unique, materialize

# --- joins of hot keys ---------------------------------------------------------------


@pytest.mark.parametrize("counted", [True, False])
def test_join_unique(spark, monkeypatch, counted):
    import sievefold.llm._spark as helpers

    monkeypatch.setattr(helpers, "HOT", 4)  # keys with more than a quarter of the rows
    keys = [1] * 30 + [2] * 5 + [3] * 3 + [None] * 4
    left = materialize(spark.createDataFrame(list(enumerate(keys)), "i int, k int"))
    right = materialize(spark.createDataFrame([(1, "a", 30), (2, "b", 5), (9, "c", 0)], "k int, v string, n long"))
    got = join_unique(left, right, ["k"], left.count(), "n" if counted else None).collect()
    assert sorted((r.i, r.v) for r in got) == [(i, {1: "a", 2: "b"}.get(k)) for i, k in enumerate(keys)]


# --- 11 vector codes -----------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [max(-vector_codes.LIMIT, min(vector_codes.LIMIT, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            near = defaultdict(list)
            for _, v, _ in kept:
                near[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(near[k]) for c in zip(*near[k], strict=True)] if k in near else e for k, e in enumerate(books[p])]
    out = [(i, label, [best(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    total = Counter()
    for _, label, found in out:
        total[label] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), total[label], digest) for i, label, found in out)


def vector_rows(seed, dims, spread):
    r = random.Random(seed)
    some = [[r.gauss(0, spread) for _ in range(dims)] for _ in range(90)]
    rows = [(i, v, r.choice([0, 1, 2, None])) for i, v in enumerate(some)]
    rows += [(200 + i, some[7], 1) for i in range(60)]  # copies
    rows += [(7, some[8], 0), (7, some[8], 0), (None, some[3], None), (None, [0.0] * dims, 2)]
    return [*rows, (300, None, 1), (301, [float("nan")] * dims, 1), (302, [None] + [0.5] * (dims - 1), 1), (303, [float("inf")] * dims, None), (304, some[0][: dims - 3], 2), (305, [], 0)]


@pytest.mark.parametrize(("dims", "spread", "packed"), [(32, 0.2, True), (64, 3000.0, False), (64, 1e6, False)])
def test_vector_codes(spark, dims, spread, packed):
    rows = vector_rows(dims, dims, spread)
    schema = "vec_id long, embedding array<double>, label int, code string, key int, row string, weight double"
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows], schema).repartition(3)
    coded, books = vector_codes.compress(frame)
    got = Counter(map(tuple, vector_codes.with_label_errors(coded, books).collect()))
    assert got == brute_codes(rows)
    most = max(abs(math.floor(256 * x)) for _, v, _ in rows if v for x in v if x is not None and math.isfinite(x))
    assert vector_codes.Packing(dims // 16, -most, most).in_long == packed


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, schema))
        assert vector_codes.with_label_errors(coded, books).collect() == []
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], schema))
    assert [(r.vec_id, r.code, r.error) for r in coded.orderBy("vec_id").collect()] == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


# --- 12 filter audit -----------------------------------------------------------------


def failures(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, part in rows:
        t = text or ""
        words = [w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        caps = sum("A" <= c <= "Z" for c in t)
        out.append((part or "", {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}))
    return out


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    docs = [(part, fails, i is not None and i in good, i is not None and i in toxic) for (part, fails), (i, _, _) in zip(failures(rows), rows, strict=True)]
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in docs if d[0] == part and d[1][f]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows():
    r = random.Random(5)
    vocab = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = [r.choice(vocab[: r.choice([20, 200])]) for _ in range(r.choice([30, 60, 90]))]
        text = r.choice(["\n", " ", "  "]).join(words)
        text = text.upper() if r.random() < 0.2 else text
        rows.append((i, text + r.choice(["", "", " $"]), r.choice(["a", "b", "b", None, ""])))
    rows += [(200 + i, rows[3][1], "a") for i in range(40)]  # a third of a part
    rows += [(3, rows[3][1], "b"), (300, None, None), (301, "", "c"), (302, None, "c"), (None, rows[5][1], "a"), (None, rows[5][1], "a"), (303, "É" * 3 + " z", "c"), (304, " ".join(f"w{i}" for i in range(30_000)), "c")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 200, 2)] + [(3, 1, 0), (3, 0, 1), (300, None, 1), (None, 1, 1), (999, 1, 1)]
    return rows, [(i, None if q is None else int(q), int(x)) for i, q, x in labels]


def test_audit(spark, monkeypatch):
    rows, labels = audit_rows()
    visited = []
    edges = filter_audit._edges
    monkeypatch.setattr(filter_audit, "_edges", lambda survivors, state: visited.append(state) or edges(survivors, state))
    docs = spark.createDataFrame([(*r, "x", True, b"h") for r in rows], "doc_id long, text string, source string, part string, A boolean, h binary").repartition(3)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = sorted(map(tuple, filter_audit.audit(docs, marks).collect()))
    assert got == brute_audit(rows, labels)
    assert sorted(visited) == list(range(31))  # each set of filters once, but for the last
    assert len(got) == 4 * 120 * 5


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.kept, r.removed) for r in one] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0)]


# --- 13 sharding ---------------------------------------------------------------------


def brute_shards(classes, shards, law):
    """Round by round over (doc_id, size, crc, h, k, at) and each round's ranks."""
    points, owners = sharding.ring(shards)
    load = lambda c: c["size"] if law == "bytes" else 1
    room = sharding.capacities(sum(c["k"] * load(c) for c in classes), shards)
    filled, out = [0] * shards, Counter()
    left, at_round = [dict(c) for c in classes], 0
    while left:
        is_open = [r > 0 for r in room]
        left.sort(key=lambda c: (c[f"rank{at_round}"], c["doc_id"] is not None, c["doc_id"] or 0, c["h"]))
        at_round += 1
        for c in left:
            at = c["at"]
            while not is_open[owners[at % len(owners)]]:
                at += 1
            s = owners[at % len(owners)]
            while c["k"] and room[s] > 0:
                out[c["doc_id"], c["size"], c["text_crc32"], s, filled[s]] += 1
                filled[s], room[s], c["k"] = filled[s] + 1, room[s] - load(c), c["k"] - 1
        left = [c for c in left if c["k"]]
    return out


def shard_rows(n, seed=9):
    r = random.Random(seed)
    rows = [(i, "x" * r.randrange(400) if r.random() < 0.9 else "é" * 30) for i in range(n)]
    rows += [(None, "copy")] * (n // 3) + [(None, None), (None, ""), (5, None), (5, "other"), (5, "other"), (6, "y" * 100_000)]
    return rows


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, monkeypatch, law):
    monkeypatch.setattr(sharding, "PIECE", 7)
    rows = shard_rows(400)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, rank int").repartition(3)
    got = [tuple(r) for r in sharding.shard_documents(docs, 5, law).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    plain = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(r[:3] for r in got) == plain
    for s in range(5):
        assert sorted(r[4] for r in got if r[3] == s) == list(range(sum(r[3] == s for r in got)))
    load = Counter()
    for r in got:
        load[r[3]] += r[1] if law == "bytes" else 1
    if law == "rows":
        assert max(load.values()) - min(load.values()) <= 1
    else:
        assert max(load.values()) < sum(load.values()) / 5 + 100_001 + 1
    found = sharding._classes(docs, "doc_id", "text", sharding.ring(5)[0])
    classes = [r.asDict() for r in found.withColumns({f"rank{i}": sharding.rank_of(i) for i in range(6)}).collect()]
    assert Counter(got) == brute_shards(classes, 5, law)


def test_shards_of_little(spark):
    schema = "doc_id long, text string"
    assert sharding.shard_documents(spark.createDataFrame([], schema)).collect() == []
    few = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, None)], schema)).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2
    with pytest.raises(ValueError, match="law"):
        sharding.shard_documents(spark.createDataFrame([], schema), law="luck")


def test_one_more_shard_moves_little(spark):
    """Sharing out by position anew would move 8 of 9 documents."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.shard_documents(docs, n).collect()} for n in (8, 9))
    assert sum(before[i] != after[i] for i in before) < 0.3 * len(before)
