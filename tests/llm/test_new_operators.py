"""Hard negatives, language identification and the Merkle manifest against brute force."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bond, language, merkle, queries
from llm_fixtures import DOCS, ODD, compare, empty

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


# Hard negatives


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in random.normal(size=24) * 0.4 + (i % 3)], int(i % 4), 1.0, 2) for i in range(230)]
    rows += [rows[50], rows[50], rows[51], (50, [0.5] * 24, 1, 0.0, 0), (None, [0.25] * 24, 2, 0.0, 0), (1000, None, 1, 0.0, 0), (1050, [1.0] * 24, None, 0.0, 0)]
    rows += [(1100, [float("nan")] * 24, 1, 0.0, 0), (1150, [None] * 24, 1, 0.0, 0), (1200, [1.0, 2.0], 1, 0.0, 0), (1201, [1.0, 1.5], 1, 0.0, 0), (1202, [0.5, 1.0], 2, 0.0, 0), (1250, [0.0] * 24, 1, 0.0, 0)]
    return spark.createDataFrame(rows, VECTORS)


def test_bond_equals_sql(spark, vectors):
    want, _ = compare(spark, "op11_bond", {"embeddings": vectors})
    assert len(want) > 50


def test_bond_in_many_blocks_equals_one(spark, vectors, monkeypatch):
    ask, shift = (lambda i: i % 50 == 0), (lambda i, label: label)
    one = sorted(map(tuple, bond.hard_negatives(vectors, ask, shift).collect()), key=str)
    monkeypatch.setattr(bond, "ROWS", 16)
    monkeypatch.setattr(bond, "ANCHORS", 2)
    assert sorted(map(tuple, bond.hard_negatives(vectors, ask, shift).collect()), key=str) == one


def test_bond_without_rows_or_anchors(spark, vectors):
    assert bond.hard_negatives(empty(vectors), lambda i: i % 50 == 0).collect() == []
    assert bond.hard_negatives(vectors, lambda i: i < 0).collect() == []


def test_bounds_leave_rows_out_before_all_dimensions_are_read():
    random = np.random.default_rng(1)
    values = np.floor(random.normal(size=(4000, 64)) * np.geomspace(4000, 1, 64))
    block = bond.Block(np.arange(4000), np.arange(4000), np.zeros(4000, int), values)
    seen = []
    keep = lambda low, high: seen.append(len(low)) or high >= bond._kth(low, 5)
    at, score = block.scan(values[0], np.arange(1, 4000), keep)
    exact = values[1:] @ values[0]
    assert sorted(score)[-5:] == sorted(exact)[-5:] and seen[-1] < 400


def test_scores_beyond_double_precision_are_exact():
    big = float(1 << 30)
    values = np.array([[big, 1.0], [big, 3.0], [big, 2.0], [-big, 5.0]])
    block = bond.Block(np.arange(4), np.arange(4), np.array([0, 0, 0, 1]), values)
    at, score = bond.top_same(block, 0, 0, values[0], 2)
    assert at.tolist() == [1, 2] and [int(s) for s in score] == [(1 << 60) + 3, (1 << 60) + 2]


def test_windows_of_any_sign():
    assert bond.window(101, 50, 95) == (51, 95) and bond.window(0, 50, 95) == (0, 0)
    low, high = bond.window(-100, 50, 95)
    assert low > high


# Language


def test_gradient_equals_differences():
    random = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in language.start(3, units=4, seed=1).items()}
    codes, length = random.integers(97, 101, (6, 5)).astype(np.uint8), np.array([6, 6, 3, 1, 5])
    label = np.array([0, 1, 2, 0, 1])
    _, grad = language.gradient(weights, codes, length, label)
    for name, spots in {"Wf": [(0, 97), (5, 98), (9, 99)], "Wb": [(2, 98), (11, 97)], "Uf": [(1, 2), (6, 0), (10, 3)], "Ub": [(0, 0), (8, 1)], "Vf": [(1, 2)], "Vb": [(2, 0)], "c": [(1, 0)]}.items():
        for spot in spots:
            around = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][spot] += step
                around.append(language.gradient(moved, codes, length, label)[0])
            assert grad[name][spot] == pytest.approx((around[0] - around[1]) / 2e-5, abs=1e-7)


def test_shares_do_not_depend_on_the_batch():
    model = language.Model(["a", "b"], language.start(2))
    texts = [b"", b"x", b"hello world" * 40, "é".encode() * 33]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = model.shares(data, bounds)
    for i, t in enumerate(texts):
        alone = model.shares(np.frombuffer(t or b"", np.uint8), np.array([0, len(t)]))
        assert together[i] == pytest.approx(alone[0], abs=1e-5)
        assert together[i].sum() == pytest.approx(1.0 if t else 0.0, abs=1e-5)


def test_language_of_held_out_documents(spark):
    random = np.random.default_rng(5)
    words = {"aa": ["kilo", "mara", "tolo", "nika"], "bb": ["straub", "wrecht", "pfund", "schlick"], "cc": ["écoué", "çaîné", "œuvré", "naïvà"]}
    rows = [(i, " ".join(random.choice(words[lang], 30)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(words), 600))]
    rows += [(None, "kilo mara", "aa"), (9000, None, "aa"), (9001, "", "bb"), (9002, "12 34 !?", "bb"), (9003, "kilo " * 50000, None), (9004, "wrecht pfund straub", None)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, lang_pred long, score string")
    found = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs, sample=200)).collect()}
    assert len(found) == len(rows)
    held = [i for i, r in enumerate(rows[:600]) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all(found[i]["lang_pred"] == rows[i][2] for i in held)
    assert [found[i]["lang_pred"] for i in (None, 9000, 9001, 9002, 9003, 9004)] == ["aa", "und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_labels(spark, odd):
    found = language.predict(odd, language.fit(odd.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(found) == len(ODD) and {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert language.predict(empty(odd), language.fit(empty(odd))).collect() == []


def test_language_takes_repeated_stretches_once(spark):
    rows = [(1, "abc " * 100, "x")] * 500 + [(i, f"def {i} ghi {i}", "y") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs, sample=50).languages == ["x", "y"]


# Merkle manifest


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root of every row, by lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _digest(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):  # digests and, for each, siblings by level
        trails, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, place in enumerate(at):
                run = runs[place // 16]
                trails[k].append((run[: place % 16], run[place % 16 + 1 :]))
            at, nodes = [p // 16 for p in at], [_digest(*r) for r in runs]
        return nodes[0], trails

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r, leaf(r, r[1])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, trails = {}, {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subroots[s], trails[s] = tree([x[1] for x in by[s]])
    root, upper = tree([subroots[s] for s in order])
    out = []
    for s, up in zip(order, upper):
        for (r, own), trail in zip(by[s], trails[s]):
            path = trail + up
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf(r, lower(r[1])) if touched else own
            for left, right in path:
                acc = _digest(*left, acc, *right)
            out.append((r[0], own, subroots[s], root, _digest(*[x for left, right in path for x in left + right]), acc, acc == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["odd", "hot", "many", "one"])
def test_merkle_equals_lists_and_sql(spark, shape):
    text = lambda i: f"Text {i} of THIS é"
    rows = {
        "odd": ODD,
        "hot": [(i, text(i), "en", "hot" if i % 3 else f"s{i % 7}", i) for i in range(700)] + [(5, "same", "en", "hot", 1)] * 300,
        "many": [(i, text(i), None, f"source{i % 280}", None) for i in range(600)],
        "one": [(1, "Alone", "en", "a", 5)],
    }[shape]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], DOCS + ", root string, verified boolean")
    want, names = compare(spark, "op13_merkle", {"documents": docs})
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(w[names.index(c)] for c in columns) for w in want], key=str) == _plain(rows)


def test_merkle_requests_and_store(spark, odd):
    rows = [(i, f"text {i}", "en", f"s{i % 20}" if i % 2 else "hot", i) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    fields = {c: F.col(c) for c in merkle.FIELDS}
    manifest = merkle.build(docs.select("source", "doc_id", merkle.leaf_digest(**fields).alias("leaf")))
    records = {r["digest"]: r["children"] for r in manifest.store.collect()}
    assert all(_digest(*children) == digest for digest, children in records.items())
    everyone = {r["doc_id"]: r for r in merkle.prove(manifest, F.col("leaf")).collect()}
    asked = manifest.leaves.where(F.col("doc_id").isin(7, 8, 501))
    few = {r["doc_id"]: r for r in merkle.prove(manifest, F.col("leaf"), asked).collect()}
    assert set(few) == {7, 8, 501} and all(few[i] == everyone[i] for i in few)
    assert all(r["folded"] == manifest.root for r in everyone.values())
    assert merkle.audit(empty(odd)).collect() == []
