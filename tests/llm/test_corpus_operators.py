"""Near-duplicates, neighbours, surrogates, mixing, archives and the pipeline: against brute force and exact round trips."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import DOCS, ODD, compare, empty
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, nbsvm, nn_descent, pii, prob_minhash, queries, warc
from barloom.llm.common import written


def sets_of(texts):
    found = []
    for block in prob_minhash.blocks(pa.array(texts), lower=True):
        doc, element, weight = prob_minhash.weighted(block)
        cuts = np.searchsorted(doc, np.arange(1, block.n))
        found += zip(np.split(element, cuts), np.split(weight, cuts))
    return found


def plain_similarity(a, b):
    a, b = (dict(zip(*map(np.ndarray.tolist, x))) for x in (a, b))
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in keys) for x in a.keys() & b.keys())


def edited(pick, words, n):
    words = list(words)
    for i in pick.sample(range(len(words)), n):
        words[i] = f"new{pick.random()}"
    return " ".join(words)


def test_signatures_estimate_the_similarity():
    pick = random.Random(1)
    base = [f"w{pick.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base), edited(pick, base, 3), edited(pick, base, 10), " ".join(base + base), " ".join(base[:100] * 3 + base[100:]), "a b", ""]
    sets = sets_of(texts)
    block = next(prob_minhash.blocks(pa.array(texts), lower=True))
    signs = prob_minhash.signatures(*prob_minhash.weighted(block), block.n, 2000)
    for i, j in itertools.combinations(range(5), 2):
        exact = prob_minhash.similarity(sets[i], sets[j])
        assert exact == pytest.approx(plain_similarity(sets[i], sets[j]))
        assert (signs[i] == signs[j]).mean() == pytest.approx(exact, abs=0.06)
    alone = [prob_minhash.signatures(*prob_minhash.weighted(next(prob_minhash.blocks(pa.array([t])))), 1, 2000)[0] for t in texts[:4]]
    assert all((a == b).all() for a, b in zip(alone, signs))  # whatever else is in the block


def plain_classes(rows, threshold=0.8):
    rows = [(i, t or "") for i, t in rows if i is not None]
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if find(i) != find(j) and (rows[i][1] == rows[j][1] or plain_similarity(sets[i], sets[j]) >= threshold):
            root[find(j)] = find(i)
    least: dict = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[find(i)]) for i in range(len(rows)))


def near_rows():
    """A large group of copies, chains of near copies around a base, a crowd that shares a passage, and texts alone."""
    pick = random.Random(2)
    fresh = lambda n: [f"w{pick.randrange(20000)}" for _ in range(n)]
    base, passage = fresh(120), fresh(30)
    rows = [" ".join(base)] * 30 + [edited(pick, base, k % 4) for k in range(40)]
    step = list(base)
    for _ in range(12):  # a chain: neighbours are near, its ends are not
        step = edited(pick, step, 2).split()
        rows.append(" ".join(step))
    rows += [" ".join(passage + fresh(20)) for _ in range(30)] + [" ".join(fresh(60)) for _ in range(20)]
    rows += ["one two three", "One  two THREE", "one two", "", None, "  "]
    pick.shuffle(rows)
    return list(enumerate(rows, 1))


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    got = sorted((r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(df).collect())
    assert got == plain_classes(rows)
    kept = prob_minhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in got}) and all(r.class_id == "x" for r in kept)


def test_near_duplicate_edges(spark, odd):
    got = sorted(((r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, None), (3, 3), (4, 4), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7)], key=str)
    assert sorted([(r.doc_id, r.text) for r in prob_minhash.deduplicated(odd).collect()], key=str) == sorted({(r[0], r[1]) for r in ODD} - {(2, "")}, key=str)
    assert prob_minhash.near_duplicates(empty(odd)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (95, 90)]
    got = dict(map(tuple, prob_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def plain_neighbours(rows, k=10):
    good = [(i, n, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for i, n, v in good:
        if i is not None and i % 100 == 0:
            far = sorted((float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0, m) for j, m, w in good if m != n and len(w) == len(v))
            out += [(i, rank, None if none else j, d) for rank, (d, none, j, _) in enumerate(far[:k], 1)]
    return sorted(out, key=str)


def test_nearest_rows_of_few_vectors_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.5, 0.0]), (200, [-5.0, 1.0]), *[(20 + i, [3.0, 0.0]) for i in range(15)], (300, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = nn_descent.nearest_rows(df, lambda i: i % 100 == 0).collect()
    assert [(a, b, c, pytest.approx(d)) for a, b, c, d in sorted(map(tuple, got), key=str)] == plain_neighbours(rows)
    assert nn_descent.nearest_rows(empty(df), lambda i: i % 100 == 0).count() == 0


def test_graph_search_recall(spark):
    random_ = np.random.default_rng(5)
    centres = random_.standard_normal((20, 24))
    x = centres[random_.integers(0, 20, 3000)] + 0.5 * random_.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nn_descent.nearest_rows(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in range(0, 3000, 100)]
    assert np.mean(hits) >= 9


def neighbour_hits(spark, x):
    """Of the ten nearest of every 100th row, how many are found on average."""
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nn_descent.nearest_rows(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in range(0, len(x), 100)])


def test_scores_are_sums_in_the_order_of_the_components(spark):
    x = np.random.default_rng(2).standard_normal((300, 33))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in nn_descent.nearest_rows(df, lambda i: i % 100 == 0).collect():
        total = 0.0
        for a, b in zip(x[r.query_id].tolist(), x[r.vec_id].tolist()):
            total += (a - b) * (a - b)
        assert r.score == total**0.5


def test_recall_with_a_huge_vector(spark):
    x = np.random.default_rng(5).standard_normal((3000, 24))
    x[1] = 1e8
    assert neighbour_hits(spark, x) >= 9


def test_recall_among_near_equal_vectors(spark):
    random_ = np.random.default_rng(5)
    x = random_.standard_normal((4000, 24))
    x[::2] = x[0] + 1e-6 * random_.standard_normal((2000, 24))
    assert neighbour_hits(spark, x) >= 9


def test_rounds_until_lists_settle(spark, monkeypatch, caplog):
    """From a poor start, with no new entry allowed, more than four rounds are run and the last brings nothing new."""
    x = np.random.default_rng(8).standard_normal((2000, 8))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, d array<double>")
    for name, value in (("START_NEIGHBOURS", 2), ("STARTS", 3), ("BLOCK", 16), ("SETTLED", 0), ("PART_BYTES", 1 << 17)):
        monkeypatch.setattr(nn_descent, name, value)
    with caplog.at_level("INFO", logger=nn_descent.__name__):
        vectors, kind = nn_descent.packed(nodes)
        lists = nn_descent.build(vectors.withColumnRenamed("id", "u"), kind, 8, 2000).select("u", "v", "d").collect()
    assert kind == "<f8" and len(lists) == 2000
    for r in lists[::97]:
        assert len(set(r.v)) == nn_descent.NEIGHBOURS and r.u not in r.v and r.d == sorted(r.d)
        assert r.d == pytest.approx(np.sqrt(((x[r.v] - x[r.u]) ** 2).sum(1)).tolist())
    rounds = [r.getMessage() for r in caplog.records if r.name == nn_descent.__name__]
    assert len(rounds) > 4 and ": 0 of " in rounds[-1]


def test_parameters_grow_with_log_n():
    assert nn_descent.grown(16, 0) == nn_descent.grown(16, 2**13) == 16 < nn_descent.grown(16, 10**5) < nn_descent.grown(16, 10**7) == 29


def test_surrogates(spark):
    rows = [
        (1, "write to the.72@mail3.example.com or THE.72@MAIL3.EXAMPLE.COM or b@mail3.example.com"), (2, "cards 4713676230380914, 4111 1111 1111 1111 and 4111-1111-1111-1111"),
        (3, "call +1 (487) 555-7209. or 487-555-7209"), (4, "ip 169.122.221.182 and 10.1.2.3."), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok'),
        (6, "Mr. John Smith met Mrs Jane Smith; Mr Smith left. Dr. Иван Петров"), (7, None), (8, ""), (8, ""), (None, "b@mail3.example.com"), (9, "1234 and 12.5 and a@b"),
    ]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, key string, n_entities int")
    got = pii.replace(df, "secret").collect()
    new = {r.doc_id: r.text for r in got}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(r.key == "k" for r in got)
    a, b, c = re.fullmatch(r"write to (\S+) or (\S+) or (\S+)", new[1]).groups()
    assert a.upper() == b and a.split("@")[1] == c.split("@")[1] and a != "the.72@mail3.example.com" and new[None] == c
    one, two, three = re.fullmatch(r"cards (\d{16}), (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4})", new[2]).groups()
    assert two.replace(" ", "") == three.replace("-", "") and one != "4713676230380914"
    luhn = lambda s: sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(s[::-1])) % 10
    assert luhn(two.replace(" ", "")) == 0 and luhn(one) == luhn("4713676230380914")
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}\. or \d{3}-\d{3}-\d{4}", new[3]) and "555-7209" not in new[3]
    assert re.fullmatch(r"ip (\d+\.){3}\d+ and 10\.(\d+\.){2}\d+\.", new[4]) and "169.122" not in new[4]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" ok', new[5]) and "04dbebab" not in new[5]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); Mr (\w+) left\. Dr\. (\w+) (\w+)", new[6])
    assert m[2] == m[4] == m[5] != "Smith" and m[1] in pii.GIVEN["m:latin"] and m[3] in pii.GIVEN["f:latin"] and m[6] in pii.GIVEN["m:cyrillic"]
    assert new[7] is None and new[8] == "" and new[9] == rows[-1][1]
    assert {r.doc_id: r.n_entities for r in got}[1] == 3
    assert pii.replace(empty(df), "secret").count() == 0
    assert sorted(map(str, got)) == sorted(map(str, pii.replace(df, "secret").collect())) and pii.replace(df, "other").where("doc_id = 1").first().text != new[1]


def test_surrogates_stay_distinct(spark):
    """One-letter names leave fewer surrogates than names: collisions are found and resolved."""
    names = [(f"{c}@{d}.example.com",) for c in "abcdefghijklmnopqrstuvwxyz0123456789" for d in ("x", "y")]
    df = spark.createDataFrame(names, "text string")
    local = pii.dictionary(df.select(F.lit("local").alias("kind"), F.regexp_extract("text", "^([^@]*)@", 1).alias("canon")), "k").collect()
    assert len({r.surrogate for r in local}) == 36 and not {r.surrogate for r in local} & {r.canon for r in local}
    new = [r.text for r in pii.replace(df, "k").collect()]
    assert len(set(new)) == len(names) and not set(new) & {n for n, in names}


def test_fill_equals_brute_force():
    pick = random.Random(4)
    for _ in range(200):
        lengths = pick.sample(range(0, 15), pick.randint(1, 4))
        counts, budget = [pick.randint(0, 4) for _ in lengths], pick.randint(0, 60)
        taken = mixing.fill(lengths, counts, budget)
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(a * b for a, b in zip(taken, lengths)) == max(s for s in sums if s <= budget)
        near = sum(a * b for a, b in zip(mixing.fill(lengths, counts, budget, 5), lengths))
        assert abs(near - budget) == min(abs(s - budget) for s in sums if s <= budget + 5)
    big = mixing.fill([7, 1000, 50001], [10**6, 10**6, 10**6], 10**9 + 6)
    assert sum(a * b for a, b in zip(big, [7, 1000, 50001])) == 10**9 + 6


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above


def mixing_rows():
    pick, rows = random.Random(6), []
    for s, n in (("a", 40), ("é", 5), ("B", 30), (None, 20), ("z", 1), ("hot", 700)):
        rows += [(len(rows) + i, "w " * (pick.randint(1, 60) if s != "hot" else 9), s) for i in range(n)]
    return [*rows, (9000, None, "a"), (9001, "", None), (None, "x y", "a"), (9002, "same text", "a"), (9002, "same text", "a")]


def test_mixing(spark):
    rows = mixing_rows()
    df = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(df).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1 and all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    copies = sorted((str(r.doc_id), r.text) for r in mixing.mixed(df).collect())
    text = {}
    for i, t, _ in rows:
        text[i] = t
    assert copies == sorted((str(r.doc_id), text[r.doc_id]) for r in got for _ in range(r.copies))
    assert mixing.mix(empty(df)).count() == 0 and mixing.mixed(empty(df)).count() == 0


def test_copies_under_two_sources(spark):
    """Equal id and text under two sources: each source keeps its own share, and equal rows beyond one cell are all counted."""
    rows = [(None, "same words here", s, n) for s, m in (("a", 700), ("b", 40)) for n in range(m)] + [(i, "w " * (i % 5 + 1), "c", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang long")
    want: dict = {}
    for r in mixing.mix(df).collect():
        want[r.source] = want.get(r.source, 0) + r.copies
    outcomes = []
    for n in (1, 7):
        got = sorted(map(str, mixing.mixed(df.repartition(n)).collect()))
        assert {s: sum(f"source='{s}'" in g for g in got) for s in want} == want
        outcomes.append(got)
    assert outcomes[0] == outcomes[1]


def page_rows():
    return [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, None), (None, "x y\n", "a" * 2000), (5, "u", "é" * 600), (6, "u", "é" * 600), (6, "u", "é" * 600),
            (7, "u", "small"), (8, "u", "small"), (9, "", ""), (10, "u", "b" * 999), (11, "u", "b" * 999), (12, "u", "c" * 1000), (13, "u", "c" * 1000), (14, "big", "xyz" * 400000)]


def test_archives(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    compare(spark, "op7_warc", {"pages": df})
    folder, index = warc.archive(df.withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("x")))
    at = index.where("page_id = 14").first()
    whole = warc.read_record(spark, index, folder, at.record_id).first()
    assert (whole.payload_bytes, whole.record_type) == (1200000, "response")
    assert warc.read_records(warc.archive(empty(df))[1], folder).count() == 0


def test_bundles_are_plain_zstandard(spark):
    import zstandard

    df = spark.createDataFrame([(i, "u", f"page {i} " * 20000) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    folder, index = warc.archive(df)
    rows = index.orderBy("page_id").collect()
    assert len({r.frame for r in rows}) > 1
    path = f"{folder.removeprefix('file:')}/{rows[0].bundle}"
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 7 and b"page 5 page 5" in whole
    at, kinds = 0, []
    while at < len(whole):  # record by record, by its own length: the fields that every record must have
        head, _, rest = whole[at:].partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        assert first == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length"} <= set(fields)
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            http, _, body = rest[:size].partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200") and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + size + 4
    assert kinds == ["warcinfo", *["response"] * 6]
    with open(path, "rb") as f:
        starts = warc.read_seek_table(f, len(data))
    for r in rows:  # each frame stands alone
        start, size = starts[r.frame]
        raw = zstandard.ZstdDecompressor().decompress(data[start : start + size])
        head, payload = warc.parse_record(raw[r.frame_offset : r.frame_offset + r.record_bytes])
        assert head["WARC-Page-ID"] == str(r.page_id) and payload.decode() == f"page {r.page_id} " * 20000


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = nbsvm.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    accepted = {r.doc_id for r in nbsvm.score(docs, model).where("score >= 0.3").collect()}
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf), f"test-{name}")
        seen.append(after)
        if name != "bpe":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = after
    quality, dedup, private, mix, bpe_ = seen
    assert {r.doc_id for r in quality.collect()} == accepted and quality.count() == len(accepted)
    kept = [(r.doc_id, r.text) for r in quality.collect()]
    assert sorted(r.doc_id for r in dedup.collect()) == sorted({c for _, c in plain_classes(kept)})
    assert sorted(r.doc_id for r in private.collect()) == sorted(r.doc_id for r in dedup.collect())
    assert private.where(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mix(private).collect()}
    counted: dict = {}
    for r in mix.collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    assert counted == {i: c for i, c in copies.items() if c}
    assert bpe_.count() == mix.count() and bpe_.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_of_empty_tables(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="barloom-test-")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert "pipeline" not in queries.QUERIES


def test_batches_are_bounded_inside_only(spark):
    from barloom.llm.common import batches_of

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual, df = spark.conf.get(key), spark.range(100, numPartitions=1).mapInArrow(sizes, "n long")
    with batches_of(spark, 8):
        assert max(r.n for r in df.collect()) == 8
    assert spark.conf.get(key) == usual and max(r.n for r in spark.range(100, numPartitions=1).mapInArrow(sizes, "n long").collect()) == 100
