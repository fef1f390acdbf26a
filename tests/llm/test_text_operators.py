"""Tokenizers, classifier, rules, licenses: against libraries, brute force and SQL."""

import hashlib
import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from llm_fixtures import DOCS, ODD, compare, empty

from barloom.llm import bpe, licenses, line_rules, nbsvm, queries, textblocks, unigram_counts

@pytest.fixture(scope="module")
def texts(sf):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()]


POOLS = ["abc ' \n\t", "aab<|endoftext|>", "ΣσςİıẞǅÉ́̈", "日本語한국어１２³", "\x1c\x1e\x85​\xa0　﻿", "'s't're'LL$%&!?", "👍🏽🇩🇪", "\u0000\x0b"]


def test_bpe_equals_the_library(texts):
    path = queries.tokenizer_file("word_bpe_49k.json")
    own, library, pick = bpe.PrefixEncoder(json.load(open(path))), Tokenizer.from_file(path), random.Random(1)
    made = ["".join(pick.choice(pick.choice(POOLS)) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    for text in [*texts, *made, "ab" * 5000, "<|startoftext|>" * 3]:
        want = library.encode(text, add_special_tokens=False)
        ids, n, decoded = own.encode(text)
        assert ids == " ".join(map(str, want.ids)) and n == len(want.ids)
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_pairs_equal_merging(texts):
    """Two tokens are compatible exactly when the library leaves their concatenation apart."""
    path = queries.tokenizer_file("word_bpe_49k.json")
    own, library = bpe.PrefixEncoder(json.load(open(path))), Tokenizer.from_file(path)
    plain = [(t.removesuffix("</w>"), i) for t, i in list(library.get_vocab().items())[:3000] if t.endswith("</w>") and t.removesuffix("</w>").isalpha() and t.isascii() and t.islower()]
    heads = [(t, i) for t, i in list(library.get_vocab().items())[:6000] if not t.endswith("</w>") and t.isalpha() and t.isascii() and t.islower()]
    pick = random.Random(3)
    for _ in range(2000):
        (a, i), (b, j) = pick.choice(heads), pick.choice(plain)
        assert own.compatible(i, j) == (library.encode(a + b, add_special_tokens=False).ids == [i, j])


def test_bpe_rows(spark, odd):
    path = queries.tokenizer_file("word_bpe_49k.json")
    library, sha = Tokenizer.from_file(path), lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.encode(odd, path, with_ids=True, with_text=True).collect()
    want = []
    for r in ODD:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(back), ids, back))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode(empty(odd), path).count() == 0


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_counts_equal_the_library(texts, with_bytes):
    vocab = unigram_counts.piece_vocab(queries.tokenizer_file("piece_bpe_32k.model"))
    vocab = [v for v in vocab if with_bytes or not v[0].startswith("<0x")]
    library = Tokenizer(models.Unigram(vocab, 0, with_bytes))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own, pick = unigram_counts.Counter(vocab), random.Random(2)
    pools = ["abcdefgh  ", "the and ▁▁", "日本語\n\n\t", "<unk><s>", "éàüß", " 👍"]
    made = ["".join(pick.choice(pick.choice(pools)) for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    for text in [*texts, *made, "<s>a<unk>", "<unk>\n\n", "x" * 20000]:
        assert own.count(text)[1] == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_unigram_ties_go_to_the_longest_piece():
    own = unigram_counts.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    assert own.count("ab") == (-3.0, 2)  # ▁ and ab, not ▁ a b


def test_unigram_rows(odd):
    vocab = unigram_counts.piece_vocab(queries.tokenizer_file("piece_bpe_32k.model"))
    own = unigram_counts.Counter(vocab)
    got = unigram_counts.token_counts(odd, vocab).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], own.count(r[1])[1], own.count(r[1])[0]) for r in ODD], key=str)
    assert unigram_counts.token_counts(empty(odd), vocab).count() == 0


def test_word_hashes_equal_words(texts):
    import re

    both = [None, "", "a b a", " aé b ", *texts[:50]]
    seen: dict[int, str] = {}
    for block in textblocks.blocks(pa.array(both)):
        for i in range(block.n):
            words = re.findall(r"[^\x20\x09-\x0D]+", both[block.first + i] or "")
            own = block.word[block.doc == i].tolist()
            assert len(own) == len(words)
            for h, w in zip(own, words):
                assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)
    block = next(textblocks.blocks(pa.array(["a b c", "a b", "x a b c d e f", "a b c d e"])))
    doc, run = textblocks.shingles(block, 5)
    assert sorted(doc.tolist()) == [0, 1, 2, 2, 2, 3] and len(set(run.tolist())) == 5  # the last is in the third


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op2_nbsvm"](spark, sf).collect()}
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    held = [(marks[i], r) for i, r in got.items() if r.held_out and i in marks]
    right = np.mean([r.predicted == q for q, r in held])
    good = [r.predicted for q, r in held if q == 1]
    assert len(got) == 1000 and right >= 0.9 and np.mean(good) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_classifier_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = nbsvm.score(odd.drop("label"), nbsvm.fit(odd, none)).collect()
    assert len(scored) == len(ODD) and all(r.score == 0.5 for r in scored)
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 0), (5, 0), (6, 1), (7, 1)], "doc_id long, quality int")
    model = nbsvm.fit(odd, marks)
    assert all(0 <= r.score <= 1 for r in nbsvm.score(odd, model, "label").withColumnRenamed("label", "score").collect())
    assert nbsvm.score(empty(odd), model).count() == 0
    assert nbsvm.fit(empty(odd), empty(marks)).bias == 0


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    weights, bias = nbsvm.dual_descent(rows * 10, np.array([1, 1, 0, 0] * 10), np.ones(4))
    margin = [weights[r].sum() / np.sqrt(2) + bias for r in rows]
    assert min(margin[:2]) > 0 > max(margin[2:])


def rule_rows():
    phrase = "a b c d e f g h i j"
    shared = "this line is on every page of the host and says nothing at all"
    rows = [(i, f"{shared}\nown {i} words of page {i} are these ones here\n{shared}", "en", "h", 1) for i in range(100, 130)]
    rows += [(200, f"{phrase} x {phrase} y {phrase}", "en", None, 1), (201, "# a\n# a\n#  A\n\n|||\n" * 3, "en", "h", 1), (202, " ".join(f"w{i}" for i in range(40)), "en", "h", 1)]
    return rows


def test_line_rules_equal_sql(spark):
    rows = [*ODD, *rule_rows()]
    df = spark.createDataFrame(rows, DOCS)
    want, names = compare(spark, "op10_line_rules", {"documents": df})
    by_id = {r[names.index("doc_id")]: dict(zip(names, r)) for r in want}
    assert not by_id[100]["kept"] and by_id[100]["n_removed_words"] == 28 and by_id[202]["kept"]
    assert by_id[200]["n_repeat_words"] == 30 and by_id[200]["base_failed"]
    assert line_rules.line_rules(empty(df)).count() == 0


def license_rows():
    apache = dict((a, b) for a, b in licenses.NOTICES)["apache-2"].split()
    return [
        (300, "Released under the MIT License. Under The MIT-License!", "en", "a", 1),
        (301, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0", "en", "a", 1),
        (302, "x " * 50 + " ".join(apache[:8] + ["added"] + apache[8:]) + " y", "en", "a", 1),
        (303, "under the mit", "en", "a", 1), (304, "cc by nc cc by nc", "en", "a", 1), (305, "É under the mit license", "fr", "a", 1),
        (306, "GNU General Public License, version 3", "en", "a", 1), (307, " ".join(apache[:6]), "en", "a", 1),
    ]


def test_licenses_equal_sql(spark):
    df = spark.createDataFrame([*ODD, *license_rows()], DOCS)
    want, names = compare(spark, "op9_licenses", {"documents": df})
    by_id = {r[names.index("doc_id")]: dict(zip(names, r)) for r in want}
    assert (by_id[300]["n_base"], by_id[300]["first_word"], by_id[300]["last_word"], by_id[300]["base_labels"]) == (2, 1, 5, "mit")
    assert by_id[301]["base_labels"] == "apache-2,cc-by-nc"
    assert "apache-2" in by_id[302]["labels"] and by_id[302]["score"] > 0.8
    assert by_id[303]["n_base"] == 0 and by_id[304]["n_base"] == 2 and by_id[305]["n_base"] == 1
    assert by_id[306]["labels"] == "gpl-3" and by_id[306]["base_labels"] == ""
    assert licenses.labels(empty(df)).count() == 0


def test_lines_counted_by_text_or_by_row(spark):
    from barloom.llm import line_rules

    page = "\n".join(f"line {i} of a page with some words in it" for i in range(6))
    rows = [(i, page, "en", "host", 1) for i in range(40)] + [(100 + i, f"own words of document {i} " * 9 + "\nshared footer line\n" + page.replace("page", f"p{i}"), "en", "host", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    by_text = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    by_row = {r.doc_id: r for r in line_rules.line_rules(docs, unit="row").collect()}
    assert by_text[0].n_removed_words == 0 and by_row[0].n_removed_words == by_row[0].n_words and not by_row[0].kept
    assert by_text[100].n_removed_words == by_row[100].n_removed_words == 3
