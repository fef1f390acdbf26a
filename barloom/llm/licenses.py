"""License scan by diagonal voting.

All rolling word k-grams of the documents are joined with the positions of the
same k-grams in the license templates.  A match at document word p and
template word t votes for the diagonal p - t, where the template would begin.
Votes are summed per document, template and diagonal; diagonals a few words
apart (words put in or left out) are merged into one span, and a span counts
when it covers enough of the template over about its length.

Votes are exact: the join compares the hash first and then the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.llm.common import narrow

K = 3
#: Diagonals this close belong to one span; share of the template's k-grams, and length against the template, that a span needs.
NEAR, COVER, LONGEST = 3, 0.8, 1.3

# Base phrases, found wherever their words stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Wording of public license notices.
NOTICES = [
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
]

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(templates: list[tuple[str, str, bool]]) -> list[tuple]:
    """(template, label, base, k-grams of the template, position, words of the k-gram); a few rows per template word."""
    rows = []
    for number, (label, text, base) in enumerate(templates):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        rows += [(number, label, base, len(words) - K + 1, i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    return rows


def templates() -> list[tuple[str, str, bool]]:
    return [(label, text, True) for label, text in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]


def template_table(spark: SparkSession, wanted: list[tuple[str, str, bool]]) -> DataFrame:
    rows = spark.createDataFrame(template_rows(wanted), "template int, label string, base boolean, grams int, tpos int, t0 string, t1 string, t2 string")
    return rows.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def scan(docs: DataFrame, wanted: list[tuple[str, str, bool]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: ``row``, ``id_col``, ``n_words``, one row per input row.
    spans: ``row``, ``id_col``, ``n_words``, ``template``, ``label``, ``base``,
    ``places`` (exact repetitions), ``first``, ``last`` (their smallest and
    largest start), ``cover`` and ``verified``; documents without any vote have
    one row with a null template.

    Null texts have no words; null or repeated ids are rows of their own;
    further columns are dropped; an empty table gives an empty one.  The
    template table is broadcast: its size is that of the given templates,
    whatever the documents.
    """
    wanted = templates() if wanted is None else wanted
    own = narrow(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = own.select(F.monotonically_increasing_id().alias("row"), "id", F.filter(F.split(lower, WORD_GAP), lambda w: w != "").alias("w"))
    own = own.withColumn("n_words", F.size("w").cast("long"))
    ahead = lambda i: F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}")
    grams = own.select("row", "id", "n_words", F.posexplode_outer(F.arrays_zip(*[ahead(i) for i in range(K)])).alias("pos", "g"))
    grams = grams.select("row", "id", "n_words", "pos", *[F.col(f"g.w{i}") for i in range(K)]).withColumn("h", F.xxhash64("w0", "w1", "w2"))
    table = template_table(docs.sparkSession, wanted)
    same = (grams["h"] == table["h"]) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    votes = grams.join(F.broadcast(table), same, "left").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = votes.groupBy("row", "id", "n_words", "template", "label", "base", "grams", "diagonal").agg(
        F.collect_list("tpos").alias("hits"), F.min("tpos").alias("from"), F.max("tpos").alias("to")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int")
    votes = votes.withColumn("span", F.sum(F.coalesce(fresh, F.lit(0))).over(order))
    start, end = F.col("diagonal") + F.col("from"), F.col("diagonal") + F.col("to") + K
    exact = F.size("hits") == F.col("grams")
    spans = votes.groupBy("row", "id", "n_words", "template", "label", "base", "grams", "span").agg(
        F.count(F.when(exact, 1)).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("first"), F.max(F.when(exact, F.col("diagonal"))).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("covered"), F.min(start).alias("start"), F.max(end).alias("end"),
    )
    spans = spans.withColumn("cover", F.col("covered") / F.col("grams"))
    # Repetitions right after each other merge; each exact one is a span by itself.
    fits = (F.col("cover") >= COVER) & ((F.col("end") - F.col("start") <= LONGEST * (F.col("grams") + K - 1)) | (F.col("places") > 0))
    return own.select("row", "id", "n_words"), spans.withColumn("verified", F.coalesce(fits, F.lit(False)))


def labels(docs: DataFrame, wanted: list[tuple[str, str, bool]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` (of exact base phrases),
    ``base_labels``, ``labels`` (distinct, sorted, comma-joined) and ``score``, the best cover of a verified span (else 0)."""
    _, spans = scan(docs, wanted, id_col, text_col)
    base = F.col("base") & (F.col("places") > 0)
    joined = lambda what: F.concat_ws(",", F.array_sort(F.collect_set(F.when(what, F.col("label")))))
    found = spans.groupBy("row", "id", "n_words").agg(
        F.sum(F.when(base, F.col("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("row").withColumnRenamed("id", id_col)
