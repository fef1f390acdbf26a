"""Quality rules: document measures and cross-document line frequency.

Lines are normalised (lower case, white space runs to one space) and hashed.
For each host the number of distinct texts a line occurs in is counted; lines
above the limit are boiler-plate and count as removed, and documents of which
too little is left are rejected.  Equal texts count once, so that copies do
not make all of their own lines frequent; finding copies is near-dedup's work.

Column expressions only: windows of words are hashed by doubling (pairs, fours,
eights) inside the row, and only per-line rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import WORD_GAP, narrow, written

#: A line in more than this many different texts of one host is boiler-plate.
LINE_LIMIT = 20
#: A document is depleted with fewer words left, or a smaller share of its words left.
LEFT_WORDS, LEFT_SHARE = 20, 0.2
#: Base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def _ahead(array: str, by: int) -> Column:
    """``array`` zipped with itself ``by`` places ahead, each pair hashed; empty if too short."""
    n = F.greatest(F.size(array) - by, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: words inside a window of eight words that occurs twice or more in the document."""
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn("_w", _ahead("_w", step))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(again, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get("_s", i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get("_s", i)["i"]))))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("until")),
        lambda a, p: F.struct((a["total"] + p + WINDOW - F.greatest(p, a["until"])).alias("total"), (p + WINDOW).alias("until")),
        lambda a: a["total"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_w", "_s", "_p")


def line_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_limit: int = LINE_LIMIT, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE, unit: str = "text",
) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_removed_words`` (in boiler-plate lines) and ``kept``.

    ``unit`` tells what counts for a line: each different text of the host
    that holds it ("text"), or each row ("row"), in which case the lines of a
    page that stands unchanged in many documents are boiler-plate too.

    A null text has no words and fails.  A null host is a host of its own.
    Null or repeated ids give one row per input row; repeated rows are equal
    texts and count once per line.  Lines without a word are not counted.  An
    empty table gives an empty one.  Texts of any length are measured whole, in
    memory that grows with the text; there are no ties, as a line is either
    above the limit or not.  Further columns are dropped.
    """
    own = narrow(docs, **{id_col: "long", text_col: "string", host_col: "string"}).toDF("id", "text", "host")
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("words", F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    with_word = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = own.withColumn("lines", with_word)
    own = repeated_words(own, "words", "n_repeat_words")
    normal = F.transform("lines", lambda x: F.trim(F.regexp_replace(F.lower(x), WORD_GAP, " ")))
    own = own.select(
        F.monotonically_increasing_id().alias("row"), "id", F.coalesce(F.concat(F.lit("+"), "host"), F.lit("-")).alias("host"),
        F.xxhash64("text").alias("of"), F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
    )
    own = written(own.withColumn("of", F.col("row")) if unit == "row" else own, "measures")
    lines = own.select("row", "host", "of", F.explode("lines").alias("x")).select("row", "host", "of", "x.line", "x.n")
    common = lines.groupBy("host", "line").agg(F.count_distinct("of").alias("texts")).where(F.col("texts") > line_limit).drop("texts")
    removed = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("n").alias("n_removed_words"))
    out = own.drop("lines", "of", "host").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < left_words) | (left < F.lit(left_share) * F.col("n_words")))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words",
    )
