"""Registered queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bond, bpe, language, licenses, line_rules, merkle, mixing, nbsvm, nn_descent, pii, prob_minhash, unigram_counts, warc
from barloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; only its path is used, nothing is copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES["op3_bpe"] = op3_bpe


def op8_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = unigram_counts.piece_vocab(tokenizer_file("piece_bpe_32k.model"))
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), vocab)


QUERIES["op8_unigram_counts"] = op8_unigram_counts


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES["op6_mixing"] = op6_mixing


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op7_warc"] = op7_warc
ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last, payload_bytes >= 1000 AS large FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN large AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN large AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q
"""


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


QUERIES["op10_line_rules"] = op10_line_rules
ORACLES["op10_line_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, source, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
        FROM (SELECT r, source, text, unnest(lines) AS x FROM w)),
common AS (SELECT source, line FROM ln GROUP BY source, line HAVING count(DISTINCT text) > {line_rules.LINE_LIMIT}),
rem AS (SELECT r, sum(len(string_split(ln.line, ' '))) AS n FROM ln JOIN common c ON ln.line = c.line AND ln.source IS NOT DISTINCT FROM c.source GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(rem.n, 0) AS BIGINT) AS n_removed_words
    FROM w LEFT JOIN cov USING (r) LEFT JOIN rem USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {line_rules.LEFT_WORDS}
    OR n_words - n_removed_words < {line_rules.LEFT_SHARE} * n_words)) AS kept FROM f
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    k = licenses.K
    rows = ", ".join(
        f"({t}, '{label}', {base}, {grams}, {pos}, '{' '.join(words)}')" for t, label, base, grams, pos, *words in licenses.template_rows(licenses.templates())
    )
    return rf"""
WITH t(template, label, base, grams, tpos, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
g AS (SELECT r, p - 1 AS pos, array_to_string(w[p:p + {k - 1}], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS p FROM d WHERE len(w) >= {k})),
v AS (SELECT r, template, label, base, grams, pos - tpos AS diagonal, list(tpos) AS hits, min(pos) AS s, max(pos) + {k} AS e
    FROM g JOIN t USING (gram) GROUP BY ALL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.NEAR} THEN 1 ELSE 0 END AS fresh FROM v)),
sp AS (SELECT r, template, label, base, grams, span, count(*) FILTER (len(hits) = grams) AS places, min(diagonal) FILTER (len(hits) = grams) AS f,
        max(diagonal) FILTER (len(hits) = grams) AS l, len(list_distinct(flatten(list(hits)))) / max(grams) AS cover, max(e) - min(s) AS width FROM n GROUP BY ALL),
ok AS (SELECT *, cover >= {licenses.COVER} AND (width <= {licenses.LONGEST} * (grams + {k - 1}) OR places > 0) AS good, base AND places > 0 AS b FROM sp)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, CAST(coalesce(sum(places) FILTER (b), 0) AS BIGINT) AS n_base,
    CAST(min(f) FILTER (b) AS BIGINT) AS first_word, CAST(max(l) FILTER (b) AS BIGINT) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels, coalesce(max(cover) FILTER (good), 0.0) AS score
FROM d LEFT JOIN ok USING (r) GROUP BY r, doc_id
"""


QUERIES["op9_licenses"] = op9_licenses
ORACLES["op9_licenses"] = _license_sql()


#: Key of the registered query's surrogates; a deployment passes its own secret.
SURROGATE_KEY = "check"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


QUERIES["op5_surrogates"] = op5_surrogates


def op2_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model)
    return scored.select(
        "doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted")
    )


QUERIES["op2_nbsvm"] = op2_nbsvm


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES["op1_prob_minhash"] = op1_prob_minhash


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_rows(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


QUERIES["op4_nn_descent"] = op4_nn_descent


def op11_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, shifted)


QUERIES["op11_bond"] = op11_bond
ORACLES["op11_bond"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
        list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS c
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, v.r AS o, v.vec_id AS id, v.label = a.label AS same, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
    FROM v a JOIN v ON a.r <> v.r AND len(a.c) = len(v.c) WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, o, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST, o) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.id NULLS LAST, s.o) AS k
    FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""


def op12_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES["op12_bigru"] = op12_bigru


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, four bits at a time."""
    steps = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    half = lambda a: f"xor(({a}) >> 4, {steps}[(({a}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {half(half('xor(a, b)'))}), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """Levels of runs of 16 up to 16 ** ``levels`` leaves, first of each source, then of the sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS now FROM documents)",
        "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS src, count(*) OVER () AS many FROM (SELECT DISTINCT source FROM d))",
        "a0 AS (SELECT r, doc_id, leaf, now, src, many, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
        "l0 AS (SELECT src, i, leaf AS digest, n FROM a0)",
        "f0 AS (SELECT r, src, i, now AS acc, '' AS proof FROM a0)",
    ]
    for part in range(2):
        for k in range(part * levels, (part + 1) * levels):
            parts += [
                f"r{k} AS (SELECT src, i >> 4 AS run, list(digest ORDER BY i) AS ch, any_value(n) AS n FROM l{k} WHERE n > 1 GROUP BY ALL)",
                f"l{k + 1} AS (SELECT src, run AS i, sha256(array_to_string(ch, '')) AS digest, (n + 15) // 16 AS n FROM r{k} UNION ALL SELECT src, i, digest, n FROM l{k} WHERE n = 1)",
                f"""f{k + 1} AS (SELECT r, src, CASE WHEN ch IS NULL THEN i ELSE run END AS i,
                    CASE WHEN ch IS NULL THEN acc ELSE sha256(array_to_string(ch[:i & 15], '') || acc || array_to_string(ch[(i & 15) + 2:], '')) END AS acc,
                    CASE WHEN ch IS NULL THEN proof ELSE proof || array_to_string(ch[:i & 15], '') || array_to_string(ch[(i & 15) + 2:], '') END AS proof
                    FROM f{k} LEFT JOIN (SELECT src AS s2, run, ch FROM r{k}) ON src = s2 AND run = i >> 4)""",
            ]
        if not part:  # the subroots are the leaves of the upper tree
            k = levels
            parts[-2] = parts[-2].replace(f"l{k} AS", "sub AS")
            parts[-1] = parts[-1].replace(f"f{k} AS", "g AS")
            parts += [f"l{k} AS (SELECT 0 AS src, src AS i, digest, (SELECT count(*) FROM sub) AS n FROM sub)", f"f{k} AS (SELECT r, 0 AS src, src AS i, acc, proof FROM g)"]
    last = 2 * levels
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, sub.digest AS subroot, l{last}.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = l{last}.digest AS verified
FROM a0 JOIN f{last} USING (r) JOIN sub ON sub.src = a0.src JOIN l{last} ON true"""


QUERIES["op13_merkle"] = op13_merkle
ORACLES["op13_merkle"] = _merkle_sql()
