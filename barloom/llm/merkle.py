"""Merkle manifest of a table: a content-addressed DAG of digests, proofs by descent from the root.

Every row is a leaf.  The leaves of a source, by id, are hashed in runs of
``FANOUT`` to a subroot, and the subroots, by source, likewise to the root.
The store holds one record a digest: its children.  It is addressed by
content alone: equal subtrees are one record.

A proof request is a leaf's place as digits to the base ``FANOUT``.  Requests
descend from the root: at each record the digit picks the child to follow and
the others become a segment of the proof, on its left and its right; at the
leaf the segments are reversed.  Requests with a common beginning descend
together, so a level handles as many rows as it has nodes, not as there are
requests, and no record is asked for more than once by different nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written

FANOUT = 16
#: Levels of records: runs of leaves are 1; those above the subroots are counted from here.
TOP = 1000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**values: Column) -> Column:
    """Digest of a row's fields in the order given: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.sha2(F.concat(*[_field(v) for v in values.values()]), 256)


def run_digest(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its place, from 0, in the order of ``keys``, written.

    Rows are sorted by ranges of the keys; a task counts its own rows and
    starts where the ranges before it end, so nothing is numbered in one task.
    """
    placed = written(df.sort(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    block = F.shiftright("_at", 33).alias("_block")
    sizes = placed.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")
    starts = sizes.select("_block", before.alias("_start"))
    return placed.withColumn("_block", F.shiftright("_at", 33)).join(starts, "_block").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_block", "_start")


@dataclass
class Manifest:
    """``root`` digest (null for an empty table); ``store`` (digest, level, children); ``leaves`` (src, run, digit, leaf and the columns kept);
    ``sources`` (src, source, n, subroot), ``src`` being the place of the source."""

    root: str | None
    store: DataFrame
    leaves: DataFrame
    sources: DataFrame


def _level(nodes: DataFrame, group: list[str], level: int) -> DataFrame:
    """Runs of ``FANOUT`` consecutive nodes (group..., i, digest): (group..., i, digest, level, children)."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda c: c["digest"])
    runs = nodes.groupBy(*group, F.shiftright("i", FANOUT.bit_length() - 1).alias("run")).agg(children.alias("children"))
    return runs.select(*group, F.col("run").alias("i"), run_digest(F.col("children")).alias("digest"), F.lit(level).alias("level"), "children")


def _records(nodes: DataFrame) -> DataFrame:
    return nodes.select("digest", "level", "children").dropDuplicates(["digest"])


def build(leaves: DataFrame, keep: tuple[str, ...] = ()) -> Manifest:
    """Manifest of ``leaves`` (source, doc_id, leaf and the columns of ``keep``).

    Leaves of a source go by doc_id, nulls first, repeated ids by digest (rows
    with equal digests are alike, so their order does not matter); sources by
    their bytes, null first.  A source may hold any share of the rows: places
    come from a sort by all keys, and runs are the only groups.
    """
    spark = leaves.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf")]
    own = written(numbered(leaves.select("source", "doc_id", "leaf", *keep), order, "place"), "leaves")
    sources = own.groupBy("source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = written(numbered(sources, [F.col("source").asc_nulls_first()], "src"), "sources")
    joined = own.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.*", "s.src", (F.col("place") - F.col("s.first")).alias("i"))
    ranked = written(joined.drop("place"), "ranked")
    most = sources.agg(F.max("n")).first()[0]
    if most is None:
        none = spark.createDataFrame([], "digest string, level int, children array<string>")
        return Manifest(None, none, ranked.select("src", F.col("i").alias("run"), F.lit(0).alias("digit"), "source", "doc_id", "leaf", *keep), sources.select("src", "source", "n", F.lit(None).cast("string").alias("subroot")))
    # Subroots: a source's tree ends where one node is left.
    nodes = ranked.select("src", "i", F.col("leaf").alias("digest"))
    counts = sources.select("src", F.col("n").alias("left"))
    records, done, level = [], [], 0
    while True:
        held = nodes.join(counts, "src")
        done.append(held.where("left = 1").select("src", "digest"))
        if most == 1:
            break
        level += 1
        made = written(_level(held.where("left > 1"), ["src"], level), f"level-{level}")
        records.append(_records(made))
        nodes = made.select("src", "i", "digest")
        counts = counts.where("left > 1").select("src", F.ceil(F.col("left") / FANOUT).alias("left"))
        most = -(-most // FANOUT)
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.union(more)
    subroots = written(subroots, "subroots")
    nodes, left, level = subroots.select(F.col("src").alias("i"), "digest"), sources.count(), TOP
    while left > 1:
        level += 1
        made = written(_level(nodes, [], level), f"level-{level}")
        records.append(_records(made))
        nodes, left = made.select("i", "digest"), -(-left // FANOUT)
    root = nodes.first()["digest"]
    store = records[0] if records else spark.createDataFrame([], "digest string, level int, children array<string>")
    for more in records[1:]:
        store = store.union(more)
    store = written(store, "store")
    bits = FANOUT.bit_length() - 1
    placed = ranked.select("src", F.shiftright("i", bits).alias("run"), F.col("i").bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias("digit"), "source", "doc_id", "leaf", *keep)
    return Manifest(root, store, placed, sources.join(subroots, "src").select("src", "source", "n", F.col("digest").alias("subroot")))


def _split(children: Column, at: Column) -> Column:
    """Segment of a proof: what stands left and right of child ``at`` (from 0), joined."""
    left = F.concat_ws("", F.slice(children, 1, at))
    right = F.concat_ws("", F.slice(children, at + 2, F.greatest(F.size(children) - at - 1, F.lit(0))))
    return F.struct(left.alias("l"), right.alias("r"))


def _asked(wanted: DataFrame, levels: list[int]) -> DataFrame:
    """(s, a, h): source (null above the subroots), place and height of every node on the way to a wanted run."""
    bits = FANOUT.bit_length() - 1
    tops, heights = [lv - TOP for lv in levels if lv > TOP], {0, *(lv - 1 for lv in levels if lv < TOP)}
    place = lambda of, h: F.shiftright(of, bits * h)
    nodes = [F.struct(F.lit(None).cast("long").alias("s"), place("src", h).alias("a"), F.lit(h).alias("h")) for h in tops]
    nodes += [F.struct(F.col("src").alias("s"), place("run", h).alias("a"), F.lit(h).alias("h")) for h in heights]
    return wanted.select("src", "run").distinct().select(F.inline(F.array(*nodes))).distinct()


def descend(store: DataFrame, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Runs of leaves met from ``root``: (src, run, children, segments), the segments from the root down.

    ``wanted`` (src, run) limits the descent to the branches that lead to
    those runs.  A source of one leaf has a run whose children are null: its
    leaf is the subroot itself.
    """
    spark, bits = store.sparkSession, FANOUT.bit_length() - 1
    segment = "array<struct<l:string,r:string>>"
    state = spark.range(1).select(F.lit(None).cast("long").alias("src"), F.lit(0).cast("long").alias("at"), F.lit(root).alias("digest"), F.array().cast(segment).alias("segments"))
    asked = None
    if wanted is not None:
        asked = written(_asked(wanted, [r["level"] for r in store.select("level").distinct().collect()]), "asked")  # a row a level
    arrived = []
    while True:
        met = state.join(store, "digest", "left")
        # The first record below the top tells the place of its source.
        enters = F.col("src").isNull() & (F.coalesce("level", F.lit(0)) < TOP)
        src, at = F.when(enters, F.col("at")).otherwise(F.col("src")), F.when(enters, 0).otherwise(F.col("at"))
        met = met.select(src.alias("src"), at.alias("at"), "level", "children", "segments")
        if asked is not None:
            height = F.coalesce(F.when(F.col("level") > TOP, F.col("level") - TOP), F.col("level") - 1, F.lit(0))
            met = met.join(asked, F.col("src").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (height == F.col("h")), "left_semi")
        met = written(met, "descent")
        arrived.append(met.where("level is null or level = 1").select("src", F.col("at").alias("run"), "children", "segments"))
        above = met.where("level > 1")
        if above.isEmpty():
            break
        state = above.select("src", "at", "children", "segments", F.posexplode("children").alias("digit", "digest")).select(
            "src", (F.shiftleft("at", bits) + F.col("digit")).alias("at"), "digest", F.concat("segments", F.array(_split(F.col("children"), F.col("digit")))).alias("segments"))
    out = arrived[0]
    for more in arrived[1:]:
        out = out.union(more)
    return out


def prove(manifest: Manifest, start: Column, requests: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """Proof of each leaf, or of those of ``requests`` (src, run, digit): the columns of ``leaves`` and

    ``subroot``; ``proof_sha256`` and, with ``texts``, ``proof`` (the digests
    of the siblings, level by level from the leaf's run to the root, left to
    right, joined); ``folded`` (the root recomputed from ``start``, a column
    of ``leaves``, and the siblings).
    """
    leaves = manifest.leaves.withColumn("_start", start)
    if requests is not None:
        leaves = leaves.join(requests.select("src", "run", "digit").distinct(), ["src", "run", "digit"], "left_semi")
    columns = [c for c in leaves.columns if c not in ("src", "run", "_start")]
    if manifest.root is None:
        none = [F.lit(None).cast("string").alias(c) for c in ("subroot", "proof_sha256", *["proof"][: int(texts)], "folded")]
        return leaves.select("src", "run", *columns, *none)
    grouped = leaves.groupBy("src", "run").agg(F.collect_list(F.struct(*columns, "_start")).alias("asked"))
    paths = descend(manifest.store, manifest.root, None if requests is None else leaves)
    met = grouped.join(paths, ["src", "run"]).join(manifest.sources.select("src", "subroot"), "src")
    up = F.reverse("segments")

    def proven(leaf: Column) -> Column:
        own = F.when(F.col("children").isNotNull(), _split(F.col("children"), leaf["digit"]))
        first = F.when(own.isNotNull(), F.concat(own["l"], own["r"])).otherwise(F.lit(""))
        proof = F.aggregate(up, first, lambda acc, s: F.concat(acc, s["l"], s["r"]))
        begin = F.when(own.isNotNull(), F.sha2(F.concat(own["l"], leaf["_start"], own["r"]), 256)).otherwise(leaf["_start"])
        folded = F.aggregate(up, begin, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
        more = [proof.alias("proof")] if texts else []
        return F.struct(*[leaf[c].alias(c) for c in columns], F.col("subroot").alias("subroot"), F.sha2(proof, 256).alias("proof_sha256"), *more, folded.alias("folded"))

    return met.select("src", "run", F.inline(F.transform("asked", proven)))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Digests and checked proofs of every document.

    ``tampered`` tells the rows whose text has A-Z lower-cased after the
    manifest was made; none by default.  Returns doc_id, leaf, subroot, root,
    proof_sha256 (of the siblings' digests), folded_root (from the leaf as it
    is now and the siblings of the manifest) and verified (equals root).

    A null in any field is ``-`` in the leaf and a null id or source comes
    first; empty texts have a length of 0; texts are hashed whole, whatever
    their length.  Repeated rows are leaves of their own and may differ in
    proofs, as their places differ.  Further columns play no part; an empty
    table gives an empty one.
    """
    types = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    own = docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])
    leaf = leaf_digest(**{c: F.col(c) for c in FIELDS})
    changed = leaf_digest(**{c: lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS})
    touched = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = own.select("source", "doc_id", leaf.alias("leaf"), F.when(touched, changed).alias("now"))
    manifest = build(leaves, ("now",))
    proofs, root = prove(manifest, F.coalesce("now", "leaf"), texts=False), F.lit(manifest.root).cast("string")
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
