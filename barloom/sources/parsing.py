"""Vendor payloads, exchange files, pages and free text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number(x: Column) -> Column:
    """Number in text: thousands separators, percent and currency signs removed; null when not numeric."""
    return F.regexp_replace(F.trim(x), "[,%₹$]|Rs[.]?", "").try_cast("double")


def epoch_candles(df: DataFrame, intraday: bool = True, zone: str = "Asia/Kolkata") -> DataFrame:
    """``(symbol, epoch, open, high, low, close, volume)`` to local wall time; last duplicate wins."""
    from barloom.sources.archive import keep_last

    ts = F.from_utc_timestamp(F.timestamp_seconds("epoch"), zone)
    ts = ts if intraday else F.date_trunc("day", ts)
    out = df.withColumn("ts", ts).where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    return keep_last(out, ["symbol", "ts"], ["epoch", "seq"])


def columnar_payload(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per element of parallel arrays; a payload with unequal lengths is rejected whole."""
    same = None
    for f in fields[1:]:
        cond = F.size(f) == F.size(fields[0])
        same = cond if same is None else same & cond
    keep = [c for c in df.columns if c not in fields]
    return df.where(same).select(*keep, F.inline(F.arrays_zip(*fields)))


CSV_ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def vendor_csv(df: DataFrame, line: str, columns: list[str], min_rows: int = 50) -> DataFrame:
    """CSV lines with vendor headers to bars; a missing volume is 0, short symbols drop out."""
    names = [CSV_ALIASES.get(c.strip().lower(), c.strip().lower()) for c in columns]
    schema = ", ".join(f"`{n}` string" for n in names)
    p = df.select("symbol", F.from_csv(line, schema).alias("_r")).select("symbol", "_r.*")
    volume = F.coalesce(number(F.col("volume")), F.lit(0.0)) if "volume" in names else F.lit(0.0)
    p = p.select("symbol", F.to_date("date").alias("date"), *[number(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))
    long_enough = p.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    return p.join(long_enough.select("symbol"), "symbol", "left_semi")


def exchange_file(df: DataFrame) -> DataFrame:
    """Exchange day rows: quoted numbers, ``dd-MMM-yyyy`` dates, main series first per date."""
    day = F.try_to_date(F.trim("date_text"), "dd-MMM-yyyy")
    series = F.upper(F.trim("series"))
    rows = df.select(
        "symbol", day.alias("date"), series.alias("series"), number(F.col("close_text")).alias("close"),
        number(F.col("volume_text")).alias("volume"),
    ).where(F.col("date").isNotNull() & F.col("close").isNotNull() & F.col("series").isin("EQ", "BE", "BZ"))
    order = F.struct((F.col("series") != "EQ").cast("int"), F.col("series"), F.col("close"), F.col("volume"))
    g = rows.groupBy("symbol", "date").agg(F.min_by(F.struct("series", "close", "volume"), order).alias("x"))
    return g.select("symbol", "date", "x.series", "x.close", "x.volume")


def newest_delivery(df: DataFrame) -> DataFrame:
    """Delivery percent of the main series from the newest file of each symbol."""
    eq = df.where(F.trim("series") == "EQ")
    return eq.groupBy("symbol").agg(F.round(F.max_by("delivery_pct", "date"), 1).alias("delivery_pct"))


def keyword_hits(docs: DataFrame, words: list[str], per_group: int = 5, group: str = "lang") -> DataFrame:
    """First documents per group whose whole text holds any keyword.

    The rank filter keeps at most ``per_group`` rows per task before the
    shuffle, so a group with a third of all documents is no bottleneck.
    """
    text = F.lower("text")
    hit = None
    for w in words:
        cond = text.contains(w.lower())
        hit = cond if hit is None else hit | cond
    w = Window.partitionBy(group).orderBy("doc_id")
    return docs.where(hit).withColumn("position", F.row_number().over(w)).where(F.col("position") <= per_group)


def page_metrics(pages: DataFrame) -> DataFrame:
    """Figures pulled out of raw pages: title, headings, links, numbers, table cells."""
    h = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(h, F.lit(r"<a "), 0)).alias("links"),
        F.size(F.regexp_extract_all(h, F.lit(r"<p>"), 0)).alias("paragraphs"),
        F.regexp_extract(h, r"lang=\"([a-z]+)\"", 1).alias("lang"),
        F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1).alias("heading"),
        F.regexp_extract(h, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double").alias("first_percent"),
    )


def _objects(text: Column, strings: bool) -> Column:
    """(s, n): beginning and length of every balanced object in ``text``, in the order of their beginnings, longer ones first.

    A pushdown scan over tokens: an opening brace is pushed, a closing one
    pops the brace it answers, whatever the depth.  With ``strings``, braces
    inside a quoted string of an object don't count.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}]|[^"{}\\]+|\\'), 0)
    spans = F.array().cast("array<struct<s:int,n:int>>")
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("quoted"), F.array().cast("array<int>").alias("open"), spans.alias("found"))

    def step(acc: Column, t: Column) -> Column:
        inside = F.size(acc["open"]) > 0
        free = ~acc["quoted"]
        opens, closes = (t == "{") & free, (t == "}") & free & inside
        quoted = F.when(F.lit(strings) & (t == '"') & inside, ~acc["quoted"]).otherwise(acc["quoted"])
        at = F.element_at(acc["open"], -1)
        stack = F.when(opens, F.concat(acc["open"], F.array(acc["at"]))).when(closes, F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"])
        span = F.struct(F.when(closes, at).alias("s"), F.when(closes, acc["at"] - at + 1).alias("n"))
        found = F.when(closes, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.char_length(t)).alias("at"), quoted.alias("quoted"), stack.alias("open"), found.alias("found"))

    return F.array_sort(F.aggregate(tokens, start, step)["found"])


def first_json(text: Column) -> Column:
    """First JSON object in free text, fenced or embedded, of any depth; null when none parses.

    Fenced blocks come first, then balanced objects from the left, outer ones
    before what they hold; where quotes outside of objects hide the braces, a
    scan by braces alone follows.  Cost grows with the tokens of a text times
    the depth of its open braces.
    """
    parses = lambda x: F.get_json_object(x, "$").isNotNull() & x.startswith("{")
    fenced = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), 1), F.trim)
    cut = lambda o: F.substr(text, o["s"], o["n"])
    first = lambda found: F.try_element_at(F.filter(found, parses), F.lit(1))
    return F.coalesce(first(fenced), first(F.transform(_objects(text, True), cut)), first(F.transform(_objects(text, False), cut)))


def instrument_master(rows: DataFrame) -> DataFrame:
    """Equity rows of two exchanges folded to one record per ISIN."""
    nse = F.col("exchange") == "NSE"
    g = rows.where(F.col("kind") == "EQ").groupBy("isin").agg(
        F.max(F.when(nse, F.col("name"))).alias("_nse_name"), F.max("name").alias("_name"),
        F.max(F.when(nse, F.col("ticker"))).alias("ticker"), F.max(F.when(~nse, F.col("code"))).alias("bse_code"),
        F.max(F.when(nse, F.col("code"))).alias("nse_id"), F.max("series").alias("series"),
    )
    return g.select("isin", F.coalesce("_nse_name", "_name").alias("name"), "ticker", "nse_id", "bse_code", "series")


def universes(members: DataFrame) -> DataFrame:
    """Named lists as ``(universe, symbol, pos)``: order-preserving distinct by lowest position."""
    return members.groupBy("universe", "symbol").agg(F.min("pos").alias("pos"))


def watchlist_add(current: DataFrame, names: DataFrame) -> DataFrame:
    norm = lambda d: d.select(F.upper(F.trim("symbol")).alias("symbol"))
    return norm(current).unionByName(norm(names)).distinct()


def watchlist_remove(current: DataFrame, names: DataFrame) -> DataFrame:
    return current.join(names.select(F.upper(F.trim("symbol")).alias("symbol")), "symbol", "left_anti")
