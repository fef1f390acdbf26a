"""Personal data replaced by keyed surrogates of the same type.

Entities are found by pattern and cut into components: an address into local
part and domain, a person into given name and surname, the rest stay whole.
Equal components (after normalising case and layout) always get the same
surrogate, so references to one person, number or domain still agree; a
surrogate is a keyed digest written in the shape of the original: digits for
digits, letters for letters, names of the same gender and script, card numbers
with the same checksum remainder, private network addresses in the same range.

Collisions are checked over the corpus: two components never share a
surrogate, and no surrogate is itself a component found in the corpus.  The
smallest of those that clash keeps its surrogate, the others get their next.

Column expressions and joins only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import written

# Patterns of entities (Java regular expressions), tried in this order.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
TITLES_M = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"]
TITLES_N = ["Dr", "Prof"]
NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": NO_WORD_BEFORE + r"(?:[0-9A-Fa-f]{32,}|(?:sk|pk|ghp|gho|xoxb|AKIA)[_-]?[0-9A-Za-z]{16,})" + NO_WORD_AFTER,
    "ip": r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)"
             r"|(?<![0-9A-Za-z])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![0-9A-Za-z-])\d{3}[-.]\d{3}[-.]\d{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "card": NO_WORD_BEFORE + r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})" + NO_WORD_AFTER,
    "iban": NO_WORD_BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + NO_WORD_AFTER,
    "person": r"(?<!\p{L})(?:" + "|".join(TITLES_M + TITLES_F + TITLES_N) + r")\.? " + NAME + "(?: " + NAME + ")?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Given names by gender and script; further ones are made of syllables.
GIVEN = {
    "m:latin": ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Henry", "Ivan", "Jonas", "Kevin", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    "f:latin": ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "n:latin": ["Alex", "Billie", "Chris", "Dana", "Eden", "Frankie", "Gale", "Harper", "Indigo", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Robin", "Sasha"],
    "m:cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей"],
    "f:cyrillic": ["Анна", "Белла", "Вера", "Галина", "Дарья", "Ева", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Римма", "Софья"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "go", "hal", "ker", "lin", "mar", "no", "per", "ros", "sel", "tan", "ul", "ver", "wen"],
    "cyrillic": ["ба", "ден", "фел", "го", "хал", "кер", "лин", "мар", "но", "пер", "рос", "сел", "тан", "ул", "вер", "жен"],
}
MOST_ATTEMPTS = 64
HEX = "0123456789abcdef"


def _nibble(h: Column, i: Column | int) -> Column:
    """Value 0-15 of hex digit ``i`` (from 0) of ``h``, which is read around again past its end."""
    return F.instr(F.lit(HEX), F.substr(h, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(128)) + 1, F.lit(1))) - 1


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), at + 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shaped(canon: Column, h: Column, extra: Column) -> Column:
    """``h`` in the shape of ``canon``: digit for digit, letter for letter, anything else as it is; ``extra`` letters more."""
    digits, letters = F.translate(h, "abcdef", "012345"), F.translate(h, HEX, "abcdefghijklmnop")
    one = lambda source, i: F.substr(source, F.pmod(i, F.lit(128)) + 1, F.lit(1))
    shaped = F.transform(
        _chars(canon),
        lambda c, i: F.when(c.rlike("[0-9]"), one(digits, i)).when(c.rlike("[a-z]"), one(letters, i)).when(c.rlike("[A-Z]"), F.upper(one(letters, i))).otherwise(c),
    )
    return F.concat(F.array_join(shaped, ""), F.substr(letters, F.lit(100), extra))


def _checksum(digits: Column) -> Column:
    """Remainder of the card checksum."""
    back = F.reverse(_chars(digits))
    value = lambda c, i: c.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (c.cast("int") > 4), 9).otherwise(0)
    return F.pmod(F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate of one component; short components grow from the third attempt on."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)
    longer = F.greatest(attempt - 2, F.lit(0))
    octet = lambda i: (_nibble(h, 2 * i) * 16 + _nibble(h, 2 * i + 1)).cast("string")
    network = F.regexp_extract(canon, r"^(10\.|127\.|192\.168\.|169\.254\.)", 1)
    first = (F.pmod(_nibble(h, 6) * 16 + _nibble(h, 7), F.lit(111)) + 80).cast("string")  # between the reserved ranges, below multicast
    ip = F.when(network.isin("10.", "127."), F.concat(network, F.concat_ws(".", octet(0), octet(1), octet(2)))).when(
        network != "", F.concat(network, F.concat_ws(".", octet(0), octet(1)))).otherwise(F.concat_ws(".", first, octet(0), octet(1), octet(2)))
    country = F.when(canon.startswith("+"), F.regexp_extract(canon, r"^(\+\d)", 1)).otherwise("")
    shaped = _shaped(canon, h, F.lit(0))
    phone = F.concat(country, F.substr(shaped, F.length(country) + 1))
    off = F.pmod(F.substr(shaped, F.length(canon)).cast("int") + _checksum(canon) - _checksum(shaped), F.lit(10))
    card = F.concat(F.substr(shaped, F.lit(1), F.length(canon) - 1), off.cast("string"))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(3)))

    def name(script: str, count: Column, end: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], _nibble(h, i + 8)))
        return F.initcap(F.concat(F.array_join(parts, ""), end))

    def given(kind_name: str) -> Column:
        gender, script = kind_name.split(":")
        end = F.lit({"m": "", "f": "a" if script == "latin" else "а", "n": "y"}[gender])
        return F.when(attempt == 0, _pick(GIVEN[kind_name], _nibble(h, 0))).otherwise(name(script, attempt + 1, end))

    cyrillic_end = F.when(canon.rlike("[аая]$"), "ова").otherwise("ов")
    hexed = F.substr(F.repeat(h, F.ceil(F.length(canon) / 128).cast("int")), F.lit(1), F.length(canon))
    out = F.when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), hexed).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
    out = out.when(kind == "surname:latin", name("latin", attempt + 3, F.lit(""))).when(kind == "surname:cyrillic", name("cyrillic", attempt + 3, cyrillic_end))
    for kind_name in GIVEN:
        out = out.when(kind == f"given:{kind_name}", given(kind_name))
    return out.otherwise(_shaped(canon, h, longer))


def kind_of(found: Column) -> Column:
    """Type of a match: the first pattern that covers it whole."""
    return reduce(lambda a, k: a.when(found.rlike(f"^(?:{PATTERNS[k]})$"), k), list(PATTERNS)[1:], F.when(found.rlike(f"^(?:{PATTERNS['email']})$"), "email")).otherwise("secret")


def components(found: Column, kind: Column) -> Column:
    """Array of (kind, canon) that the match consists of."""
    part = lambda k, c: F.struct((k if isinstance(k, Column) else F.lit(k)).alias("kind"), c.alias("canon"))
    lower = F.lower(found)
    digits = F.regexp_replace(found, "[^0-9]", "")
    names = F.slice(F.split(found, " "), 2, 2)
    title = F.regexp_replace(F.get(F.split(found, " "), F.lit(0)), r"\.", "")
    gender = F.when(title.isin(TITLES_M), "m").when(title.isin(TITLES_F), "f").otherwise("n")
    script = F.when(found.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when((script == "cyrillic") & (gender == "n"), "m").otherwise(gender)
    surname = part(F.concat(F.lit("surname:"), script), F.lower(F.element_at(names, -1)))
    person = F.when(F.size(names) == 1, F.array(surname)).otherwise(F.array(part(F.concat_ws(":", F.lit("given"), gender, script), F.lower(F.get(names, F.lit(0)))), surname))
    return (
        F.when(kind == "email", F.array(part("local", F.regexp_extract(lower, "^([^@]*)@", 1)), part("domain", F.regexp_extract(lower, r"@(.*)\.[^.]*$", 1))))
        .when(kind == "person", person)
        .when(kind == "phone", F.array(part(kind, F.concat(F.when(found.startswith("+"), "+").otherwise(""), digits))))
        .when(kind.isin("card", "ssn"), F.array(part(kind, digits)))
        .when(kind == "iban", F.array(part(kind, F.regexp_replace(found, " ", ""))))
        .when(kind == "ip", F.array(part(kind, found)))
        .otherwise(F.array(part(kind, F.when(found.rlike("^[0-9A-Fa-f]+$"), lower).otherwise(found))))
    )


def rendered(found: Column, kind: Column, parts: Column) -> Column:
    """The surrogates ``parts`` in the layout of the match."""
    p = lambda i: F.get(parts, F.lit(i))
    upper = (F.upper(found) == found) & found.rlike("[A-Za-z]")
    cased = lambda c: F.when(upper, F.upper(c)).otherwise(c)
    plain = F.regexp_replace(p(0), "[^0-9A-Za-z]", "")
    # Digits and letters go where the match has some; punctuation stays.
    before = lambda i: F.length(F.regexp_replace(F.substr(found, F.lit(1), i), "[^0-9A-Za-z]", ""))
    laid = F.array_join(F.transform(_chars(found), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(plain, before(i) + 1, F.lit(1))).otherwise(c)), "")
    names = F.concat_ws(" ", F.get(F.split(found, " "), F.lit(0)), F.array_join(parts, " "))
    return (
        F.when(kind == "email", F.concat(cased(p(0)), F.lit("@"), cased(p(1)), F.regexp_extract(found, r"(\.[^.]*)$", 1)))
        .when(kind == "person", cased(names)).when(kind.isin("phone", "card", "ssn", "iban"), laid).when(kind == "ip", p(0))
        .otherwise(F.when(found.rlike("^[0-9A-Fa-f]+$"), cased(p(0))).otherwise(p(0)))
    )


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct components in ``found`` (kind, canon), free of collisions."""
    own = written(found.distinct(), "components")
    table = written(own.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
    for _ in range(MOST_ATTEMPTS):
        real = own.select("kind", F.lower("canon").alias("surrogate_key")).distinct().withColumn("real", F.lit(True))
        table = table.withColumn("surrogate_key", F.lower("surrogate"))
        shared = table.groupBy("kind", "surrogate_key").agg(F.min("canon").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        clash = F.coalesce(F.col("real"), F.lit(False)) | (F.col("keeps").isNotNull() & (F.col("keeps") != F.col("canon")))
        state = table.join(shared, ["kind", "surrogate_key"], "left").join(real, ["kind", "surrogate_key"], "left").select("kind", "canon", "attempt", "surrogate", clash.alias("clash"))
        state = written(state, "clashes")
        if state.where("clash").isEmpty():
            return state.select("kind", "canon", "surrogate")
        nxt = F.col("attempt") + F.col("clash").cast("int")
        again = F.when(F.col("clash"), surrogate(F.col("kind"), F.col("canon"), nxt, key)).otherwise(F.col("surrogate"))
        table = written(state.select("kind", "canon", nxt.alias("attempt"), again.alias("surrogate")), "surrogates")
    raise ValueError(f"no free surrogates after {MOST_ATTEMPTS} attempts")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, all other columns as they are, and ``n_entities`` (long).

    Null texts stay null with 0 entities.  Repeated rows get equal results.
    Texts are worked on whole.  Columns called ``n_entities`` or beginning
    with ``_pii_`` are overwritten.  An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c != "n_entities" and not c.startswith("_pii_")]
    text = F.col(f"`{text_col}`")
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    # Equal texts share one row of findings; only what is found travels.
    found = docs.select(F.sha2(text, 256).alias("_pii_of"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("_pii_m")).where(F.size("_pii_m") > 0)
    found = written(found.groupBy("_pii_of").agg(F.first("_pii_m").alias("m")), "found")
    single = found.select("_pii_of", F.posexplode("m").alias("at", "match")).withColumn("kind", kind_of(F.col("match")))
    parts = single.select("_pii_of", "at", "match", "kind", F.posexplode(components(F.col("match"), F.col("kind"))).alias("slot", "c"))
    parts = written(parts.select("_pii_of", "at", "match", F.col("kind").alias("type"), "slot", "c.kind", "c.canon"), "parts")
    names = dictionary(parts.select("kind", "canon"), key)
    known = parts.join(names, ["kind", "canon"]).groupBy("_pii_of", "at", "match", "type").agg(F.array_sort(F.collect_list(F.struct("slot", "surrogate"))).alias("s"))
    new = known.select("_pii_of", "at", rendered(F.col("match"), F.col("type"), F.transform("s", lambda x: x["surrogate"])).alias("new"))
    new = written(new.groupBy("_pii_of").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new")), "replacements")
    joined = docs.withColumn("_pii_of", F.sha2(text, 256)).join(new, "_pii_of", "left")
    pieces = F.zip_with(F.split(text, ANY), F.transform("new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    whole = F.when(F.col("new").isNull(), text).otherwise(F.array_join(pieces, ""))
    return joined.select(*[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities"))
