"""Surrogates for personal data, in DataFrame functions only.

Entities (email, phone, card, ssn, ip, ipv6, iban, secret, person after a title) are found by one pattern; an IBAN counts
if its check digits are right. An entity's norm is what it refers to: an email or IPv6 address in lower case, a phone's
digits (a leading 1 of eleven left out), a card's and an IBAN's characters without spacing, a hexadecimal secret in lower
case (its keyword may be in any case). A person has a norm for each part of the name: gender, script and first name;
script and last name. A title without gender takes the gender that other titles give the first name in the corpus, if
they agree, else none. In a text that names a person after a title, every capitalised word equal to a part of such a name
is that person too: "John Smith", "Smith" and "Mr. Smith" follow "Mr. John Smith". A word that is a first and a last name
in one text counts as the first name.

Each norm gets one core, drawn by an HMAC-SHA512 under the key: same kind and length, digits for digits, letters of the
same case and script for letters, a card with its first digit and a right check digit, an IBAN with its country and right
check digits, a number of more than ten digits with its first two, a first name of the same gender and script. Equal norms
have equal cores in all documents (coreference); a core that equals another's, or any norm of the corpus, is drawn again
until all differ (distinctness). A surface is its norm's core in the surface's own format. The key is the session's
spark.lucerna.pii.key; without one a public default is used, which hides nothing from a reader of this file.

Only documents with entities are shuffled, by a hash of the text, so copies are looked up once. Null and empty texts and
texts without entities come back as they are. A null doc_id is kept. Repeated rows give repeated results, an empty table
none; other columns pass through, whatever their names. Texts are processed whole, however long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

# Titles by gender, first and last names by gender and script, alphabets by script.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Г-н"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Г-жа"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
CAPITAL_TITLES = ["MR", "MRS", "MS", "DR", "PROF"]  # with a point only
NAMES = {
    ("m", "latin"): ["Adam", "Albert", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "George", "Hugo", "Ivan", "Jonas", "Kevin", "Leon", "Martin", "Oscar", "Paul"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Grace", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("n", "latin"): ["Alex", "Ariel", "Jamie", "Kim", "Morgan", "Robin", "Sasha", "Toni"],
    ("n", "cyrillic"): ["Женя", "Саша", "Валя", "Шура"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Илья", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": ["ba", "be", "da", "do", "fa", "ga", "ka", "la", "le", "ma", "mi", "na", "ra", "ro", "sa", "ta"],
    "cyrillic": ["ба", "ве", "га", "до", "жа", "за", "ка", "ла", "ле", "ма", "ми", "на", "ра", "ро", "са", "та"],
}
ALPHABETS = [
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9]", "0123456789"),
    ("[\\p{IsGreek}&&\\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[\\p{IsGreek}&&\\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("[\\p{IsCyrillic}&&\\p{Ll}]", "абвгдежзийклмнопрстуфхцчшщыэюя"),
    ("[\\p{IsCyrillic}&&\\p{Lu}]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"),
    ("\\p{Ll}", "abcdefghijklmnopqrstuvwxyz"),
    ("\\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
]
KINDS = {
    "secret": r"\b(?i:password|passwd|pwd|token|secret|api_key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6,}|\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![\w.%+-])[\w.%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\d)[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,5}\)?){2,4}(?!\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": r"(?<!\p{L})(?:(?:" + "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]) + r")\.?|(?:" + "|".join(CAPITAL_TITLES) + r")\.) \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: In texts with a person, capitalised words too: they may be a part of the name.
NAMED_PATTERN = PATTERN + r"|(?<![\p{L}\p{N}_])\p{Lu}\p{L}+"
SECRET_HEAD = r"^((?i:password|passwd|pwd|token|secret|api_key)\s{0,2}[=:]\s{0,2}[\"']?|AKIA)"
PERSON_HEAD = "^((?:" + "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *CAPITAL_TITLES]) + r")\.? )"
DIGITS = ["phone", "card", "ssn"]
NAME_PARTS = ["first", "last"]
KEY = "set a key of your own"


def found(text: Column, pattern: str = PATTERN) -> Column:
    """The entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def possible(text: Column) -> Column:
    """False only for texts without entities, and quick to tell: every pattern has a digit, a sign or a fixed word."""
    out = F.regexp_like(text, F.lit("[0-9@=:]")) | text.contains("AKIA")
    for title in [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *CAPITAL_TITLES]:
        out = out | text.contains(title)
    return F.coalesce(out, F.lit(False))


def has_entities(text: Column) -> Column:
    return F.when(possible(text), F.regexp_like(text, F.lit(PATTERN))).otherwise(F.lit(False))


def remainder(text: Column) -> Column:
    """Digits and letters (A is 10) read as one number, modulo 97."""
    chars = F.regexp_extract_all(text, F.lit("."), F.lit(0))
    worth = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + worth(c)) % 97)


def kind_of(surface: Column) -> Column:
    """Null for a word that is no entity by itself, and for what only looks like an IBAN."""
    out = F.lit(None).cast("string")
    plain = F.regexp_replace(surface, " ", "")
    right = remainder(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
    for kind, pattern in reversed(list(KINDS.items())):
        fits = F.regexp_like(surface, F.lit(f"^(?:{pattern})$"))
        out = F.when(fits & right if kind == "iban" else fits, F.lit(kind)).otherwise(out)
    return out


def described(surfaces: DataFrame) -> DataFrame:
    """surface -> kind, head (kept), norm; a person's norm is null, first and last are the parts of the name."""
    s = surfaces.withColumn("kind", kind_of(F.col("surface")))
    is_person = F.col("kind") == "person"
    head = F.when(F.col("kind") == "secret", F.regexp_extract("surface", SECRET_HEAD, 1)).when(is_person, F.regexp_extract("surface", PERSON_HEAD, 1)).otherwise(F.lit(""))
    s = s.withColumn("head", head).withColumn("rest", F.expr("substring(surface, length(head) + 1)"))
    digits = F.regexp_replace("surface", "[^0-9]", "")
    phone = F.when(digits.startswith("1") & (F.length(digits) == 11), F.substr(digits, F.lit(2))).otherwise(digits)
    one_case = (F.col("kind") == "secret") & F.regexp_like("rest", F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    norm = F.when(is_person, F.lit(None).cast("string")).when(F.col("kind").isin("email", "ipv6"), F.lower("surface")).when(F.col("kind") == "phone", phone)
    norm = norm.when(F.col("kind").isin("card", "ssn"), digits).when(F.col("kind") == "iban", F.regexp_replace("surface", " ", "")).when(one_case, F.lower("rest")).otherwise(F.col("rest"))
    title = F.upper(F.regexp_replace("head", r"[. ]", ""))
    gender = F.when(title.isin([t.upper() for t in MALE_TITLES]), "m").when(title.isin([t.upper() for t in FEMALE_TITLES]), "f")
    name = F.when(is_person, F.split("rest", " "))
    script = F.when(F.regexp_like("rest", F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    first = F.when(F.size(name) > 1, F.lower(F.get(name, F.lit(0))))
    s = s.withColumn("norm", norm).withColumn("gender", F.when(is_person, gender)).withColumn("script", script).withColumn("given", first)
    # a title without gender: the one that other titles give this first name
    seen = s.where("gender is not null and given is not null").groupBy("script", "given").agg(F.min("gender").alias("least"), F.max("gender").alias("most"))
    s = s.join(seen, ["script", "given"], "left").withColumn("gender", F.coalesce("gender", F.when(F.col("least") == F.col("most"), F.col("least")), F.lit("n")))
    last = F.when(is_person, F.concat_ws(":", "script", F.lower(F.get(name, F.size(name) - 1))))
    return s.select("surface", "kind", "head", "norm", F.when(F.col("given").isNotNull(), F.concat_ws(":", "gender", "script", "given")).alias("first"), last.alias("last"))


def picked(byte: Column, options: str | list[str]) -> Column:
    at = byte % len(options)
    return F.substr(F.lit(options), at + 1, F.lit(1)) if isinstance(options, str) else F.get(F.array(*map(F.lit, options)), at)


def drawn(key: str) -> Column:
    """The core for a row's kind, norm and attempt, and the norm redrawn in its own shape."""
    block = hashlib.sha512(key.encode()).digest() if len(key.encode()) > 128 else key.encode()
    inner, outer = (F.lit(bytes(b ^ pad for b in block.ljust(128, b"\0"))) for pad in (0x36, 0x5C))

    def digest(part: Column) -> Column:
        said = F.encode(F.concat_ws("\x1f", "kind", "norm", F.col("attempt").cast("string"), part), "utf-8")
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 512))), 512)

    byte = lambda hashed, i: F.conv(F.substr(hashed, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
    stream = digest(F.lit("0"))
    # After some attempts the space of this length may be full: the core grows by characters of its last kind.
    longer = F.concat("norm", F.repeat(F.substring("norm", -1, 1), F.greatest(F.lit(0), F.col("attempt") - 8)))
    is_hex = F.regexp_like("norm", F.lit("^[0-9a-f]+$"))

    def shaped(c: Column, i: Column) -> Column:
        b = byte(stream, i)
        out = c
        for pattern, letters in reversed(ALPHABETS):
            out = F.when(F.regexp_like(c, F.lit(f"^{pattern}$")), picked(b, letters)).otherwise(out)
        hexadecimal = ((F.col("kind") == "secret") & is_hex) | ((F.col("kind") == "ipv6") & c.rlike("[0-9a-f]"))
        out = F.when(hexadecimal, picked(b, "0123456789abcdef")).otherwise(out)
        out = F.when((F.col("kind") == "phone") & (F.length("norm") > 10) & (i < 2), c).otherwise(out)
        return F.when((F.col("kind") == "email") & (i > F.length("norm") - F.length(F.substring_index("norm", ".", -1)) - 2), c).otherwise(out)

    same_shape = F.array_join(F.transform(F.regexp_extract_all(longer, F.lit("(?s)."), F.lit(0)), shaped), "")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(stream, i) % 254 + 1).cast("string")), ".")
    body = F.concat(F.substring("norm", 1, 1), F.expr("substring(same, 2, length(same) - 2)"))

    def luhn(text: Column) -> Column:
        worth = lambda c, i: F.when((F.length(text) - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
        total = F.aggregate(F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), worth), F.lit(0), lambda acc, x: acc + x)
        return F.concat(text, ((10 - total % 10) % 10).cast("string"))

    def iban(text: Column) -> Column:
        bank, land = F.substr(text, F.lit(5)), F.substring("norm", 1, 2)
        return F.concat(land, F.lpad((98 - remainder(F.concat(bank, land, F.lit("00")))).cast("string"), 2, "0"), bank)

    script = F.when(F.col("norm").contains("cyrillic:"), "cyrillic").otherwise("latin")
    first = F.lit(None).cast("string")
    # two first names joined, and more, once single ones have been tried
    turns = F.sequence(F.lit(0), (F.col("attempt") / 2).cast("int"))
    for (gender, letters), options in NAMES.items():
        names = F.array_join(F.transform(turns, lambda i: picked(byte(stream, i + 32), options)), "-")  # noqa: B023
        first = F.when(F.col("norm").startswith(f"{gender}:{letters}:"), names).otherwise(first)
    syllable = lambda i: F.when(script == "cyrillic", picked(byte(stream, i), SYLLABLES["cyrillic"])).otherwise(picked(byte(stream, i), SYLLABLES["latin"]))
    last = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), 3 + F.col("attempt")), syllable), ""))
    kind = F.col("kind")
    core = F.when(kind == "first", first).when(kind == "last", last).when(kind == "ip", octets).when(kind == "card", luhn(body)).when(kind == "iban", iban(F.col("same")))
    return core.otherwise(F.col("same")), same_shape


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, norm) -> core; draws again until no core is shared or equals a norm."""
    core, same = drawn(key)
    e = checkpointed(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)))
    # what a core must not be: a part of a name is compared without gender and script
    plain = F.when(F.col("kind").isin(*NAME_PARTS), F.substring_index("norm", ":", -1)).otherwise(F.lower("norm"))
    taken = checkpointed(e.select("kind", plain.alias("low")).distinct())
    while True:
        c = e.withColumn("same", same).withColumn("core", core).drop("same").withColumn("low", F.lower("core"))
        first = F.row_number().over(Window.partitionBy("kind", "low").orderBy("attempt", "norm")) == 1
        c = c.withColumn("free", first).join(taken.withColumn("real", F.lit(True)), ["kind", "low"], "left")
        c = checkpointed(c.select("kind", "norm", "attempt", "core", (F.col("free") & F.col("real").isNull()).alias("good")))
        if not c.where("not good").limit(1).count():
            return c.select("kind", "norm", "core")
        e = c.select("kind", "norm", (F.col("attempt") + F.when(F.col("good"), 0).otherwise(1)).alias("attempt"))


def rendered() -> Column:
    """A surface's surrogate: digits go into its own punctuation from the right, letters take its case."""
    chars = F.regexp_extract_all("surface", F.lit("(?s)."), F.lit(0))
    n_digits = lambda text: F.length(F.regexp_replace(text, "[^0-9]", ""))
    # the i-th character, if a digit, is digit number (digits up to here) of the surface
    placed = F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.struct(c.alias("c"), n_digits(F.substr("surface", F.lit(1), i + 1)).alias("d"))).otherwise(F.struct(c.alias("c"), F.lit(0).alias("d"))))
    skip = F.greatest(F.lit(0), n_digits(F.col("surface")) - F.length("core"))
    filled = F.array_join(F.transform(placed, lambda x: F.when(x["d"] > skip, F.substr("core", x["d"] - skip, F.lit(1))).otherwise(x["c"])), "")
    rest = F.expr("substring(core, greatest(0, length(regexp_replace(surface, '[^0-9]', ''))) + 1)")
    upper = (F.upper("surface") == F.col("surface")) & (F.lower("surface") != F.col("surface"))
    value = F.expr("substring(surface, length(head) + 1)")
    hex_upper = (F.col("kind") == "secret") & F.regexp_like(value, F.lit("^[0-9A-F]+$")) & (upper | (F.lower(value) != value))
    letters = F.when((F.col("kind").isin("email", "ipv6") & upper) | hex_upper, F.upper("core")).otherwise(F.col("core"))
    # an IBAN's spaces stay where they are
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr("core", i + 1 - F.length(F.regexp_replace(F.substr("surface", F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    return F.when(F.col("kind").isin(*DIGITS), F.concat(filled, rest)).when(F.col("kind") == "iban", spaced).otherwise(F.concat("head", letters))


def in_case(core: Column, like: Column) -> Column:
    """A name's core, in capitals if the surface's part is."""
    return F.when(F.upper(like) == like, F.upper(core)).otherwise(core)


def replacements(at: DataFrame, key: str) -> DataFrame:
    """(__key, at, surface) -> __key, at, put, kind; kind is null, and put the surface, where nothing is replaced."""
    surfaces = checkpointed(described(at.select("surface").distinct()))
    parts = [surfaces.where(f"{p} is not null").select(F.lit(p).alias("kind"), F.col(p).alias("norm")) for p in NAME_PARTS]
    plain = surfaces.where("norm is not null and kind is not null")
    cores = checkpointed(surrogates(plain.select("kind", "norm").union(parts[0]).union(parts[1]), key))
    mapped = plain.join(cores, ["kind", "norm"]).select("surface", "kind", rendered().alias("put"))
    given, family = (cores.where(F.col("kind") == p).select(F.col("norm").alias(p), F.col("core").alias(f"{p}_core")) for p in NAME_PARTS)
    persons = surfaces.where("kind = 'person'").select("surface", "head", "first", "last").join(given, "first", "left").join(family, "last")
    name = F.split(F.expr("substring(surface, length(head) + 1)"), " ")
    first, last = in_case(F.col("first_core"), F.get(name, F.lit(0))), in_case(F.col("last_core"), F.get(name, F.size(name) - 1))
    mapped = checkpointed(mapped.union(persons.select("surface", F.lit("person"), F.concat("head", F.concat_ws(" ", first, last)))))
    # the parts of the names of each text, and its words that equal one of them
    named = at.join(persons, "surface").select("__key", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.substring_index(p, ":", -1).alias("word"), F.col(f"{p}_core").alias("core")) for p in NAME_PARTS))).alias("x"))
    known = named.where("x.core is not null").groupBy("__key", F.col("x.word").alias("word")).agg(F.min("x").alias("x"))
    out = at.join(mapped, "surface", "left").withColumn("word", F.when(F.col("kind").isNull(), F.lower("surface")))
    out = out.join(known, ["__key", "word"], "left").withColumn("core", F.col("x.core"))
    put = F.coalesce("put", in_case(F.col("core"), F.col("surface")), F.col("surface"))
    return out.select("__key", "at", put.alias("put"), F.coalesce("kind", F.when(F.col("core").isNotNull(), F.lit("person"))).alias("kind"))


def with_surrogates(docs: DataFrame, key: str | None = None, counted: bool = True) -> DataFrame:
    """The documents with text replaced; with n_entities, and of each kind, if counted."""
    own = docs.columns
    key = key or docs.sparkSession.conf.get("spark.lucerna.pii.key", KEY)
    titled = F.regexp_like("text", F.lit(KINDS["person"]))
    marked = docs.where(has_entities(F.col("text"))).withColumn("__key", F.md5("text"))
    texts = marked.select("__key", "text").withColumn("__found", F.when(titled, found(F.col("text"), NAMED_PATTERN)).otherwise(found(F.col("text"))))
    at = checkpointed(texts.select("__key", "__found").dropDuplicates(["__key"]).select("__key", F.posexplode("__found").alias("at", "surface")))
    new = replacements(at, key).groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "put", "kind"))).alias("__put"))
    done = marked.join(new, "__key")
    between = F.when(titled, F.split("text", NAMED_PATTERN, -1)).otherwise(F.split("text", PATTERN, -1))
    text = F.array_join(F.flatten(F.zip_with(between, F.col("__put"), lambda a, b: F.array(a, F.coalesce(b["put"], F.lit(""))))), "")
    clean = docs.where(~has_entities(F.col("text")))
    of_kind = lambda k: F.size(F.filter("__put", lambda x: x["kind"] == k))
    counts = [F.coalesce(of_kind(k), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    zero = [F.lit(0).alias(f"n_{k}") for k in KINDS]
    out = [F.expr("__text").alias(c) if c == "text" else F.col(c) for c in own]
    replaced = F.size(F.filter("__put", lambda x: x["kind"].isNotNull())).alias("n_entities")
    done = done.withColumn("__text", text).select(*out, *([replaced, *counts] if counted else []))
    return done.union(clean.select(*own, *([F.lit(0).alias("n_entities"), *zero] if counted else [])))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = with_surrogates(docs, counted=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
