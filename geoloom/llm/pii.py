"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns. Each distinct entity gets a surrogate that is
derived from a secret key and keeps its type and format: digits stay digits,
letters stay letters of their script and case, an address stays an address, card
and bank numbers that add up still do. A person is replaced name by name: family
names and given names have surrogates of their own, in their script and, for given
names, of the gender that the corpus's titles tell. So "Mr Smith", "Dr Smith" and "Mr
John Smith" stay one family. One entity has one surrogate wherever it stands and
in whatever format (coreference), and no two entities share one, nor does a
surrogate equal an entity of the corpus (distinctness): what collides is derived
anew with the next counter, from which names grow longer, until nothing does.

Texts are read twice: once to find the rows with entities, which are written, and
once to pass the others through. Only rows with entities are shuffled. An entity
that stands in a third of all rows is one row of the dictionary, and the joins,
which are never broadcasts, are left to adaptive execution to split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.corpus import table, unused
from geoloom.sources.shared import materialise

# fixed values: what is looked for, in the order of preference at one place; nothing starts behind a letter or digit
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b\d{4}(?:[ -]\d{4}){3}\b|\b\d{13,19}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\b\d{3})[ .-]?\d{3}[ .-]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\b\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
MALE, FEMALE, TITLE = r"^(Mr|Herr|Monsieur|Señor)\b", r"^(Mrs|Ms|Frau|Madame|Señora)\b", r"^\p{L}+\.? "
#: Given names by script and gender, and syllables of made-up names by script.
GIVEN = {
    "latin": {
        "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Niels Oscar Paul Robin Simon Thomas Victor".split(),
        "f": "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rita Sara Tina Vera".split(),
        "n": "Alex Bente Chris Dana Eden Frances Gale Haven Indie Jules Kim Lee Morgan Noel Oakley Pat Quinn Robin Sam Toni".split(),
    },
    "greek": {
        "m": "Βασίλης Γιώργος Δημήτρης Θωμάς Ιάσων Κώστας Λάμπρος Μάρκος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φίλιππος Χρήστος".split(),
        "f": "Αθηνά Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Σοφία Φανή Χριστίνα".split(),
        "n": "Αλεξ Δανι Κιμι Μελι Νοελ Ρενι Σαμι Τονι Φανι Χαρι".split(),
    },
    "cyrillic": {
        "m": "Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Олег Павел Роман Семён Тимур Юрий Яков".split(),
        "f": "Алла Вера Галина Дарья Жанна Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Тамара Ульяна Юлия".split(),
        "n": "Валя Женя Люся Миша Паша Саша Сима Слава Тоша Шура".split(),
    },
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no".split(),
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο".split(),
    "cyrillic": "ба бе би бо ва ве ви во да де ди до за зе зи зо ка ке ки ко ла ле ли ло ма ме ми мо на не ни но".split(),
}
#: Letters that stand for each other, by script and case.
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "àâäçéèêëíîïñóôöùûüúÿ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

#: Every entity holds one of these; looking for them first is cheap.
MARKS = (*"0123456789@", "Mr", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor")


def holds_entity(text: Column) -> Column:
    """Whether a text holds an entity; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(m) for m in MARKS]) & text.rlike(ANY), F.lit(False))


def entity_type(entity: Column) -> Column:
    out = F
    for name, pattern in PATTERNS.items():
        out = out.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def names_of(entity: Column, kind: Column) -> Column:
    """What mentions of one entity share, as an array of (kind, name, gender, word).

    That is digits, letters without spaces and case, or the lowered given and
    family names without the title; ``word`` is the name as it stands.
    """
    plain = (
        F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .otherwise(F.lower(entity))
    )
    words = F.split(F.regexp_replace(entity, TITLE, ""), " ")
    gender = F.when(entity.rlike(MALE), "m").when(entity.rlike(FEMALE), "f").otherwise("n")
    one = lambda k, n, g, w: F.struct(k.alias("kind"), n.alias("name"), g.alias("gender"), w.alias("word"))
    person = F.transform(words, lambda w, i: one(F.when(i == F.size(words) - 1, "family").otherwise("given"), F.lower(w), gender, w))
    return F.when(kind == "person", person).otherwise(F.array(one(kind, plain, F.lit("n"), entity)))


def _stream(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """128 hex digits from key, type, entity and counter."""
    source = F.concat_ws("\u0001", F.lit(key), kind, name, attempt.cast("string"))
    return F.concat(F.sha2(source, 256), F.sha2(F.concat(source, F.lit("\u0002")), 256))


def _number(stream: Column, place: Column, below: int) -> Column:
    """The number below ``below`` that four hex digits of the stream give for a place; the stream is read in a circle."""
    at = (place * 3) % 124
    return (F.conv(F.substr(stream, at + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _mapped(name: Column, stream: Column, keep: Column) -> Column:
    """Each digit and letter replaced by one of its kind; where ``keep`` (of the place) holds it stays."""

    def one(char: Column, i: Column) -> Column:
        out = F.when(keep(i), char).when(char.rlike("[0-9]"), _number(stream, i, 10).cast("string"))
        for script in SCRIPTS:
            upper = script.upper()
            out = out.when(F.instr(F.lit(script), char) > 0, F.substr(F.lit(script), _number(stream, i, len(script)) + 1, F.lit(1)))
            out = out.when(F.instr(F.lit(upper), char) > 0, F.substr(F.lit(upper), _number(stream, i, len(script)) + 1, F.lit(1)))
        return out.otherwise(char)

    return F.array_join(F.transform(F.split(name, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2) / 10).cast("int") + (c.cast("int") * (1 + i % 2)) % 10)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a bank number's digits, letters counting 10 to 35."""
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _by_script(name: Column, of) -> Column:
    """``of(script)`` for the script of the name's first letter; Latin where it is none of the others."""
    return F.when(name.rlike(r"^\p{IsGreek}"), of("greek")).when(name.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate_identity(kind: Column, name: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's identity."""
    stream = _stream(key, kind, name, attempt)
    never = lambda i: F.lit(False)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(stream, i, 254) + 1).cast("string")), ".")
    tail = F.length(F.regexp_extract(name, r"\.\p{L}{2,}$", 0))
    email = F.concat(_mapped(F.substr(name, F.lit(1), F.length(name) - tail), stream, never), F.regexp_extract(name, r"\.\p{L}{2,}$", 0))
    email = F.when(attempt < 8, email).otherwise(F.concat(attempt.cast("string"), email))  # few characters: a longer address after some collisions
    mapped = _mapped(name, stream, never)
    body = _mapped(name, stream, lambda i: i == 0)
    body = F.substr(body, F.lit(1), F.length(body) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.when(_luhn(name) == 0, F.concat(body, check.cast("string"))).otherwise(_mapped(name, stream, lambda i: i == 0))
    country, turned = F.substr(name, F.lit(1), F.lit(2)), lambda x: F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    account = _mapped(F.substr(name, F.lit(5)), stream, never)
    digits = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(_mod97(turned(name)) == 1, F.concat(country, digits, account)).otherwise(_mapped(name, stream, lambda i: i < 2))
    pick = lambda pool, i: F.element_at(F.split(F.lit(" ".join(pool)), " "), _number(stream, F.lit(i), len(pool)) + 1)

    def syllables(script: str, first: int, n: int) -> Column:
        return F.concat(*(pick(SYLLABLES[script], first + i) for i in range(n)))

    def given(script: str) -> Column:
        of = GIVEN[script]
        short = F.when(gender == "m", pick(of["m"], 0)).when(gender == "f", pick(of["f"], 0)).otherwise(pick(of["n"], 0))
        return F.concat(short, F.when(attempt < 1, "").when(attempt < 3, syllables(script, 1, 2)).otherwise(syllables(script, 1, 6)))

    def family(script: str) -> Column:
        return F.initcap(F.when(attempt < 2, syllables(script, 1, 4)).otherwise(syllables(script, 1, 8)))

    phone = _mapped(name, stream, lambda i: i < F.length(name) - 10)  # the country code stays
    return (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "given", _by_script(name, given))
        .when(kind == "family", _by_script(name, family)).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(mapped)
    )


def in_format(entity: Column, kind: Column, parts: Column) -> Column:
    """Surrogates in the format of a mention: its separators, its title, its case. ``parts`` has (word, surrogate) in order."""
    surrogate = parts[0]["surrogate"]
    place = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    spread = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substr(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    names = F.array_join(F.transform(parts, lambda p: F.when(p["word"] == F.upper(p["word"]), F.upper(p["surrogate"])).otherwise(p["surrogate"])), " ")
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), spread)
        .when(kind == "person", F.concat(F.regexp_extract(entity, TITLE, 0), names))
        .when((kind == "email") & (entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def dictionary(entities: DataFrame, key: str, most: int = 64) -> DataFrame:
    """``kind, name, surrogate`` for the distinct (kind, name) of ``entities``, whose ``gender`` (m, f, n) may be there.

    A name with mentions of both genders, or of none, is neutral. Collisions are
    counted and derived anew; ``most`` rounds that still leave one raise an error,
    which needs nearly as many entities as their format has values.
    """
    has = lambda g: F.max(F.col("gender") == g)
    known = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n"))
    gender = F.when(has("m") & ~has("f"), "m").when(has("f") & ~has("m"), "f").otherwise("n")
    names = materialise(known.groupBy("kind", "name").agg(gender.alias("gender"), F.lit(0).alias("attempt")), "entities")
    for _ in range(most):
        given = names.withColumn("surrogate", surrogate_identity(F.col("kind"), F.col("name"), F.col("gender"), F.col("attempt"), key))
        order = Window.partitionBy("kind", F.lower("surrogate")).orderBy("attempt", F.sha2("name", 256), "name")
        taken = names.select("kind", F.lower("name").alias("low"), F.lit(True).alias("real")).distinct()
        given = materialise(
            given.withColumn("again", F.row_number().over(order) > 1).withColumn("low", F.lower("surrogate")).join(taken.hint("merge"), ["kind", "low"], "left")
            .withColumn("again", F.col("again") | F.col("real").isNotNull()).drop("real", "low"), "surrogates",
        )
        if not given.where("again").limit(1).count():
            return given.select("kind", "name", "surrogate")
        names = given.select("kind", "name", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise ValueError("surrogates of some format are used up")


def session_key(spark) -> str:
    """The key of the session's setting ``geoloom.pii.key``; where it is unset, a public one that hides nothing from who knows this source."""
    return spark.conf.get("geoloom.pii.key", "geoloom")


def with_surrogates(docs: DataFrame, key: str = "geoloom", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every entity in ``text`` replaced, and ``n_entities`` added.

    Null texts stay null, and texts without an entity (empty ones too) stay as they
    are, with 0 entities. Long texts are read whole. Rows that repeat get the same
    result. Other columns stay whatever their names, but an own ``n_entities``, in any
    case, is replaced. An empty table gives no rows. The key should be a secret of the caller's.
    """
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    docs = docs.select(*columns)
    found, same = unused(docs, "_found", "_key")
    plain = docs.where(~holds_entity(F.col(text))).select(*columns, F.lit(0).alias("n_entities"))
    hit = docs.where(holds_entity(F.col(text))).withColumn(found, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    hit = materialise(hit.withColumn(same, F.sha2(F.col(text), 256)), "with_entities")
    sent = hit.groupBy(F.col(same).alias("doc")).agg(F.first(found).alias("found"))
    each = materialise(sent.select("doc", F.explode(F.array_distinct("found")).alias("entity")), "mentions")
    entities = each.select("entity").distinct().withColumn("type", entity_type(F.col("entity")))
    parts = materialise(entities.select("entity", "type", F.posexplode(names_of(F.col("entity"), F.col("type"))).alias("at", "part")).select("entity", "type", "at", "part.*"), "names")
    known = parts.join(dictionary(parts, key).hint("merge"), ["kind", "name"]).groupBy("entity", "type").agg(F.sort_array(F.collect_list(F.struct("at", "word", "surrogate"))).alias("parts"))
    puts = known.select("entity", in_format(F.col("entity"), F.col("type"), F.col("parts")).alias("put"))
    maps = each.join(puts.hint("merge"), "entity").groupBy(F.col("doc").alias(same)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "put"))).alias("put"))
    (mapped,) = unused(hit, "_put")
    both = hit.join(maps.withColumnRenamed("put", mapped).hint("merge"), same)
    pieces = F.split(F.col(text), ANY, -1)
    put = F.concat(F.transform(F.col(found), lambda e: F.element_at(F.col(mapped), e)), F.array(F.lit("")))
    new = F.array_join(F.flatten(F.zip_with(pieces, put, lambda p, s: F.array(p, s))), "")
    done = both.select(*(new.alias(c) if c.lower() == text.lower() else F.col(c) for c in columns), F.size(found).alias("n_entities"))
    return plain.unionByName(done)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "n_entities", "text")
