"""Surrogates for personal data, on DataFrame functions alone.

Detected entities get replacements of their own type that depend on a key and the entities of the
table, so one entity has one surrogate in all texts. Phone, card, address and social-security numbers
go through keyed Feistel rounds over their digits, which permute the numbers of one format. Names,
mail addresses and secrets are drawn by keyed hashes. Surrogates that meet, or that are an entity of
the table themselves, are found by a count and a join and drawn again with the next attempt's
number. Surnames are settled first, by the same rounds, and people are put together from them, so that
a surname stands for one surname with or without a given name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize

# Detection patterns (Java regular expressions), by type.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{32,48})(?![0-9A-Za-z])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])(?:\d{16}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})(?![\w\-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "person": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|господин|Госпожа|госпожа)\.?[ ]\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}\p{Ll}+){0,2}",
}
#: Every entity holds a match of this; it spares most texts the patterns with look-behind.
ANY_HINT = r"[0-9@]|AKIA|gh[pousr]_|sk-|[a-f]{32}|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|[Гг]оспожа|[Гг]осподин)[. ]"
# Titles of men; other titles are of women.
MEN = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин"]
# Given names and name parts of the surrogates, by script and gender.
GIVEN = {
    ("latin", "man"): ["Adrian", "Bruno", "Conrad", "Dario", "Edgar", "Fabian", "Gregor", "Hugo", "Ivo", "Jonas", "Klaus", "Leon", "Marco", "Nils", "Oscar", "Pablo"],
    ("latin", "woman"): ["Alma", "Bianca", "Clara", "Diana", "Elena", "Fiona", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("cyrillic", "man"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур"],
    ("cyrillic", "woman"): ["Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
}
SYLLABLES = {
    "latin": ["bar", "ben", "dor", "fel", "gan", "hol", "kas", "lem", "mar", "nor", "pel", "ros", "sand", "tor", "vel", "win"],
    "cyrillic": ["бар", "бел", "вар", "гор", "дол", "жар", "зим", "кор", "лес", "мор", "нев", "пол", "рос", "сол", "тар", "яр"],
}
_COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _draw(key: str | Column, *parts: Column) -> Column:
    """64 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", key if isinstance(key, Column) else F.lit(key), *(p.cast("string") for p in parts)), 256)


def _number(hexadecimal: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(hexadecimal, 1, 12), 16, 10).cast("long"), F.lit(modulus))


def _feistel(key: Column, left: Column, right: Column, a: int, b: int) -> tuple[Column, Column]:
    """A keyed permutation of the pairs (left below a, right below b)."""
    for turn in range(2):
        left = F.pmod(left + _number(_draw(key, F.lit(f"{a}/{b}/{turn}/l"), right), a), F.lit(a))
        right = F.pmod(right + _number(_draw(key, F.lit(f"{a}/{b}/{turn}/r"), left), b), F.lit(b))
    return left, right


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _tweak(key: str, attempt: Column) -> Column:
    """The key of an attempt: a permutation of its own."""
    return F.concat(F.lit(f"{key}/"), attempt.cast("string"))


def _phone(key: Column, entity: Column) -> Column:
    """Area and line numbers are permuted; country and exchange stay."""
    digits = F.regexp_replace(entity, r"\D", "")
    n = F.length(digits)
    part = lambda start, size: F.substring(digits, n - F.lit(start), F.lit(size)).cast("long")
    area, line = part(9, 3), part(3, 4)
    valid = _feistel(key, area - 200, line, 800, 10_000)  # areas of 200 and more stay so
    other = _feistel(key, area, line, 200, 10_000)
    new_area = F.when(area >= 200, _digits(valid[0] + 200, 3)).otherwise(_digits(other[0], 3))
    new_line = F.when(area >= 200, _digits(valid[1], 4)).otherwise(_digits(other[1], 4))
    return F.regexp_replace(entity, F.lit(r"\d{3}(\D*\d{3}\D*)\d{4}$"), F.concat(new_area, F.lit("$1"), new_line))


def _luhn(digits: Column, n: int) -> Column:
    terms = []
    for i in range(n):
        d = F.substring(digits, i + 1, 1).cast("int")
        if (n - i) % 2 == 0:
            d = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        terms.append(d)
    return F.pmod(reduce(lambda a, b: a + b, terms), F.lit(10))


def _card(key: Column, entity: Column) -> Column:
    """The first two digits (network) stay, the next 13 are permuted, and the last keeps the
    number's Luhn remainder: valid numbers stay valid, and no two numbers meet."""
    digits = F.regexp_replace(entity, r"\D", "")
    left, right = _feistel(key, F.substring(digits, 3, 6).cast("long"), F.substring(digits, 9, 7).cast("long"), 10**6, 10**7)
    body = F.concat(F.substring(digits, 1, 2), _digits(left, 6), _digits(right, 7))
    last = F.pmod(_luhn(digits, 16) - _luhn(F.concat(body, F.lit("0")), 16), F.lit(10))
    quarters = [F.substring(body, 1 + 4 * k, 4) for k in range(3)]
    return F.regexp_replace(entity, F.lit(r"^\d{4}(\D?)\d{4}(\D?)\d{4}(\D?)\d{4}$"), F.concat(
        quarters[0], F.lit("$1"), quarters[1], F.lit("$2"), quarters[2], F.lit("$3"), F.substring(body, 13, 3), last.cast("string")))


def _ip(key: Column, entity: Column) -> Column:
    octet = [F.get(F.split(entity, r"\."), i).cast("long") for i in range(4)]
    left, right = _feistel(key, octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536)
    return F.concat_ws(".", *(x.cast("string") for x in (F.floor(left / 256), left % 256, F.floor(right / 256), right % 256)))


def _ssn(key: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    left, right = _feistel(key, F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 6).cast("long"), 1000, 10**6)
    return F.concat_ws("-", _digits(left, 3), F.substring(_digits(right, 6), 1, 2), F.substring(_digits(right, 6), 3, 4))


def _letters(hexadecimal: Column) -> Column:
    return F.translate(hexadecimal, "0123456789abcdef", "bcdfghklmnprstvz")


def _pool(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """128 hexadecimal digits for the characters of mail addresses and secrets."""
    seed = _draw(key, kind, entity, attempt)
    return F.concat(seed, F.sha2(seed, 256))


def _email(key: str, entity: Column, attempt: Column, pool: Column) -> Column:
    """Runs of letters and of digits keep their lengths; the domain becomes one of a reserved name,
    the same for all addresses of the domain. A later attempt lengthens the local part."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    letters, numbers = _letters(pool), F.translate(pool, "abcdef", "246802")
    chars = F.zip_with(F.split(local, ""), F.sequence(F.lit(1), F.length(local)), lambda c, i: F.when(
        c.rlike("^[a-z]$"), F.substring(letters, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))).when(
        c.rlike("^[0-9]$"), F.substring(numbers, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))).otherwise(c))
    more = F.when(attempt > 0, F.concat(F.lit("."), F.substring(_letters(F.sha2(pool, 256)), F.lit(1), 4 * attempt))).otherwise("")
    return F.concat(F.array_join(chars, ""), more, F.lit("@"), F.substring(_letters(_draw(key, F.lit("domain"), domain)), 1, 12), F.lit(".example.net"))


def _secret(entity: Column, pool: Column) -> Column:
    """Prefix and length stay; characters of a class are drawn from that class."""
    keep = F.length(F.regexp_extract(entity, r"^(AKIA|gh[pousr]_|sk-)?", 1))
    body = F.substring(pool, F.lit(1), F.length(entity) - keep)
    return F.concat(F.substring(entity, F.lit(1), keep), F.when(entity.startswith("AKIA"), F.upper(body)).otherwise(body))


def _pick(names: list[str], seed: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), _number(seed, len(names)).cast("int"))


def _script(name: Column, of: dict[str, Column]) -> Column:
    """The value for the name's script: Cyrillic, else Latin."""
    return F.when(name.rlike(r"^\p{IsCyrillic}"), of["cyrillic"]).otherwise(of["latin"])


def surname_of(entity: Column) -> Column:
    return F.regexp_extract(entity, r"(\p{Lu}\p{Ll}+)$", 1)


def _syllables(seed: Column, script: str, n: int) -> Column:
    return F.concat(*(_pick(SYLLABLES[script], F.substring(seed, 1 + 12 * i, 12)) for i in range(n)))


def _surname(key: str, surname: Column, attempt: Column) -> Column:
    """A surname of four syllables in the same script."""
    seed = _draw(key, F.lit("surname"), surname, attempt)
    return F.initcap(_script(surname, {s: _syllables(seed, s, 4) for s in SYLLABLES}))


def _person(key: str, entity: Column, attempt: Column, surname: Column) -> Column:
    """Title as it is; a given name of the title's gender, if there is one, with a second part from the
    first further attempt on; and the surname's own surrogate ``surname``."""
    title = F.regexp_extract(entity, r"^(\p{L}+\.?)", 1)
    rest = F.regexp_extract(entity, r"^\p{L}+\.? (.*)$", 1)
    has_given = F.length(rest) > F.length(surname_of(entity))
    between = F.when(rest.contains(" "), F.lit(" ")).otherwise(F.lit("-"))
    man = F.regexp_replace(title, r"\.", "").isin(MEN)
    seed = _draw(key, F.lit("given"), rest, man, attempt)

    def given(script: str) -> Column:
        first = F.when(man, _pick(GIVEN[script, "man"], seed)).otherwise(_pick(GIVEN[script, "woman"], seed))
        second = F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(_syllables(F.substring(seed, 13, 48), script, 3)))).otherwise("")
        return F.concat(first, second, between)

    return F.concat(title, F.lit(" "), F.when(has_given, _script(surname, {s: given(s) for s in SYLLABLES})).otherwise(""), surname)


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


#: Kinds of numbers: their surrogates are compared by digits, whatever the format.
NUMBERS = ["phone", "ssn", "card", "ip"]


def surrogate(key: str, kind: Column, entity: Column, attempt: Column, pool: Column, surname: Column) -> Column:
    tweak = _tweak(key, attempt)
    return (F.when(kind == "email", _email(key, entity, attempt, pool)).when(kind == "secret", _secret(entity, pool))
            .when(kind == "phone", _phone(tweak, entity)).when(kind == "ssn", _ssn(tweak, entity)).when(kind == "card", _card(tweak, entity))
            .when(kind == "ip", _ip(tweak, entity)).when(kind == "surname", _surname(key, entity, attempt)).otherwise(_person(key, entity, attempt, surname)))


def _form(kind: Column, value: Column) -> Column:
    """What a surrogate may not share with an entity of its kind."""
    return F.when(kind.isin(NUMBERS) & (kind != "ip"), F.regexp_replace(value, r"\D", "")).otherwise(value)


def _settle(entities: DataFrame, key: str, max_attempts: int) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities (kind, entity, surname: the surrogate of a person's
    surname). Each round counts the entities of every surrogate; the first by hash keeps it, the
    others, and those that hit an entity or a surrogate of an earlier round, draw again."""
    known = entities.select("kind", _form(F.col("kind"), F.col("entity")).alias("form")).distinct().withColumn("taken", F.lit(True))
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    for _ in range(max_attempts):
        # The draws are made before a shuffle, which also spreads the few rows over all tasks:
        # expressions within lambdas would repeat them for each character.
        seeded = open_.withColumn("pool", _pool(key, F.col("kind"), F.col("entity"), F.col("attempt"))).repartition(parts, "kind", "entity")
        drawn = seeded.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt"), F.col("pool"), F.col("surname"))).drop("pool")
        drawn = drawn.withColumn("form", _form(F.col("kind"), F.col("surrogate"))).join(known, ["kind", "form"], "left")
        if settled is not None:
            drawn = drawn.join(settled.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy(F.xxhash64("entity"), "entity"))
        drawn = materialize(drawn.withColumn("rank_", rank).withColumn("fine", (F.col("rank_") == 1) & F.col("taken").isNull() & F.col("used").isNull()))
        good = drawn.where("fine").select("kind", "entity", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        again = drawn.where("not fine")
        if not again.limit(1).count():
            return settled
        open_ = again.select("kind", "entity", "surname", (F.col("attempt") + 1).alias("attempt"))
    raise ValueError(f"surrogates still meet after {max_attempts} attempts")


def surrogate_table(entities: DataFrame, key: str, max_attempts: int = 8) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities (kind, entity), a row each, no surrogate twice in a
    kind and none that is itself an entity of its kind in the table (numbers: in any format). Raises
    ValueError if some still meet after ``max_attempts`` draws, for example when a table holds nearly
    all numbers of a format. Equal numbers in two formats stay equal. An empty table gives no rows."""
    of_people = entities.where("kind = 'person'").withColumn("surname_", surname_of(F.col("entity")))
    names = of_people.select(F.lit("surname").alias("kind"), F.col("surname_").alias("entity"), F.lit(None).cast("string").alias("surname")).distinct()
    surnames = materialize(_settle(names, key, max_attempts).select(F.col("entity").alias("surname_"), F.col("surrogate").alias("surname")))
    # Few surnames may be hot; each has one row, so adaptive execution splits the other side.
    people = of_people.join(surnames, "surname_").select("kind", "entity", "surname")
    rest = entities.where("kind <> 'person'").select("kind", "entity", F.lit(None).cast("string").alias("surname"))
    return _settle(materialize(rest.unionByName(people)), key, max_attempts)


def replace_entities(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_entities, kinds, surrogates, text) of each row whose text holds an entity; kinds and
    surrogates in the order of the text, text with the surrogates in place.

    Rows without entities, null and empty texts are not returned; texts of any length are replaced
    whole. Names are found behind a title alone; scripts other than Cyrillic get Latin names. Mail
    addresses are one entity in any letter case. Repeated rows are returned once for each repeat; other
    columns do not matter. ValueError as in surrogate_table. Of the documents only those with entities
    are shuffled; entities are combined before their own shuffle, so that one found in a third of all
    documents is a few rows there.
    """
    source = docs.select(F.col(id_column).alias("pii_id_"), F.col(text_column).alias("pii_text_"), F.xxhash64(text_column).alias("pii_hash_"))
    found = materialize(source.where(F.col("pii_text_").rlike(ANY_HINT) & F.col("pii_text_").rlike(_COMBINED)).withColumn("mentions", F.regexp_extract_all("pii_text_", F.lit(_COMBINED), 0)))
    mentions = (found.select("pii_id_", "pii_hash_", F.posexplode("mentions").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
                .withColumn("entity", F.when(F.col("kind") == "email", F.lower("mention")).otherwise(F.col("mention"))))
    table = surrogate_table(materialize(mentions.select("kind", "entity").distinct()), key)
    # One entity may be hot among the mentions; its row in the table is one, so the join splits.
    done = mentions.join(table, ["kind", "entity"]).select("pii_id_", "pii_hash_", F.struct("pos", "kind", "surrogate").alias("m"))
    done = done.groupBy("pii_id_", "pii_hash_").agg(F.array_sort(F.collect_set("m")).alias("ms")).toDF("done_id_", "done_hash_", "ms")
    cut = F.split("pii_text_", _COMBINED, -1)
    ends = F.concat(F.col("ms.surrogate"), F.array(F.lit("")))
    return found.join(done, F.col("pii_id_").eqNullSafe(F.col("done_id_")) & (F.col("pii_hash_") == F.col("done_hash_"))).select(
        F.col("pii_id_").alias(id_column), F.size("ms").cast("long").alias("n_entities"), F.col("ms.kind").alias("kinds"), F.col("ms.surrogate").alias("surrogates"),
        F.array_join(F.zip_with(cut, ends, lambda a, b: F.concat(a, b)), "").alias(text_column))
