"""PII: detection and keyed surrogates, by DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, telephone numbers, card numbers (kept where the Luhn sum fails),
social security numbers, labelled secrets and person names: after a title, after a cue such as "my name is", or a
common given name with a capitalised surname. Names may have apostrophes, hyphens, inner capitals, a middle initial and
particles. Each entity has one or more units, kind and canonical value: the digits of a number, the lower-cased address
and its domain, a secret as it is (in lower case where it is hexadecimal), a person's given name (with the gender of the
title, else of the name) and surname. A unit's surrogate is a function of a key (HMAC-SHA-512), the kind, the canonical
value and a nonce, so every mention gets the same one, in the format of that mention: case, separators, country code,
script, gender, check digit.

Collision check: the distinct units of the corpus are tabled, and any unit whose surrogate is another unit's surrogate
or a value that the corpus holds gets the next nonce, until none is left; only units that collide are worked on again.
The few units with a nonce above 0 reach their texts by joins on a digest of the text; that table is broadcast where it
is small.

Cases: a null text stays null; a text without entities stays as it is; texts of any length are searched whole; repeated
rows give repeated rows; an empty table gives an empty table; the text column is replaced, and n_replaced and kinds
replace columns of the same names; a kind with more units than surrogates ends with an error after ``ROUNDS`` nonces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piperack.llm.shared import kept

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = r"Mr\.?|Sir|Herrn?|Monsieur|M\.|Señor|Sr\.|Don|господин"
_FEMALE = r"Mrs\.?|Ms\.?|Miss|Lady|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra\.|Doña|госпожа"
_OTHER = r"Mx\.?|Dr\.?|Dra\.|Prof\.?|Professor|Doctor|Доктор|доктор|профессор"
_CUE = r"[Mm]y name is|[Nn]ame:|[Ss]igned(?: by)?:?|[Rr]egards,|[Ss]incerely,|[Mm]ein Name ist|[Mm]e llamo|[Jj]e m'appelle|[Мм]еня зовут"
#: Rows of the table of moved units up to which it is broadcast, nonces tried, and the key where the session has none.
SMALL, ROUNDS, KEY_SETTING, TEST_KEY = 100_000, 60, "spark.piperack.pii.key", "only for tests"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}"
IP = rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\d]|\.\d)"
SECRET = r"(?<![\p{L}\p{N}])(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}+"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"

#: Given names that surrogates are taken from, by gender and script; surnames are spelled from syllables.
GIVEN = {
    "male latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Marco", "Nils", "Oscar", "Paul", "Ravi", "Simon", "Tomas", "Victor", "Walter"),
    "female latin": ("Ada", "Bianca", "Clara", "Dora", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Karla", "Lucia", "Maria", "Nora", "Olga", "Petra", "Rosa", "Sofia", "Tina", "Vera"),
    "male cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Павел"),
    "female cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Мария", "Ольга", "Софья"),
}
GIVEN["any latin"] = ("Alex", "Ariel", "Charlie", "Dominique", "Jamie", "Jordan", "Kim", "Lee", "Luca", "Mika", "Noel", "Robin", "Sam", "Sascha", "Sidney", "Yuri")
GIVEN["any cyrillic"] = ("Женя", "Саша", "Валя", "Слава", "Шура")
#: Given names that mark a person without a title, by gender.
COMMON = {
    "male": "Adam Ahmed Alan Albert Alejandro Alexander Andreas Andrew Anthony Arthur Benjamin Bernd Brian Bruno Carlos Charles Christopher Daniel David Dieter Edward Eric Fernando Francisco François Frank Frederick George Gerald Hans Harold Harry Heinrich Henry Jacques James Javier Jean Jeffrey Jerry Joachim John Jonathan Jorge José Joseph Juan Jürgen Kenneth Kevin Klaus Larry Lawrence Luis Manuel Mark Martin Matthew Michael Michel Miguel Mohammed Nicholas Oliver Patrick Paul Pedro Peter Philip Philippe Pierre Raymond Richard Robert Roger Ronald Samuel Stefan Stephen Steven Thomas Timothy Wilhelm William Wolfgang Иван Сергей Дмитрий Алексей Николай Михаил".split(),
    "female": "Alice Amanda Amy Andrea Angela Anna Anne Barbara Brigitte Carmen Carol Caroline Catherine Charlotte Christine Claudia Cynthia Deborah Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Fatima Françoise Gabriele Helen Helga Ingrid Isabel Isabelle Jacqueline Jane Janet Jennifer Jessica Joan Judith Julia Karen Katherine Kathleen Laura Linda Lisa Lucía Margaret Maria María Marie Martha Mary Melissa Michelle Monika Nancy Nathalie Nicole Pamela Patricia Petra Rachel Rebecca Renate Rosa Ruth Sabine Sandra Sara Sarah Sharon Sophie Stephanie Susan Sylvie Teresa Ursula Victoria Virginia Yvonne Анна Елена Мария Ольга Наталья Екатерина".split(),
}
_PART = r"\p{Lu}\p{Ll}*+(?:['’-]?\p{Lu}\p{Ll}++|['’-]\p{Ll}{2,}+)*+"
_LONG_PART = rf"(?=\p{{Lu}}['’\p{{Ll}}]){_PART}"
_PARTICLES = "van|von|der|den|de|del|della|di|da|dos|la|le|bin|ibn|al|el|ter|zu"
_REST = rf"(?: \p{{Lu}}\.)? (?:(?:{_PARTICLES}) ){{0,3}}{_LONG_PART}"
# Looking at the first letter, or for a capitalised word and what may follow it, comes first: most words end there.
_TITLED = rf"(?=[\p{{Lu}}гдп])(?:{_MALE}|{_FEMALE}|{_OTHER}) (?:(?:{_OTHER}) )?{_PART}(?:{_REST})?"
_CUED = rf"(?=[MmNnSsRrJjМм])(?:{_CUE}) {_PART}{_REST}"
_NAMED = rf"(?=\p{{Lu}}\p{{L}}++ (?:\p{{Lu}}|(?:{_PARTICLES}) ))(?:{'|'.join(COMMON['male'] + COMMON['female'])}){_REST}"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}})(?:{_TITLED}|{_CUED}|{_NAMED})(?!\p{{L}})"
# No entity starts within a word; what its first character can't start isn't tried.
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{EMAIL}|(?=[\d+(])(?:{IP}|{SSN}|{CARD}|{PHONE})|(?=\p{{L}})(?:{SECRET}|{PERSON}))"
SYLLABLES = {"latin": ("ba", "den", "fer", "gal", "hol", "kin", "lor", "mas", "nel", "pra", "ros", "sel", "tor", "ven", "wid", "zan"), "cyrillic": ("ба", "вер", "гал", "дор", "жан", "зим", "кол", "лен", "мир", "нос", "пет", "рус", "сол", "тим", "фед", "шар")}
_UNIT = "array<struct<kind:string,value:string>>"


def _literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one being the check digit."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda n, d: n + d)


def kind_of(entity: Column) -> Column:
    """The kind of a match of PATTERN; null for a number that is no card after all."""
    card = F.when(luhn_sum(_digits(entity)) % 10 == 0, "card")
    return (
        F.when(entity.rlike(r"^(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd)\s{0,3}[=:]"), "secret")
        .when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^(\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$"), card)
        .when(entity.rlike(r"^[+(\d]"), "phone")
        .otherwise("person")
    )


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _prefix(entity: Column) -> Column:
    """Titles or cue of a person, with the space after them; may be empty."""
    return F.regexp_extract(entity, rf"^(?:(?:(?:{_MALE}|{_FEMALE}|{_OTHER}|{_CUE}) ){{1,2}})?", 0)


def _person(entity: Column) -> tuple[Column, Column, Column]:
    """Gender, given name (may be empty) and surname of a person."""
    words = F.split(F.substr(entity, F.length(_prefix(entity)) + 1), " ")
    given = F.when(F.size(words) > 1, words[0]).otherwise("")
    named = lambda g: given.isin(*COMMON[g])
    gender = F.when(entity.rlike(rf"^(?:{_FEMALE}) "), "female").when(entity.rlike(rf"^(?:{_MALE}) "), "male").when(named("female"), "female").when(named("male"), "male").otherwise("any")
    return gender, given, F.element_at(words, -1)


def _bare_secret(entity: Column) -> Column:
    return F.regexp_extract(entity, r"([A-Za-z0-9+/_-]{16,})$", 1)


def _hexadecimal(text: Column) -> Column:
    return text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")


def units_of(entity: Column, kind: Column) -> Column:
    """The units of an entity: kind and canonical value."""
    gender, given, surname = _person(entity)
    unit = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    secret = _bare_secret(entity)
    one = (
        F.when(kind == "ip", entity)
        .when(kind == "secret", F.when(_hexadecimal(secret), F.lower(secret)).otherwise(secret))
        .when(kind == "phone", F.right(_digits(entity), F.lit(10)))
        .otherwise(_digits(entity))
    )
    address = F.lower(entity)
    email = F.array(unit(kind, address), unit(F.lit("domain"), F.split_part(address, F.lit("@"), F.lit(2))))
    person = F.filter(F.array(unit(F.concat(gender, F.lit(" "), _script(given)), F.lower(given)), unit(F.concat(F.lit("surname "), _script(surname)), F.lower(surname))), lambda u: u["value"] != "")
    return F.when(kind.isNull(), F.expr(f"cast(array() as {_UNIT})")).when(kind == "person", person).when(kind == "email", email).otherwise(F.array(unit(kind, one)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _masked(template: Column, numbers: Column, letters: Column) -> Column:
    """``template`` with each digit and letter replaced by that of the streams at the same place, capitals by capitals."""
    at = lambda stream, i: F.substr(stream, i % 100 + 1, F.lit(1))
    one = lambda c, i: F.when(c.rlike(r"\d"), at(numbers, i)).when(c.rlike(r"\p{Lu}"), F.upper(at(letters, i))).when(c.rlike(r"\p{L}"), at(letters, i)).otherwise(c)
    return F.array_join(F.transform(F.split(template, ""), one), "")


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 of a text, in hexadecimal digits."""
    raw = key.encode()
    block = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def surrogate(kind: Column, value: Column, nonce: Column, key: str) -> Column:
    """The surrogate of a unit in canonical form; of an e-mail address that of its mailbox, with the domain it had."""

    def streams(seed: Column) -> Column:
        named = {"seed": seed, "numbers": F.translate(seed, "abcdef", "012345"), "letters": F.translate(seed, "0123456789abcdef", "bcdfghklmnprstvz"), "hexes": F.translate(seed, "0123456789", "abcdefabcd")}
        return _bound(F.struct(*[c.alias(n) for n, c in named.items()]), lambda x: _surrogate(kind, value, nonce, *[x[n] for n in named]))

    return _bound(_hmac(key, F.concat_ws("|", kind, nonce.cast("string"), value)), streams)


def _surrogate(kind: Column, value: Column, nonce: Column, seed: Column, numbers: Column, letters: Column, hexes: Column) -> Column:
    number = lambda i: F.conv(F.substr(seed, 1 + 4 * i % 124, F.lit(4)), 16, 10).cast("int")
    mailbox, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    more = F.substr(letters, F.lit(101), F.least(nonce, F.lit(28)))  # a longer name where the short one is taken
    host = F.concat(_masked(F.split_part(value, F.lit("."), F.lit(1)), numbers, letters), more)
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(numbers, F.lit(2), F.length(value) - 2))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (number(i) % 254 + 1).cast("string")), ".")
    out = (
        F.when(kind == "email", F.concat(_masked(mailbox, numbers, letters), more, F.lit("@"), domain))
        .when(kind == "domain", F.concat(host, F.lit(".example."), F.when(value.rlike(r"\.(net|org)$"), F.split_part(value, F.lit("."), F.lit(-1))).otherwise("com")))
        .when(kind == "ip", octets)
        .when(kind == "secret", _masked(value, numbers, F.when(_hexadecimal(value), hexes).otherwise(letters)))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "phone", F.concat(F.substr(numbers, F.lit(1), F.lit(3)), F.when(nonce < 3, "555").otherwise(F.substr(numbers, F.lit(8), F.lit(3))), F.substr(numbers, F.lit(4), F.lit(4))))
        .when(kind == "ssn", F.substr(numbers, F.lit(1), F.lit(9)))
    )
    pieces = F.regexp_extract_all(value, F.lit(r"(['’-]|[^'’-]+)"), F.lit(1))

    def surname(parts: tuple[str, ...]) -> Column:
        """The signs of a name with words of syllables between them, a letter for a letter."""
        spelled = lambda j: F.array_join(F.transform(F.sequence(F.lit(0), 2 + nonce), lambda i: _literals(parts)[number(i + 7 * j) % len(parts)]), "")
        letter = lambda c: (F.length(c) == 1) & (F.size(pieces) > 1)
        return F.array_join(F.transform(pieces, lambda c, j: F.when(c.rlike("['’-]"), c).when(letter(c), F.substr(spelled(j), F.lit(1), F.lit(1))).otherwise(spelled(j))), "")

    def given(names: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), nonce), lambda i: F.lower(_literals(names)[number(i) % len(names)])), "-")

    for script, parts in SYLLABLES.items():
        out = out.when(kind == f"surname {script}", surname(parts))
    for group, names in GIVEN.items():
        out = out.when(kind == group, given(names))
    return out


def _in_case(template: Column, text: Column) -> Column:
    """``text`` in capitals, or with a capital after each sign, where ``template`` is."""
    titled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(['’-]|[^'’-]+)"), F.lit(1)), F.initcap), "")
    return F.when((template == F.upper(template)) & (F.length(template) > 1), F.upper(text)).when(template.rlike(r"^\p{Lu}"), titled).otherwise(text)


def _placed(template: Column, digits: Column) -> Column:
    """``digits`` in the places of the last digits of ``template``."""
    before = lambda i: F.length(_digits(F.substr(template, F.lit(1), i)))
    first = F.length(_digits(template)) - F.length(digits)
    return F.array_join(
        F.transform(F.split(template, ""), lambda c, i: F.when(c.rlike(r"\d") & (before(i + 1) > first), F.substr(digits, before(i + 1) - first, F.lit(1))).otherwise(c)), ""
    )


def render(entity: Column, key: str, nonces: Column | None = None) -> Column:
    """The surrogate of one mention, in its format; ``nonces`` is a map from "kind|value" to a nonce above 0."""

    def made(u: Column) -> Column:
        nonce = F.coalesce(F.element_at(nonces, F.concat_ws("|", u["kind"], u["value"])), F.lit(0)) if nonces is not None else F.lit(0)
        return surrogate(u["kind"], u["value"], nonce, key)

    def person(found: Column) -> Column:
        _, given, surname = _person(entity)
        parts = F.struct(_prefix(entity).alias("prefix"), _in_case(given, found[0]).alias("first"), _in_case(surname, F.element_at(found, -1)).alias("last"))

        def written(p: Column) -> Column:
            words = F.split(F.substr(entity, F.length(p["prefix"]) + 1), " ")
            initial = F.concat(F.upper(F.substr(F.reverse(F.element_at(found, -1)), F.lit(1), F.lit(1))), F.lit("."))
            word = lambda w, i: F.when(i == F.size(words) - 1, p["last"]).when(i == 0, p["first"]).when(w.rlike(r"^\p{Lu}\.$"), initial).otherwise(w)
            return F.concat(p["prefix"], F.array_join(F.transform(words, word), " "))

        return _bound(parts, written)

    def secret(found: Column) -> Column:
        return _bound(_bare_secret(entity), lambda bare: F.concat(F.substr(entity, F.lit(1), F.length(entity) - F.length(bare)), F.when(_hexadecimal(bare) & (bare == F.upper(bare)), F.upper(found[0])).otherwise(found[0])))

    def email(found: Column) -> Column:
        address = F.concat(F.split_part(found[0], F.lit("@"), F.lit(1)), F.lit("@"), F.get(found, F.lit(1)))
        return F.when(entity == F.upper(entity), F.upper(address)).otherwise(address)

    def of(kind: Column) -> Column:
        whole = lambda found: F.when(kind == "email", email(found)).when(kind == "ip", found[0]).when(kind == "secret", secret(found)).when(kind == "person", person(found)).otherwise(_placed(entity, found[0]))
        return F.when(kind.isNull(), entity).otherwise(_bound(F.transform(units_of(entity, kind), made), whole))

    return _bound(kind_of(entity), of)


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def length_after(text: str, n_chars: str) -> Column:
    """The length of a text that may have been changed, in the place of ``n_chars``; null stays null."""
    return F.when(F.col(n_chars).isNotNull(), F.length(text)).cast("long")


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting ``KEY_SETTING``, from a secret store in a real run; a known one where it is unset."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def colliding(units: DataFrame, key: str) -> DataFrame:
    """kind, value, nonce of the units whose nonce isn't 0, once all surrogates are distinct and none is a unit of the corpus.

    The smallest value of those that share a surrogate keeps it. A round works on the units that collide alone: their
    next surrogates are held against each other's, those of all units that have settled, and the corpus.
    """
    named = lambda df, nonce: df.withColumn("nonce", nonce).withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("nonce"), key))
    real = units.select("kind", F.col("value").alias("made")).withColumn("real", F.lit(True))
    state = kept(named(units, F.lit(0)))
    fresh, settled = state, None
    for _ in range(ROUNDS):
        holders = fresh.groupBy("kind", "made").agg(F.min("value").alias("holder")).join(real, ["kind", "made"], "left")
        if settled is not None:
            taken = state.select("kind", "made").union(settled.select("kind", "made")).withColumn("taken", F.lit(True)) if settled is not state else None
            holders = holders.join(taken.distinct(), ["kind", "made"], "left").withColumn("real", F.coalesce("real", "taken")).drop("taken")
        judged = kept(fresh.join(holders, ["kind", "made"]).withColumn("stays", F.col("real").isNull() & (F.col("holder") == F.col("value"))).select("kind", "value", "nonce", "made", "stays"))
        again = judged.where("not stays").select("kind", "value", "nonce")
        if settled is None:
            state, settled = judged.where("stays").drop("stays"), judged.where("stays and false").drop("stays")
        else:
            settled = settled.union(judged.where("stays").drop("stays"))
        if again.isEmpty():
            return settled.select("kind", "value", "nonce")
        fresh = kept(named(again, F.col("nonce") + 1))
    raise ValueError(f"units collide after {ROUNDS} nonces")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, n_replaced and the sorted distinct kinds."""
    found = docs.withColumn("__entities", entities(F.col(text)))
    mentions = found.where(F.size("__entities") > 0).select(F.xxhash64(text).alias("__text"), F.explode(F.array_distinct("__entities")).alias("entity"))
    each = mentions.select("__text", F.explode(_bound(kind_of(F.col("entity")), lambda k: units_of(F.col("entity"), k))).alias("u")).select("__text", "u.kind", "u.value")
    each = kept(each.distinct())
    units = kept(each.select("kind", "value").distinct())
    moved = kept(colliding(units, key))
    nonces = None
    if not moved.isEmpty():
        pairs = F.struct(F.concat_ws("|", "kind", "value"), F.col("nonce"))
        maps = kept(each.join(moved, ["kind", "value"]).groupBy("__text").agg(F.map_from_entries(F.collect_set(pairs)).alias("__nonces")))
        found = found.withColumn("__text", F.xxhash64(text)).join(F.broadcast(maps) if maps.count() <= SMALL else maps, "__text", "left")
        nonces = F.coalesce("__nonces", F.expr("cast(map() as map<string,int>)"))
    kinds = F.filter(F.transform("__entities", kind_of), lambda k: k.isNotNull())
    pieces = F.zip_with(F.split(F.col(text), PATTERN, -1), F.transform("__entities", lambda e: render(e, key, nonces)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = found.withColumns(
        {
            text: F.when(F.size("__entities") > 0, F.array_join(pieces, "")).otherwise(F.col(text)),
            "n_replaced": F.when(F.size("__entities") > 0, F.size(kinds)).otherwise(0).cast("long"),
            "kinds": F.when(F.size("__entities") > 0, F.array_sort(F.array_distinct(kinds))).otherwise(F.expr("cast(array() as array<string>)")),
        }
    )
    return done.select(*[c for c in docs.columns if c not in ("n_replaced", "kinds")], "n_replaced", "kinds")
