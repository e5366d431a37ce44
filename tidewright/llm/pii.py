"""Personal data: detected entities get keyed surrogates of the same type and format, by SQL functions alone.

Kinds: e-mail address, IPv4 and IPv6 address (the latter of three groups or more, with two digits in a row somewhere in the text), bank
account number (IBAN with valid check digits), telephone number, social security number, payment card number (valid check digit) and
person after a form of address; where a person of two words or more is found so, every other mention of the name in the text is replaced too. A surrogate depends on the key, by HMAC-SHA256, on the kind and on the canonical entity
(lower-cased address, bare digits, words of a name) only, so every mention gets the same one, in this text and in all others.

* Numbers keep their length, separators and country code or first card digit; their other digits go through a keyed Feistel
  permutation (halves, four rounds), cards get a new check digit, IPv4 addresses are permuted as two halves of 16 bits.
  Country codes are read from the digits alone and none begins another, so different numbers, in whatever format, get
  different surrogates: no collision is possible. A number of country code 1 with ten digits more is that of those ten digits.
* IBANs keep country, letters and spaces, and get new check digits. IPv6 addresses are written in full; each group goes
  through a keyed permutation that depends on the groups before it, so no two addresses meet.
* E-mail addresses get a given name, letters and the same top-level domain under an example domain.
* Persons get given names of the gender of the form of address and a family name of syllables, in the script of the name. The
  family name depends on the family name alone, the given names on the given names, so "Mr Smith" and "Mr John Smith" still share
  their family name, and stay as ambiguous as they were.

Addresses, family names, and given names under one family name can collide, so the distinct ones are checked: of those with one
surrogate all but the smallest draw again, from a larger space, until none collide. Only such rare redraws are joined back to
the documents. A surrogate may by chance be the name or number of somebody else; that one is replaced in turn.

Null texts stay null, empty texts empty; an empty table gives no rows. Very long texts are handled whole: no pattern repeats
a group without bound, and the unbounded runs are single characters. Addresses count up to 64 characters before the @ and 253
after it. Digits of other kinds (order numbers, cards with a wrong check digit) stay. Repeated rows are replaced alike. Columns
of the documents stay, whatever their names, but those named like the counts n_<kind> are replaced where counts are asked for (n_person
counts mentions with a form of address);
n_chars, where there is one, is counted anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,63}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
#: Forms of address by gender (fixed values).
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
ADDRESS = f"(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})"
PERSON = rf"(?<![\p{{L}}]){ADDRESS}\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}"
ENTITY = "|".join((EMAIL, IPV6, IP, IBAN, PHONE, SSN, CARD, PERSON))
KINDS = ("email", "ip", "ipv6", "iban", "phone", "ssn", "card", "person")

#: Given names by script and gender, and syllables of family names by script (fixed values).
GIVEN = {
    ("latin", "m"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo".split(),
    ("latin", "f"): "Anna Berta Clara Dora Emma Frida Greta Hanna Ida Julia Klara Lena".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Пётр".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Ева Зоя Ирина Клара Лидия Мария Нина Ольга".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δήμος Ηλίας Θωμάς Ιάσων Κώστας Λάμπρος Μάρκος Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Καλλιόπη Λίνα Μαρία".split(),
}
SYLLABLES = {
    "latin": "ba de fi go hu ja ke li mo nu pa re si to vu za".split(),
    "cyrillic": "ба де фи го ху жа ке ли мо ну па ре си то ву за".split(),
    "greek": "βα δε φι γο χυ ζα κε λι μο νυ πα ρε σι το θυ ξα".split(),
}
#: Country codes, none of which begins another (fixed values of the numbering plan; all others have three digits).
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Draws beyond which something else must be wrong: each one has a larger space than the one before.
REDRAWS = 40


def _random(key: str, *parts: Column | str) -> Column:
    """60 pseudo-random bits of the parts, as a long: the head of their HMAC-SHA256 under the key."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36."""

    def rounds(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        start = F.struct(F.substr(d, F.lit(1), a).cast("long").alias("l"), F.substr(d, a + 1).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(_random(key, kind, n, k, F.lit("l"), s["r"]), _power(a)), _power(a))
            return _let(left, lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + F.pmod(_random(key, kind, n, k, F.lit("r"), x), _power(n - a)), _power(n - a)).alias("r")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0")))

    return _let(digits, lambda d: F.when(F.length(d) >= 2, rounds(d)).otherwise(d))


def _poured(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced in turn."""
    at = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^0-9]", ""))
    char = lambda i: F.substr(entity, i, F.lit(1))
    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(char(i).rlike("[0-9]"), F.substr(d, at(i), F.lit(1))).otherwise(char(i))), ""))


def _luhn(digits: Column, skip: int) -> Column:
    """The check sum of digits when skip digits are still to follow them."""

    def add(total: Column, i: Column) -> Column:
        v = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
        return total + F.when((i + skip) % 2 == 1, double).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _spaced(entity: Column, letters: Column) -> Column:
    """The entity with its letters and digits replaced in turn, its spaces where they are."""
    at = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), " ", ""))
    char = lambda i: F.substr(entity, i, F.lit(1))
    return _let(letters, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(char(i) == " ", " ").otherwise(F.substr(d, at(i), F.lit(1)))), ""))


def _mod97(text: Column) -> Column:
    """The number that digits and letters, A being 10, make together, modulo 97."""

    def step(r: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _iban_valid(entity: Column) -> Column:
    return _let(F.regexp_replace(entity, " ", ""), lambda x: _mod97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))) == 1)


def _iban(entity: Column, key: str) -> Column:
    country = F.substr(entity, F.lit(1), F.lit(2))

    def rest(x: Column) -> Column:
        return _let(_poured(x, _permuted(bare(x), key, "iban")), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    return _spaced(entity, _let(F.substr(F.regexp_replace(entity, " ", ""), F.lit(5)), rest))


def _groups(entity: Column) -> Column:
    """The eight groups of an IPv6 address as numbers."""

    def expanded(sides: Column) -> Column:
        part = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
        zeros = F.greatest(F.lit(8) - F.size(part(0)) - F.size(part(1)), F.lit(0))
        return F.transform(F.concat(part(0), F.array_repeat(F.lit("0"), zeros), part(1)), lambda x: F.conv(x, 16, 10).cast("long"))

    return _let(F.split(entity, "::"), expanded)


def _ipv6(entity: Column, key: str) -> Column:
    def group(done: Column, v: Column) -> Column:
        """One group by a Feistel permutation of its halves; done has the groups before it, as they were and as they are."""
        rounds = F.aggregate(
            F.sequence(F.lit(1), F.lit(4)),
            F.struct(F.shiftright(v, 8).alias("l"), v.bitwiseAND(255).alias("r")),
            lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.pmod(_random(key, "ipv6", done["was"], k, s["r"]), F.lit(256))).alias("r")),
            lambda s: s["l"] * 256 + s["r"],
        )
        return F.struct(F.concat_ws(":", done["was"], v.cast("string")).alias("was"), F.concat(done["now"], F.array(F.lower(F.hex(rounds)))).alias("now"))

    start = F.struct(F.lit("").alias("was"), F.array().cast("array<string>").alias("now"))
    return F.aggregate(_groups(entity), start, group, lambda s: F.array_join(s["now"], ":"))


def bare(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def kind_of(entity: Column) -> Column:
    """The kind of a match of ENTITY; null for card and account numbers with wrong check digits and IPv6 addresses of one group or two."""
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.contains(":"), F.when(F.size(F.filter(F.split(entity, ":"), lambda x: x != "")) >= 3, "ipv6"))
        .when(entity.rlike(rf"^(?:{IP})$"), "ip")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}"), F.when(_iban_valid(entity), "iban"))
        .when(entity.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(entity.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(entity.rlike(r"^\d"), F.when(_luhn(bare(entity), 0) % 10 == 0, "card"))
        .otherwise("person")
    )


def canonical(entity: Column, kind: Column) -> Column:
    """What two mentions of one e-mail address or person share; a person's is the gender and the name."""
    name = F.regexp_replace(entity, rf"^{ADDRESS}\.? ", "")
    return F.when(kind == "email", F.lower(entity)).when(kind == "person", F.concat_ws("|", F.when(entity.rlike(f"^(?:{'|'.join(FEMALE)})\\b"), "f").otherwise("m"), F.lower(name)))


def _family(person: Column) -> Column:
    """The canonical family name of a canonical person: its last word."""
    return F.concat(F.lit("family|"), F.regexp_extract(person, r"([^ |]+)$", 1))


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _by_script(name: Column, make) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(name.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))


def _email(entity: Column, attempt: Column, key: str) -> Column:
    canon = F.lower(entity)
    seed = lambda part: _random(key, "email", part, attempt, canon)
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7) + attempt), lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(_random(key, "letter", i, attempt, canon), F.lit(26)) + 1).cast("int"), F.lit(1))), "")
    return F.concat(F.lower(_pick(GIVEN["latin", "m"] + GIVEN["latin", "f"], seed("given"))), F.lit("."), letters, F.lit("@mail.example."), F.lower(F.regexp_extract(entity, r"\.([A-Za-z]{2,})$", 1)))


def _family_name(family: Column, attempt: Column, key: str) -> Column:
    """Syllables, one more each draw."""
    name = lambda script: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4) + attempt), lambda i: _pick(SYLLABLES[script], _random(key, "family", i, attempt, family))), "")
    return _let(_by_script(F.substr(family, F.lit(8)), name), lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2))))


def _given_names(person: Column, attempt: Column, key: str) -> Column:
    """One given name for each word before the family name; names joined by hyphens, one more each draw. Empty without such words."""
    words = F.split(F.substr(person, F.lit(3)), " ")

    def name(script: str) -> Column:
        one = lambda w, i: F.when(person.startswith("f|"), _pick(GIVEN[script, "f"], _random(key, "given", i, attempt, w))).otherwise(_pick(GIVEN[script, "m"], _random(key, "given", i, attempt, w)))
        # A later draw depends on the whole name, so that persons who share a given name move apart.
        seed = lambda w: F.when(attempt == 0, w).otherwise(F.concat(w, F.lit("|"), person))
        return F.array_join(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: one(seed(w), i)), "-")), " ")

    return _by_script(F.substr(person, F.lit(3)), name)


def _person(entity: Column, canon: Column, attempt, key: str) -> Column:
    """attempt gives the draws of a canonical name."""
    address = F.regexp_extract(entity, rf"^{ADDRESS}\.? ", 0)
    given = _given_names(canon, attempt(canon), key)
    return F.concat(address, _let(given, lambda g: F.when(g == "", "").otherwise(F.concat(g, F.lit(" ")))), _let(_family(canon), lambda f: _family_name(f, attempt(f), key)))


def surrogate(entity: Column, attempt, key: str) -> Column:
    """The replacement of one match; attempt(canonical name or address) counts the draws that collided."""

    def number(kind: str, fixed: Column) -> Column:
        return _let(bare(entity), lambda d: _poured(entity, F.concat(F.substr(d, F.lit(1), fixed), _permuted(F.substr(d, fixed + 1), key, kind))))

    def card(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: _poured(entity, F.concat(b, F.pmod(-_luhn(b, 1), F.lit(10)).cast("string"))))

    def ip(p: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            left = s["l"].bitwiseXOR(F.pmod(_random(key, "ip", k, F.lit("l"), s["r"]), F.lit(65536)))
            return _let(left, lambda x: F.struct(x.alias("l"), s["r"].bitwiseXOR(F.pmod(_random(key, "ip", k, F.lit("r"), x), F.lit(65536))).alias("r")))

        octet = lambda i: F.element_at(p, i).cast("long")
        start = F.struct((octet(1) * 256 + octet(2)).alias("l"), (octet(3) * 256 + octet(4)).alias("r"))
        dotted = lambda s: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.shiftright(s[h], 8), s[h].bitwiseAND(255))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, dotted)

    code = F.when(entity.startswith("+"), F.length(F.regexp_extract(bare(entity), COUNTRY, 0))).otherwise(0)
    kind = kind_of(entity)
    return _let(
        kind,
        lambda k: F.coalesce(
            F.when(k == "email", _email(entity, attempt(F.lower(entity)), key))
            .when(k == "ip", ip(F.split(entity, r"\.")))
            .when(k == "ipv6", _ipv6(entity, key))
            .when(k == "iban", _iban(entity, key))
            .when(k == "phone", F.when(entity.startswith("+") & ~bare(entity).rlike(r"^1\d{10}$"), number("international", code)).otherwise(number("phone", code)))
            .when(k == "ssn", number("ssn", F.lit(0)))
            .when(k == "card", _let(bare(entity), card))
            .when(k == "person", _let(canonical(entity, k), lambda c: _person(entity, c, attempt, key))),
            entity,
        ),
    )


def _entities(text: Column, pattern: str = ENTITY) -> Column:
    """All matches in order; texts without a digit pair, an @ or a form of address are not searched."""
    return F.when(text.rlike(rf"\d\d|@|\d\.\d|{ADDRESS}"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _drawn(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """What must differ between the canonical entities of a kind; null for a person without a given name."""
    given = _let(_given_names(canon, attempt, key), lambda g: F.when(g != "", F.concat(g, F.lit("|"), _family(canon))))
    return F.when(kind == "email", _email(canon, attempt, key)).when(kind == "family", _family_name(canon, attempt, key)).otherwise(given)


def redraws(docs: DataFrame, key: str) -> DataFrame | None:
    """(canon, attempt) of the addresses, family names and persons whose first surrogate collides with another's; None if there are none."""
    scratch = Scratch(docs.sparkSession)
    found = docs.select(F.explode(_entities(F.col("text").cast("string"), f"{EMAIL}|{PERSON}")).alias("entity"))
    kinds = found.select("entity", kind_of(F.col("entity")).alias("kind")).select("kind", canonical(F.col("entity"), F.col("kind")).alias("canon")).distinct()
    named = F.when(F.col("kind") == "person", F.array(F.struct("kind", "canon"), F.struct(F.lit("family").alias("kind"), _family(F.col("canon")).alias("canon")))).otherwise(F.array(F.struct("kind", "canon")))
    now = scratch.table(kinds.select(F.explode(named).alias("e")).select("e.*").distinct().withColumn("attempt", F.lit(0)), "entities")
    for _ in range(REDRAWS):
        drawn = now.withColumn("drawn", _drawn(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        clash = scratch.table(drawn.filter("drawn is not null").groupBy("kind", "drawn").agg(F.count("*").alias("n"), F.min("canon").alias("first")).filter("n > 1"), "clashes")
        if clash.isEmpty():
            break
        now = scratch.table(drawn.join(clash, ["kind", "drawn"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce((F.col("canon") != F.col("first")).cast("int"), F.lit(0))).alias("attempt")), "redrawn")
    else:
        raise RuntimeError(f"surrogates still collide after {REDRAWS} draws")
    late = scratch.keep(now.filter("attempt > 0").select("canon", "attempt"), "late")
    scratch.clear()
    return None if late.isEmpty() else late


def pseudonymise(docs: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """The documents with surrogates in their text; with counts, also a column n_<kind> for each kind with the number of replacements."""
    rows = (docs.drop(*(f"n_{k}" for k in KINDS)) if counts else docs).select(F.struct("*").alias("row"))
    text, late = F.col("row.text").cast("string"), redraws(docs, key)
    if late is None:
        ready, attempt = rows, lambda canon: F.lit(0)
    else:
        mention = docs.select("doc_id", F.explode(_entities(F.col("text").cast("string"), f"{EMAIL}|{PERSON}")).alias("entity")).select("doc_id", canonical(F.col("entity"), kind_of(F.col("entity"))).alias("canon"))
        mine = mention.select("doc_id", F.explode(F.array("canon", _family(F.col("canon")))).alias("canon")).distinct().join(late, "canon")
        by_doc = mine.groupBy(F.col("doc_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("canon", "attempt"))).alias("redrawn"))
        ready = rows.join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("of")), "left")
        attempt = lambda canon: F.coalesce(F.element_at(F.col("redrawn"), canon), F.lit(0))
    split = ready.withColumn("found", _entities(text))
    swapped = split.withColumn("new", F.transform("found", lambda e: F.struct(kind_of(e).alias("kind"), surrogate(e, attempt, key).alias("text"))))
    # Names of two words or more, and what they become, without their forms of address.
    name = lambda e: F.regexp_replace(e, rf"^{ADDRESS}\.? ", "")
    pairs = F.filter(F.zip_with("found", "new", lambda e, n: F.struct(n["kind"].alias("kind"), name(e).alias("old"), name(n["text"]).alias("new"))), lambda x: (x["kind"] == "person") & x["old"].contains(" "))
    swapped = swapped.withColumn("named", F.array_distinct(pairs))
    bounded = lambda old: F.concat(F.lit(r"(?<![\p{L}])"), old, F.lit(r"(?![\p{L}])"))
    mentions = lambda g: F.aggregate("named", g, lambda t, x: F.regexp_replace(t, bounded(x["old"]), x["new"]))
    split_at = F.split(text, ENTITY, -1)
    gaps = F.when(F.size("named") > 0, F.transform(split_at, mentions)).otherwise(split_at)
    whole = F.when(F.size("found") > 0, F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i)["text"], F.lit("")))), "")).otherwise(text)
    row = F.col("row").withField("text", whole)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length(whole).cast(docs.schema["n_chars"].dataType), F.col("row.n_chars")))
    of_kind = lambda k: F.filter("new", lambda x: x["kind"] == k)
    numbers = [F.coalesce(F.size(of_kind(k)), F.lit(0)).alias(f"n_{k}") for k in KINDS] if counts else []
    return swapped.select(row.alias("row"), *numbers).select("row.*", *(f"n_{k}" for k in KINDS if counts))
