"""Personal data: keyed surrogates in place of detected entities.

An entity's canonical form and the key determine its surrogate, so equal
entities get equal surrogates in every document without a join. Numbers and
addresses go through a keyed permutation of all forms of their format: a Feistel
network whose halves are the characters at even and at odd places, each moved
within its class of script, case or digits. So surrogates have the format of
what they replace, and different entities of a format different ones, by
construction. Names are replaced word by word, given names by gender, surnames
without: whoever shares a surname still does. A person who is named after a
title once is found again in the same text by the full name or the surname alone.

A permutation may still hit another real entity, and names of syllables each
other. All distinct entities of the input are checked for such collisions;
those that collide are drawn again. Only these exceptions, few as a rule, are
joined to the documents that hold them. Mentions are found once and written,
with the gaps between them, to the shared folder.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch

#: Titles that tell a gender, and titles that don't.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|господин|κύριος"
NEUTRAL = "Dr|Prof|Professor|Professorin|Doktor|доктор|профессор"
TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})"
#: What each kind looks like, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{16}|3[47]\d{2} \d{6} \d{5}|3[47]\d{2}-\d{6}-\d{5}|3[47]\d{13})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<![.,/-])0\d(?:[ .]\d{2}){4}|(?<![.,/-])0\d{2,4}[ /-]\d{5,9})(?!\d)",
    "name": rf"(?<=(?<!\p{{L}}){TITLE}\.? )(?!{TITLE}\b)\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Any entity has one of these; texts without are left alone at once.
HINT = rf"@|\d{{3}}|\d\.\d|\+\d|0\d[ .]\d|:[0-9A-Fa-f]{{0,4}}:|[A-Z]{{2}}\d{{2}}|(?<!\p{{L}}){TITLE}\.? \p{{Lu}}"
#: Country codes of one and of two digits; all others have three, and none begins another.
COUNTRY = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: First and last code point of each class; a character moves within its class, one of no class stays.
CLASSES = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A),  # digits, Latin
    (0xC0, 0xD6), (0xD8, 0xDE), (0xE0, 0xF6), (0xF8, 0xFE), (0x100, 0x17F),  # accented Latin
    (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C1), (0x3C3, 0x3C9),  # Greek
    (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F),  # Cyrillic
    (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E),  # Hebrew, Arabic, Devanagari, Thai
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),  # kana, Han, Hangul
)
#: Consonants, vowels, endings of female and male given names, by script.
SYLLABLES = {"cyrillic": ("бвгдклмнпрст", "аеиоу", "на", "н"), "greek": ("βγδκλμνπρστ", "αεηιο", "να", "νος"), "latin": ("bdfgklmnprstv", "aeiou", "na", "n")}
ROUNDS = 6
MARK = "\ue000"
#: A format with fewer forms than this for each of its entities has no room to avoid real ones.
LEAST_ROOM = 4
#: Exceptions are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_EXCEPTIONS = 100_000
#: Entities that a task draws.
DRAWN_TOGETHER = 2000
KEY = "struct<kind:string,canon:string>"

Bounds = Callable[[Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class Settings:
    """After ``longer_after`` attempts letters are added, where the kind allows it."""

    key: str = "lodestar"
    longer_after: int = 4


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used: as a lambda's argument."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


# permutations


def _units(text: Column) -> Column:
    """UTF-16 units of a text."""
    some = lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 4 - 1).cast("int")), lambda i: _number(F.substring(h, i * 4 + 1, F.lit(4))))
    return _once(F.hex(F.encode(text, "UTF-16BE")), lambda h: F.when(F.length(h) > 0, some(h)).otherwise(F.array().cast("array<int>")))


def _text(units: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u), 4, "0")), "")), "UTF-16BE")


def _class_of(u: Column, classes: tuple[tuple[int, int], ...]) -> tuple[Column, Column]:
    low = size = F.lit(0)
    for first, last in reversed(classes):
        inside = u.between(first, last)
        low, size = F.when(inside, F.lit(first)).otherwise(low), F.when(inside, F.lit(last - first + 1)).otherwise(size)
    return low, size


def _letters(u: Column, i: Column) -> tuple[Column, Column]:
    return _class_of(u, CLASSES)


def _digits(u: Column, i: Column) -> tuple[Column, Column]:
    """Digits and capitals; a first digit that is not 0 stays so."""
    low, size = _class_of(u, CLASSES[:2])
    leads = (i == 0) & u.between(0x31, 0x39)
    return F.when(leads, F.lit(0x31)).otherwise(low), F.when(leads, F.lit(9)).otherwise(size)


def _hex_digits(u: Column, i: Column) -> tuple[Column, Column]:
    return _class_of(u, (CLASSES[0], (0x61, 0x66)))


def _octets(u: Column, i: Column) -> tuple[Column, Column]:
    """A first octet of ordinary addresses stays one of them."""
    usual = u.between(1, 223)
    return F.when(i == 0, F.lit(1)).otherwise(F.lit(0)), F.when((i == 0) & usual, F.lit(223)).when(i == 0, F.lit(0)).otherwise(F.lit(256))


def permuted(units: Column, bounds: Bounds, key: Column) -> Column:
    """A keyed permutation of all arrays that have, place by place, values of the same bounds (first, number of values).

    In each round the values at even or odd places move on, round their class, by
    numbers that a digest of the others gives; that can be undone, so no two arrays become one.
    """

    def turn(units: Column, r: Column) -> Column:
        others = F.array_join(F.transform(units, lambda u, i: F.when(i % 2 != r % 2, u.cast("string")).otherwise(F.lit(""))), ",")

        def moved(digest: Column) -> Column:
            def one(u: Column, i: Column) -> Column:
                low, size = bounds(u, i)
                by = _number(F.substring(digest, (F.pmod(F.floor(i / 2), F.lit(32)) * 4 + 1).cast("int"), F.lit(4)))
                return F.when((i % 2 == r % 2) & (size > 0), low + F.pmod(u - low + by, size)).otherwise(u)

            return F.transform(units, one)

        return _once(F.sha2(F.concat_ws("|", key, r.cast("string"), others), 512), moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), units, turn)


def _other(text: Column, bounds: Bounds, key: Column) -> Column:
    return _text(permuted(_units(text), bounds, key))


def _luhn(digits: Column) -> Column:
    """The check digit that follows some digits."""
    digit = lambda c, i: F.when((F.length(digits) - i) % 2 == 1, F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: digit(c.cast("int"), i))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda s, x: s + x), F.lit(10))


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits by ISO 7064, modulo 97."""
    step = lambda s, u: F.when(u <= 0x39, (s * 10 + u - 0x30) % 97).otherwise((s * 100 + u - 0x37) % 97)
    rest = F.aggregate(_units(F.concat(body, country, F.lit("00"))), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _parts(kind: Column, canon: Column) -> tuple[Column, Column]:
    """What a number keeps at its front, and what is permuted."""
    code = F.regexp_extract(canon, COUNTRY, 0)
    front = F.when(kind == "phone", F.when(F.startswith(canon, F.lit("0")), F.lit("0")).otherwise(code)).when(kind == "iban", F.substring(canon, 1, 2))
    front = front.when(kind == "card", F.substring(canon, F.lit(1), F.when(F.length(canon) == 15, 2).otherwise(1))).otherwise(F.lit(""))
    body = F.when(kind == "iban", F.substring(canon, F.lit(5), F.length(canon)))
    body = body.when(kind == "card", F.substring(canon, F.length(front) + 1, F.length(canon) - F.length(front) - 1))
    return front, body.otherwise(F.substring(canon, F.length(front) + 1, F.length(canon)))


def _word(kind: Column, word: Column, digest: Column, longer: Column) -> Column:
    """A name of syllables, in the script of its first letter; given names end by gender."""

    def of(consonants: str, vowels: str, female: str, male: str) -> Column:
        def at(letters: str, j: Column) -> Column:
            byte = _number(F.substring(digest, (F.pmod(j, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)))
            return F.substring(F.lit(letters), F.pmod(byte, F.lit(len(letters))) + 1, F.lit(1))

        syllables = F.array_join(F.transform(F.sequence(F.lit(0), 2 + longer * 2), lambda j: F.concat(at(consonants, 2 * j), at(vowels, 2 * j + 1))), "")
        return F.concat(syllables, F.when(kind == "given-f", F.lit(female)).when(kind == "given-m", F.lit(male)).otherwise(F.lit("")))

    cyrillic, greek, latin = (of(*SYLLABLES[s]) for s in ("cyrillic", "greek", "latin"))
    return F.when(word.rlike(r"^\p{IsCyrillic}"), cyrillic).when(word.rlike(r"^\p{IsGreek}"), greek).otherwise(latin)


def surrogate(kind: Column, canon: Column, attempt: Column, settings: Settings) -> Column:
    """The canonical form of the surrogate, of the same kind and format."""
    key = F.concat_ws("|", F.lit(settings.key), kind, attempt.cast("string"))
    longer = F.greatest(F.lit(0), attempt - settings.longer_after).cast("int")
    front, body = _parts(kind, canon)
    other = _other(body, _digits, F.concat_ws("|", key, front))

    def card(new: Column) -> Column:
        gap = F.substring(canon, -1, 1).cast("int") - _luhn(F.concat(front, body))
        return _once(F.concat(front, new), lambda n: F.concat(n, F.pmod(_luhn(n) + gap, F.lit(10)).cast("string")))

    def iban(new: Column) -> Column:
        good = F.substring(canon, 3, 2) == _iban_check(front, body)
        check = F.when(good, _iban_check(front, new)).otherwise(_other(F.substring(canon, 3, 2), _letters, F.concat_ws("|", key, F.lit("check"))))
        return F.concat(front, check, new)

    octets = F.transform(F.split(canon, r"\."), lambda o: o.cast("int"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = _other(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), _letters, F.lit(f"{settings.key}|domain"))
    more = F.when(longer > 0, F.substring(F.sha2(F.concat_ws("|", key, canon), 256), F.lit(1), longer * 2)).otherwise(F.lit(""))
    return (
        F.when(kind == "email", F.concat(_other(local, _letters, key), more, F.lit("@"), host, top))
        .when(kind == "ip", F.array_join(F.transform(permuted(octets, _octets, key), lambda o: o.cast("string")), "."))
        .when(kind == "ip6", _other(canon, _hex_digits, key))
        .when(kind == "card", _once(other, card))
        .when(kind == "iban", _once(other, iban))
        .when(kind.isin("phone", "ssn"), F.concat(front, other))
        .otherwise(_once(F.sha2(F.concat_ws("|", key, canon), 512), lambda d: _word(kind, canon, d, longer)))
    )


# mentions


def kind_of(entity: Column) -> Column:
    found = F.lit("name")
    for kind in ("phone", "ssn", "card", "iban", "ip6", "ip", "email"):
        found = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def canonical(kind: Column, entity: Column) -> Column:
    """What two mentions of one entity share: digits of numbers, after a + and the country code of phones where they show it; case folded for addresses.

    A phone as it is written in North America has the country code 1; another national one is an entity of its own.
    """
    digits = F.regexp_replace(entity, r"\D", "")
    plus = F.when(F.startswith(entity, F.lit("+")), F.lit("+")).when(entity.rlike(r"^(?:\(|\d{3}[.-]\d{3}[.-])"), F.lit("+1")).otherwise(F.lit(""))
    return F.when(kind == "phone", F.concat(plus, digits)).when(kind.isin("ssn", "card"), digits).when(kind.isin("email", "ip6"), F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity)


def _keys(kind: Column, entity: Column, gender: Column) -> Column:
    """(kind, canonical form) of what is replaced as one: a number or an address, or each word of a name."""

    def words(split: Column) -> Column:
        return F.transform(split, lambda w, i: F.struct(F.when(i == F.size(split) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given-"), gender)).alias("kind"), F.lower(w).alias("canon")))

    whole = F.array(F.struct(kind.alias("kind"), canonical(kind, entity).alias("canon")))
    return F.when(kind == "name", _once(F.split(entity, " "), words)).otherwise(whole).cast(f"array<{KEY}>")


def _with_mentions(docs: DataFrame) -> DataFrame:
    """rest, text (null if it has mentions), gaps, mentions (entity, kind, keys), and _row.

    Matches are marked, and the text cut at the marks: gaps and matches take
    turns. A text that holds the mark gets another one that it does not hold.
    """
    names = [c for c in docs.columns if c not in ("text", "n_entities")]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)) if names else [F.lit(0).alias("c0")])
    found = docs.select(rest.alias("rest"), F.col("text"), F.when(F.col("text").rlike(HINT), F.col("text")).alias("hit"))
    mark = F.when(F.contains("hit", F.lit(MARK)), F.concat(F.lit(MARK), F.md5(F.col("hit").cast("binary")), F.lit(MARK))).otherwise(F.lit(MARK))
    found = found.withColumn("mark", mark)
    around = F.concat("mark", F.lit("$0"), "mark")
    found = found.withColumn("cut", F.split(F.regexp_replace("hit", F.lit(ANY), around), F.col("mark"), -1))
    found = found.withColumn("cut", F.when(F.size("cut") > 1, F.col("cut")))

    odd = lambda a: F.filter(a, lambda x, i: i % 2 == 1)
    even = lambda a: F.filter(a, lambda x, i: i % 2 == 0)
    female, male = (rf"(?<!\p{{L}})(?:{t})\.? (?:(?:{NEUTRAL})\.? )*$" for t in (FEMALE, MALE))

    def shaped(entity: Column, gap: Column) -> Column:
        gender = F.when(gap.rlike(female), F.lit("f")).when(gap.rlike(male), F.lit("m")).otherwise(F.lit("n"))
        return F.struct(entity.alias("entity"), kind_of(entity).alias("kind"), gender.alias("gender"))

    found = found.withColumn("first", F.zip_with(odd(F.col("cut")), F.slice(even(F.col("cut")), 1, F.size(odd(F.col("cut")))), shaped))
    titled = F.filter("first", lambda m: m["kind"] == "name")
    known = F.array_distinct(F.flatten(F.transform(titled, lambda m: F.array(F.struct(m["entity"].alias("entity"), m["gender"].alias("gender")), F.struct(F.substring_index(m["entity"], " ", -1).alias("entity"), m["gender"].alias("gender"))))))
    found = found.withColumn("known", F.filter(known, lambda k: F.length(k["entity"]) > 2))
    longest = F.array_sort(F.array_distinct(F.transform("known", lambda k: k["entity"])), lambda a, b: F.length(b) - F.length(a))
    found = found.withColumn("again", F.when(F.size("known") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])(?=\p{Lu})(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}]|['’-]\p{L})"))))

    def more(gap: Column) -> Column:
        return F.when(F.col("again").isNotNull(), F.split(F.regexp_replace(gap, F.col("again"), around), F.col("mark"), -1)).otherwise(F.array(gap))

    turns = F.zip_with(F.transform(even(F.col("cut")), more), F.concat(F.col("first"), F.array(F.lit(None))), lambda own, m: F.struct(own.alias("own"), m.alias("m")))
    found = found.withColumn("turns", turns)
    named = lambda e: F.struct(e.alias("entity"), F.lit("name").alias("kind"), F.coalesce(F.get(F.filter("known", lambda k: k["entity"] == e), F.lit(0))["gender"], F.lit("n")).alias("gender"))
    mentions = F.flatten(F.transform("turns", lambda t: F.concat(F.transform(odd(t["own"]), named), F.filter(F.array(t["m"]), lambda m: m.isNotNull()))))
    keyed = F.transform(mentions, lambda m: F.struct(m["entity"].alias("entity"), m["kind"].alias("kind"), _keys(m["kind"], m["entity"], m["gender"]).alias("keys")))
    gaps = F.flatten(F.transform("turns", lambda t: even(t["own"])))
    return found.select("rest", F.when(F.col("cut").isNull(), F.col("text")).alias("text"), gaps.alias("gaps"), keyed.alias("mentions"), F.monotonically_increasing_id().alias("_row"))


def _filled(entity: Column, new: Column, slot: Callable[[Column], Column]) -> Column:
    """The entity with its slots filled by the last characters of ``new``, in order."""
    chars = F.filter(F.split(entity, ""), lambda c: c != "")

    def run(chars: Column) -> Column:
        skip = F.length(new) - F.size(F.filter(chars, slot))
        start = F.struct(F.lit("").alias("out"), skip.cast("int").alias("at"))
        step = lambda s, c: F.when(slot(c), F.struct(F.concat(s["out"], F.substring(new, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        return F.aggregate(chars, start, step, lambda s: s["out"])

    return _once(chars, run)


def _rendered(mention: Column, new: Column) -> Column:
    """Surrogates of a mention's keys in its format: its separators and case."""
    entity, kind = mention["entity"], mention["kind"]
    first = F.get(new, F.lit(0))
    shouted = lambda e: (F.upper(e) == e) & (F.lower(e) != e) & (F.length(e) > 1)
    case = lambda e, n: F.array_join(F.zip_with(F.split(n, ""), F.split(e, ""), lambda a, b: F.when(b != F.lower(b), F.upper(a)).otherwise(a)), "")
    mail = F.when(shouted(entity), F.upper(first)).when(F.length(entity) == F.length(first), case(entity, first)).otherwise(first)
    name = F.array_join(F.zip_with(new, F.split(entity, " "), lambda n, w: F.when(shouted(w), F.upper(n)).otherwise(F.initcap(n))), " ")
    digits = _filled(entity, F.replace(first, F.lit("+"), F.lit("")), lambda c: c.between("0", "9"))
    return F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", _filled(entity, first, lambda c: c != " ")).when(kind.isin("email", "ip6"), mail).when(kind == "name", name).otherwise(first)


# collisions


def _written(kind: Column, s: Column) -> Column:
    return F.when(kind == "phone", F.replace(s, F.lit("+"), F.lit(""))).otherwise(s)


def _with_room(entities: DataFrame) -> DataFrame:
    """Entities whose format has ``LEAST_ROOM`` forms or more for each of its entities, or can grow; the others keep what their permutation gives."""
    front, body = _parts(F.col("kind"), F.col("canon"))
    shape = body
    for pattern, letter in (("[0-9]", "9"), ("[A-Z]", "A"), ("[a-f]", "a")):
        shape = F.regexp_replace(shape, pattern, letter)
    bits = lambda bounds: F.aggregate(F.transform(_units(body), lambda u, i: F.log2(F.greatest(F.lit(1), bounds(u, i)[1]))), F.lit(0.0), lambda s, x: s + x)
    grows = F.col("kind").isin("email", "surname", "given-f", "given-m", "given-n")
    room = F.when(grows, F.lit(1e9)).when(F.col("kind") == "ip", F.lit(31.0)).when(F.col("kind") == "ip6", bits(_hex_digits)).otherwise(bits(_digits))
    placed = entities.withColumn("format", F.when(~grows, F.concat_ws("|", "kind", front, shape, F.startswith(body, F.lit("0")).cast("string"))).otherwise(F.col("kind"))).withColumn("room", room)
    placed = scratch.table(placed, "formats")
    full = placed.groupBy("format").agg(F.count("*").alias("n"), F.min("room").alias("room")).filter(F.log2(F.col("n") * LEAST_ROOM) > F.col("room"))
    return placed.join(full.select("format"), "format", "left_anti").select("kind", "canon")


def _exceptions(entities: DataFrame, settings: Settings) -> DataFrame | None:
    """(kind, canon, attempt > 0) of entities whose first surrogate is taken or is a real entity; None if there are none.

    entities: distinct (kind, canon). Phones are compared by the digits that are
    written, names by their words, whatever their gender. Formats with room are
    at most a quarter real, and names and mail addresses grow, so the rounds end.
    """
    group = F.when(F.col("kind").rlike("^(?:given-|surname)"), F.lit("name")).otherwise(F.col("kind"))
    real = entities.select(group.alias("group"), _written(F.col("kind"), F.col("canon")).alias("s")).distinct()
    open_, settled, moved = _with_room(entities), None, None
    for attempt in count():
        drawn = open_.withColumn("attempt", F.lit(attempt)).withColumn("group", group)
        drawn = scratch.table(drawn.withColumn("s", _written(F.col("kind"), surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), settings))), "drawn")
        first = drawn.groupBy("group", "s").agg(F.min(F.struct("kind", "canon")).alias("first"))
        taken = real if settled is None else real.union(settled)
        free = first.join(taken, ["group", "s"], "left_anti").select("group", "s", "first.kind", "first.canon")
        free = scratch.table(free, "free")
        won = drawn.join(free, ["group", "s", "kind", "canon"], "left_semi")
        open_ = scratch.table(drawn.join(free, ["group", "s", "kind", "canon"], "left_anti").select("kind", "canon"), "open")
        if attempt:
            moved = won if moved is None else moved.union(won)
        if open_.isEmpty():
            break
        settled = free.select("group", "s") if settled is None else settled.union(free.select("group", "s"))
        if attempt > 200:
            raise RuntimeError("surrogates keep colliding")
    return None if moved is None else scratch.table(moved.select("kind", "canon", "attempt"), "exceptions")


def replace_entities(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities: how many mentions were replaced.

    Texts without entities, null and empty ones too, stay as they are, with 0.
    Within one input, distinct entities have distinct surrogates that are no real
    entities, and each entity has the same one everywhere. Where a format of
    numbers has fewer than four forms for each of its entities, they still get
    distinct surrogates of that format, but these may be other real ones.
    Repeated rows are replaced alike, long texts whole. Other columns stay; a
    column n_entities of ``docs`` is replaced. No rows in, no rows out.
    """
    found = scratch.table(_with_mentions(docs), "mentions")
    keys = found.select("_row", F.explode("mentions").alias("m")).select("_row", F.explode("m.keys").alias("k")).select("_row", "k.kind", "k.canon")
    entities = scratch.table(keys.select("kind", "canon").distinct(), "entities")
    parts = -(-entities.count() // DRAWN_TOGETHER)
    exceptions = _exceptions(entities.repartition(max(1, parts), "kind", "canon"), settings)
    if exceptions is None:
        found = found.withColumn("moved", F.lit(None).cast("map<string,int>"))
    else:
        small = exceptions.limit(BROADCAST_EXCEPTIONS + 1).count() <= BROADCAST_EXCEPTIONS
        held = keys.join(F.broadcast(exceptions) if small else exceptions, ["kind", "canon"]).select("_row", F.concat_ws("|", "kind", "canon").alias("n"), "attempt").distinct()
        maps = scratch.table(held.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("n", "attempt"))).alias("moved")), "moved")
        few = maps.limit(BROADCAST_EXCEPTIONS + 1).count() <= BROADCAST_EXCEPTIONS
        found = found.join(F.broadcast(maps) if few else maps, "_row", "left")

    def new(key: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("moved", F.concat_ws("|", key["kind"], key["canon"])), F.lit(0))
        return surrogate(key["kind"], key["canon"], attempt, settings)

    shown = F.transform("mentions", lambda m: _once(F.transform(m["keys"], new), lambda n: _rendered(m, n)))
    text = F.when(F.col("gaps").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with("gaps", shown, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), ""))
    names = [c for c in docs.columns if c not in ("text", "n_entities")]
    out = {c: F.col("rest").getField(f"c{i}") for i, c in enumerate(names)} | {"text": text}
    order = [c for c in docs.columns if c != "n_entities"]
    return found.select(*(out[c].alias(c) for c in order), F.coalesce(F.size("mentions"), F.lit(0)).cast("long").alias("n_entities"))
