import hashlib
import math
import random
import re

import regex

from lodestar.llm import surrogates
from lodestar.llm.surrogates import Settings, replace_entities


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, entity string")
    rows = sorted(replace_entities(df, Settings(**more)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(texts))) and all(r.entity == "x" for r in rows)
    return [r.text for r in rows], [r.n_entities for r in rows]


def test_kinds_and_formats(spark):
    texts = [
        "Mail Jane.Doe34@mail7.example.com now.", "JANE.DOE34@MAIL7.EXAMPLE.COM!!", "other@mail7.example.com", "call +1 (743) 555-3824, or +1-743-555-3824.",
        "card 4539578763621486 and 4539-5787-6362-1486", "ip 97.51.17.173 x", "DE44 5001 0517 5407 3249 31.", "123-45-6789", "Dear Mrs. Anna Smith, dear Mr Bond", "госпожа Анна Иванова", None, "", "no data: version 3.1, 12 34, a@b", "plain",
    ]
    new, n = run(spark, texts)
    assert n == [1, 1, 1, 2, 2, 1, 1, 1, 2, 1, 0, 0, 0, 0]
    assert new[10:] == texts[10:]
    mail = re.fullmatch(r"Mail ([A-Z][a-z]{3}\.[A-Z]?[a-z]{2,3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com) now\.", new[0], re.I)
    assert mail and mail[1] != "Jane.Doe34@mail7.example.com"
    assert new[1] == mail[1].upper() + "!!"
    assert new[2].split("@")[1] == mail[1].split("@")[1]
    phone = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), or (\+1-\d{3}-\d{3}-\d{4})\.", new[3])
    assert re.sub(r"\D", "", phone[1]) == re.sub(r"\D", "", phone[2]) != "17435553824"
    card = re.fullmatch(r"card (4\d{15}) and (4\d{3}-\d{4}-\d{4}-\d{4})", new[4])
    assert card[1] == card[2].replace("-", "") != "4539578763621486"
    digits = [int(c) for c in card[1][::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3} x", new[5]) and new[5] != texts[5]
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d\.", new[6]) and new[6] != texts[6]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", new[7]) and new[7] != texts[7]
    assert re.fullmatch(r"Dear Mrs\. [A-Z][a-z]+na [A-Z][a-z]+, dear Mr [A-Z][a-z]+", new[8]) and "Smith" not in new[8]
    assert re.fullmatch(r"госпожа [А-Я][а-я]+на [А-Я][а-я]+", new[9])


def test_each_kind_alone(spark):
    texts = [
        "mail a@b.org", "ip 1.2.3.4", "iban MT84MALTABCDEFGH", "iban GB82 WEST AB12 CD34 x", "card 4539-5787-6362-1486", "ssn 123-45-6789", "Herr Otto",
        "+33 1 23 45 67 89", "+45 12 34 56 78", "(743) 555-3824", "743.555.3824",
    ]
    new, n = run(spark, [*texts, "+33 1 23 45 67 89 and 1234"])
    assert n == [1] * 12 and not set(new) & set(texts)
    assert new[-1] == new[7] + " and 1234"


def test_distinct_under_collisions(spark):
    texts = [f"{a}@x.com {a}@x.com {a}{a}@x.com" for a in "abcdefghijklmnopqrstuvwxyz"]
    new, n = run(spark, texts, longer_after=1)
    assert n == [3] * 26
    rows = [t.split() for t in new]
    assert all(r[0] == r[1] for r in rows)
    used = [r[0] for r in rows] + [r[2] for r in rows]
    real = {w for t in texts for w in t.split()}
    assert len(set(used)) == 52 and not set(used) & real
    assert run(spark, texts, longer_after=1)[0] == new
    assert run(spark, texts, longer_after=1, key="other")[0] != new


def test_phones_distinct_as_written(spark):
    texts = [f"+44 {i:04d} 22" for i in range(3000)]
    new, n = run(spark, texts)
    assert n == [1] * 3000 and all(re.fullmatch(r"\+44 \d{4} \d\d", t) for t in new)
    assert len(set(new)) == 3000 and not set(new) & set(texts)
    texts = ["+17435553824", "+1 743 555 3824", "(743) 555-3824", "+33123456789", "+33 1 23 45 67 89", "+352 12 34 56"]
    new, n = run(spark, texts)
    digits = [re.sub(r"\D", "", t) for t in new]
    assert n == [1] * 6 and not set(new) & set(texts)
    assert digits[0] == digits[1] and digits[3] == digits[4] and new[0].startswith("+1") and new[3].startswith("+33") and new[5].startswith("+352 ")


def test_repeated_long_and_empty(spark):
    text = "x " * 50_000 + " ".join(f"u{i}@host.org" for i in range(300))
    new, n = run(spark, [text, text])
    assert n == [300, 300] and new[0] == new[1] and new[0].startswith("x " * 50_000) and "u7@host.org" not in new[0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert replace_entities(empty).collect() == []


# a plain version, entity by entity

CLASSES = surrogates.CLASSES
digest = lambda *x: hashlib.sha512("|".join(x).encode()).hexdigest()
units = lambda t: [int.from_bytes(t.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(t), 2)]


def letters(u, i):
    return next(((a, b - a + 1) for a, b in CLASSES if a <= u <= b), (0, 0))


def digits(u, i):
    return (49, 9) if i == 0 and 49 <= u <= 57 else next(((a, b - a + 1) for a, b in CLASSES[:2] if a <= u <= b), (0, 0))


def hexes(u, i):
    return (48, 10) if 48 <= u <= 57 else (97, 6) if 97 <= u <= 102 else (0, 0)


def octets(u, i):
    return (0, 256) if i else (1, 223) if 1 <= u <= 223 else (1, 0)


def permuted(values, bounds, key):
    values = list(values)
    for r in range(6):
        d = digest(key, str(r), ",".join("" if i % 2 == r % 2 else str(u) for i, u in enumerate(values)))
        for i, u in enumerate(values):
            low, size = bounds(u, i)
            if i % 2 == r % 2 and size:
                values[i] = low + (u - low + int(d[i // 2 % 32 * 4 :][:4], 16)) % size
    return values


def other(text, bounds, key):
    return b"".join(u.to_bytes(2, "big") for u in permuted(units(text), bounds, key)).decode("utf-16-be")


def luhn(text):
    total = sum((2 * d - 9 if d > 4 else 2 * d) if k % 2 == 0 else d for k, d in enumerate(map(int, text[::-1])))
    return -total % 10


def iban_check(country, body):
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def parts(kind, canon):
    code = re.match(surrogates.COUNTRY, canon)
    n = {"phone": 1 if canon.startswith("0") else len(code[0]) if code else 0, "iban": 2, "card": 2 if len(canon) == 15 else 1}.get(kind, 0)
    return canon[:n], canon[4:] if kind == "iban" else canon[n:-1] if kind == "card" else canon[n:]


def drawn(kind, canon, attempt, key="lodestar", longer_after=4):
    k = f"{key}|{kind}|{attempt}"
    longer = max(0, attempt - longer_after)
    front, body = parts(kind, canon)
    if kind == "email":
        local, domain = canon.split("@")
        name, _, top = domain.rpartition(".")
        more = hashlib.sha256(f"{k}|{canon}".encode()).hexdigest()[: longer * 2]
        return other(local, letters, k) + more + "@" + other(name, letters, f"{key}|domain") + "." + top
    if kind == "ip":
        return ".".join(map(str, permuted(map(int, canon.split(".")), octets, k)))
    if kind == "ip6":
        return other(canon, hexes, k)
    if kind in ("phone", "ssn", "card", "iban"):
        new = other(body, digits, f"{k}|{front}")
        if kind == "card":
            return front + new + str((luhn(front + new) + int(canon[-1]) - luhn(front + body)) % 10)
        if kind == "iban":
            return front + (iban_check(front, new) if canon[2:4] == iban_check(front, body) else other(canon[2:4], letters, f"{k}|check")) + new
        return front + new
    d = digest(k, canon)
    script = "cyrillic" if regex.match(r"\p{IsCyrillic}", canon) else "greek" if regex.match(r"\p{IsGreek}", canon) else "latin"
    consonants, vowels, female, male = surrogates.SYLLABLES[script]
    at = lambda alphabet, j: alphabet[int(d[j % 64 * 2 :][:2], 16) % len(alphabet)]
    return "".join(at(consonants, 2 * j) + at(vowels, 2 * j + 1) for j in range(3 + 2 * longer)) + {"given-f": female, "given-m": male}.get(kind, "")


def mentions(text):
    """(start, end, kind, keys) in order."""
    flags = regex.UNICODE
    found = []
    for m in regex.finditer(surrogates.ANY, text, flags) if text and regex.search(surrogates.HINT, text, flags) else ():
        kind = next((k for k in ("email", "ip", "ip6", "iban", "card", "ssn", "phone") if regex.fullmatch(surrogates.PATTERNS[k], m[0], flags)), "name")
        before = text[found[-1][1] if found else 0 : m.start()]
        female, male = (regex.search(rf"(?<!\p{{L}})(?:{t})\.? (?:(?:{surrogates.NEUTRAL})\.? )*$", before) for t in (surrogates.FEMALE, surrogates.MALE))
        found.append((m.start(), m.end(), kind, "f" if female else "m" if male else "n"))
    known = {}
    for a, b, kind, gender in found:
        if kind == "name":
            for name in (text[a:b], text[a:b].split(" ")[-1]):
                if len(name) > 2:
                    known.setdefault(name, gender)
    if known:
        again = r"(?<![\p{L}\p{N}'’-])(?:" + "|".join(sorted(known, key=len, reverse=True)) + r")(?![\p{L}\p{N}]|['’-]\p{L})"
        ends = [0, *(b for _, b, *_ in found)]
        for low, high in zip(ends, [*(a for a, *_ in found), len(text)], strict=True):
            found += [(low + m.start(), low + m.end(), "name", known[m[0]]) for m in regex.finditer(again, text[low:high])]
    out = []
    for a, b, kind, gender in sorted(found):
        e = text[a:b]
        number = re.sub(r"\D", "", e)
        if kind == "name":
            words = e.split(" ")
            keys = [("surname" if i == len(words) - 1 else f"given-{gender}", w.lower()) for i, w in enumerate(words)]
        elif kind == "phone":
            keys = [(kind, ("+" if e[0] == "+" else "+1" if re.match(r"\(|\d{3}[.-]\d{3}[.-]", e) else "") + number)]
        else:
            keys = [(kind, number if kind in ("ssn", "card") else e.lower() if kind in ("email", "ip6") else e.replace(" ", "") if kind == "iban" else e)]
        out.append((a, b, kind, keys))
    return out


def attempts(entities, **more):
    group = lambda k: "name" if k.startswith(("given", "surname")) else k
    written = lambda k, s: (group(k), s.replace("+", "") if k == "phone" else s)
    formats = {}
    for kind, canon in entities:
        if kind in ("phone", "ssn", "card", "iban", "ip6"):
            front, body = parts(kind, canon)
            shape = re.sub("[a-f]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", body)))
            formats.setdefault((kind, front, shape, body[:1] == "0"), []).append((kind, canon))
    tight = set()
    for (kind, *_), own in formats.items():
        forms = min(math.prod(max(1, (hexes if kind == "ip6" else digits)(u, i)[1]) for i, u in enumerate(units(parts(*e)[1]))) for e in own)
        tight |= set(own) if len(own) * 4 > forms else set()
    real, settled, chosen, left, attempt = {written(*e) for e in entities}, set(), dict.fromkeys(entities, 0), set(entities) - tight, 0
    while left:
        new = {}
        for e in sorted(left):
            s = written(e[0], drawn(*e, attempt, **more))
            if s not in real and s not in settled:
                new.setdefault(s, e)
        for e in new.values():
            chosen[e] = attempt
        settled |= set(new)
        left -= set(new.values())
        attempt += 1
    return chosen


def filled(entity, new, slot):
    at = len(new) - sum(map(slot, entity))
    out = ""
    for c in entity:
        out += new[at] if slot(c) else c
        at += slot(c)
    return out


def rendered(entity, kind, new):
    shouted = lambda e: e.upper() == e != e.lower() and len(e) > 1
    if kind == "name":
        return " ".join(n.upper() if shouted(w) else n[0].upper() + n[1:] for n, w in zip(new, entity.split(" "), strict=True))
    if kind in ("phone", "ssn", "card"):
        return filled(entity, new[0].replace("+", ""), lambda c: "0" <= c <= "9")
    if kind == "iban":
        return filled(entity, new[0], lambda c: c != " ")
    if kind in ("email", "ip6"):
        return new[0].upper() if shouted(entity) else "".join(a.upper() if b != b.lower() else a for a, b in zip(new[0], entity, strict=True)) if len(entity) == len(new[0]) else new[0]
    return new[0]


def plain(texts, **more):
    found = [mentions(t) for t in texts]
    chosen = attempts({k for own in found for *_, keys in own for k in keys}, **more)
    out = []
    for text, own in zip(texts, found, strict=True):
        new, at = "", 0
        for a, b, kind, keys in own:
            new += text[at:a] + rendered(text[a:b], kind, [drawn(*k, chosen[k], **more) for k in keys])
            at = b
        out.append(text if text is None else new + text[at:])
    return out, [len(own) for own in found]


def test_against_a_plain_version(spark):
    rng = random.Random(9)
    words = ["the", "Smith", "John", "and", "Königin", "12:30:45", "v1.2", "std::map", "😀", "2024-05-01", "Анна", "x\ue000y", "№", "O’Neil", "Smithson", "Miller-Smith"]
    entities = [
        "Mr John Smith", "Mrs. Anna Smith", "Dr. John Smith", "Herr Dr. Müller", "Prof O’Neil", "госпожа Анна Иванова", "Mrs MARY JONES", "a@x.de", "Jo.B7@x.de", "王伟@mail.com", "иван@пример.рф", "ÉLAN@ÖST.ORG", "7@1.io", "10.0.0.1", "250.1.2.3",
        "2001:db8::ff00:42", "FE80:0:0:0:1:2:3:4", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "XX00AAAABBBBCCCC", "4539578763621486", "4539-5787-6362-1487", "3782 822463 10005", "378282246310006", "123-45-6789", "012-00-0000",
        "+1 555-123-4567", "555-123-4567", "(555) 123-4567", "+49 30 1234 567", "0151 23456789", "01 23 45 67 89", "030/1234567", "+352 12 34 56", "+44 0001 22",
    ]
    texts = [" ".join(rng.choice([rng.choice(words), rng.choice(entities)]) + rng.choice(["", ",", ".", " "]) for _ in range(rng.randrange(14))) for _ in range(120)]
    texts += [None, "", "Mr John Smith came. John Smith left; Mrs Smith and Smith met JOHN. Smithson stayed, Smith's too.", *(f"{c}@x.de and +44 000{i} 2{i}" for i, c in enumerate("abcdefghij"))]
    assert run(spark, texts) == plain(texts)
    assert run(spark, texts[-40:], key="k", longer_after=0) == plain(texts[-40:], key="k", longer_after=0)


def test_coreference_and_formats(spark):
    texts = [
        "Mr John Smith came. John Smith left; later Smith wrote.", "Mrs Smith and Mr Smith", "Dr. John Smith", "0151 23456789", "2001:db8::1", "3782 822463 10005", "иван@пример.рф", "王伟@mail.com",
        "+1 555-123-4567", "555-123-4567", "GB29 NWBK 6016 1331 9268 19", "Sr Smithson",
    ]
    new, n = run(spark, texts)
    assert n == [3, 2, 1, *[1] * 9]
    first = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) (\w+) left; later (\w+) wrote\.", new[0])
    assert first[1] == first[3] != "John" and first[2] == first[4] == first[5] != "Smith"
    assert new[1] == f"Mrs {first[2]} and Mr {first[2]}" and new[2].endswith(f" {first[2]}") and new[11] != f"Sr {first[2]}"
    assert re.fullmatch(r"0\d{3} \d{8}", new[3]) and re.fullmatch(r"\d{4}:[a-f]{2}\d::\d", new[4]) and re.fullmatch(r"37\d\d \d{6} \d{5}", new[5])
    assert luhn(re.sub(r"\D", "", new[5])[:-1]) == int(new[5][-1])
    assert re.fullmatch(r"[а-я]{4}@[а-я]{6}\.рф", new[6]) and re.fullmatch(r"[一-鿿]{2}@[a-z]{4}\.com", new[7])
    assert new[8] == f"+1 {new[9]}" and not set(new) & set(texts)
    whole = new[10].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1 and whole.startswith("GB")


def test_full_formats_keep_distinct_surrogates(spark):
    """All forms of a format occur: no surrogate can be free, but none is used twice."""
    texts = [f"+352 {i // 10000:02d} {i // 100 % 100:02d} {i % 100:02d}" for i in range(0, 1000000, 250)]
    new, n = run(spark, texts)
    assert n == [1] * 4000 and len(set(new)) == 4000


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select(F.array((F.floor(F.col("id") / 100) + 48 - 0).cast("int"), (F.floor(F.col("id") / 10) % 10 + 48).cast("int"), (F.col("id") % 10 + 48).cast("int")).alias("u"))
    df = df.filter("u[0] < 58")
    for bounds in (surrogates._letters, surrogates._octets):
        rows = [tuple(r.p) for r in df.select(surrogates.permuted(F.col("u"), bounds, F.lit("k")).alias("p")).collect()]
        assert len(rows) == 1000 == len(set(rows))


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "a@b.org", 7, "x"), (1, "a@b.org", 7, "x"), (None, "a@b.org", None, "y")], "doc_id long, text string, n_entities int, mentions string")
    rows = replace_entities(df).collect()
    assert replace_entities(df).columns == ["doc_id", "text", "mentions", "n_entities"]
    assert len({r.text for r in rows}) == 1 and [r.n_entities for r in rows] == [1, 1, 1] and sorted(r.mentions for r in rows) == ["x", "x", "y"]
