import datetime
import re

import pytest

from quern.llm.pii import pseudonymised


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


@pytest.fixture(scope="module")
def changed(spark):
    rows = {
        1: "write to bob.k-9@mail8.example.com today",
        2: "again bob.k-9@mail8.example.com!",
        3: "cards 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111112",
        4: "call +1 (988) 555-2485 or 988-555-2485",
        5: "host 70.123.182.155, version 2.0.1 and 300.1.2.3",
        6: "ssn 123-45-6789, not 000-11-2222 nor 666-12-1234",
        7: "iban DE89 3704 0044 0532 0130 00, bad DE88 3704 0044 0532 0130 00",
        8: "on 2001-02-03, 2001/02/03, 03.02.2001, 03/02/2001; 12/25/1999; not 31.02.2001, 1600-01-01",
        9: None,
        10: "",
        11: "clean text, 3.14 and 12:30 with $% é 中",
        12: "x " * 20_000 + "a1@b.co" + " y" * 20_000,
        13: "a@b.co c@d.co\n10.0.0.1",
    }
    docs = spark.createDataFrame(list(rows.items()) + [(1, rows[1])], "doc_id long, text string").withColumn("pseudonyms", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("mine"))
    out = pseudonymised(docs).collect()
    assert len(out) == 14 and out[0].asDict().keys() == {"doc_id", "text", "pseudonyms"}
    return rows, {r.doc_id: r for r in out}


def test_formats_stay_and_values_change(changed):
    rows, got = changed
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for k in (1, 2, 3, 4, 6, 7, 8, 12, 13):
        if k not in (13,):
            assert shape(got[k].text) == shape(rows[k])
        assert got[k].text != rows[k]
    assert got[9].text is None and got[9].pseudonyms == 0
    assert got[10].text == "" and got[11].text == rows[11] and got[11].pseudonyms == 0


def test_equal_values_stay_linked(changed):
    _, got = changed
    assert got[1].text.split()[2] == got[2].text.split()[1].rstrip("!")
    a, b = re.findall(r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", got[3].text)
    assert re.sub("[^0-9]", "", a) == re.sub("[^0-9]", "", b) != "4111111111111111" and luhn(re.sub("[^0-9]", "", a)) % 10 == 0
    tel = [re.sub("[^0-9]", "", x)[-10:] for x in re.findall(r"[0-9(][0-9() -]+[0-9]", got[4].text.replace("+1 ", ""))]
    assert len(set(tel)) == 1


def test_what_does_not_validate_stays(changed):
    _, got = changed
    assert "4111111111111112" in got[3].text and "version 2.0.1 and 300.1.2.3" in got[5].text
    assert "000-11-2222" in got[6].text and "666-12-1234" in got[6].text and "DE88 3704 0044 0532 0130 00" in got[7].text
    assert "31.02.2001" in got[8].text and "1600-01-01" in got[8].text


def test_pseudonyms_validate(changed):
    _, got = changed
    iban = re.search(r"iban ([A-Z0-9 ]+),", got[7].text)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    ip = got[5].text.split()[1].rstrip(",")
    assert all(0 <= int(x) <= 255 for x in ip.split("."))
    iso, slash, dotted, day_first, month_first = re.findall(r"[0-9]+[-/.][0-9]+[-/.][0-9]+", got[8].text)[:5]
    d = datetime.date.fromisoformat(iso)
    assert (slash, dotted, day_first) == (f"{d:%Y/%m/%d}", f"{d:%d.%m.%Y}", f"{d:%d/%m/%Y}")
    assert datetime.datetime.strptime(month_first, "%m/%d/%Y").day > 12


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    from quern.llm.pii import permuted, permuted_text

    got = spark.range(898).select(permuted(F.col("id"), 31, 29, "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == sorted(set(r.x for r in got)) and min(r.x for r in got) >= 0
    whole = spark.range(31 * 29).select(permuted(F.col("id"), 31, 29, "k", "t").alias("x")).collect()
    assert sorted(r.x for r in whole) == list(range(31 * 29))
    text = spark.range(1000).select(permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in text) == [f"{i:03d}" for i in range(1000)]
    letters = spark.range(26).select(permuted_text(F.char(F.col("id") + 97), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in letters) == [chr(97 + i) for i in range(26)] and len({(ord(r.x) - 97 - i) % 26 for i, r in enumerate(letters)}) > 3


def test_another_key_gives_others(spark):
    docs = spark.createDataFrame([(1, "mail robert.smith@b.co")], "doc_id long, text string")
    assert pseudonymised(docs, "k1").first().text != pseudonymised(docs, "k2").first().text
    assert pseudonymised(docs.limit(0)).count() == 0


def test_valid_numbers_beside_other_digits_and_capitals(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = [card, f"{card} 12/27", f"{card} 123", "2 4111111111111111", iban, f"{iban} BIC COBADEFF", "DE89370400440532013000 EUR 50", "4111 1111 1111 1112 123"]
    got = [r.text for r in pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] != card and got[1:4] == [f"{got[0]} 12/27", f"{got[0]} 123", "2 " + got[0].replace(" ", "")]
    assert got[4] != iban and got[5:7] == [f"{got[4]} BIC COBADEFF", got[4].replace(" ", "") + " EUR 50"]
    assert got[7] == texts[7]


def texts(spark, *given):
    return [r.text for r in pseudonymised(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_links_across_written_forms(spark):
    digits = lambda t: re.sub("[^0-9]", "", t)
    tel = texts(spark, "+1 212 555 0100", "+12125550100", "(212) 555-0100", "212.555.0100", "1 212 555 0100", "+44 20 7946 0958", "+442079460958")
    assert len({digits(t)[-10:] for t in tel[:4]}) == 1 and digits(tel[0])[-10:] != "2125550100" and digits(tel[0])[0] == digits(tel[1])[0] == "1"
    assert digits(tel[5]) == digits(tel[6]) != "442079460958"
    mail = texts(spark, "Bob.Smith@x.com", "bob.smith@x.com", "bob.smith@X.com", "bob.smith@y.com", "a@x.com", "b@x.com", "a@b.co.", "q@r.de7")
    assert mail[0].lower() == mail[1] == mail[2].lower() != mail[3].replace("@y", "@x") and mail[0][0].isupper()
    assert mail[6].endswith("@b.co.") and mail[7].endswith("@r.de7") and mail[4] != mail[5]


def test_worst_texts_end_soon(spark):
    n = 100_000
    worst = ["x@" + "a." * n, "x" * n + "@a.com", "x@" + "a" * n + ".com", "a@" * n, "AB12 " * (n // 5), "AB12" * (n // 4), "1 " * (n // 2), "1" * n, "+1" * (n // 2), "+4 1" * (n // 4)]
    worst += ["1." * n, "1-" * n, "2001-01-" * (n // 8), "(123) " * (n // 6), "123-" * (n // 4), "." * n, "-" * n, "a@b.co " * (n // 70)]
    got = texts(spark, *worst)
    assert [len(t) for t in got] == [len(t) for t in worst]
    assert got[0] == worst[0]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail robert@b.co", "mine", "ours")], "doc_id long, text string, found string, made string").selectExpr("*", "'x' AS _found", "'y' AS _made")
    r = pseudonymised(docs).first()
    assert (r.found, r.made, r._found, r._made, r.pseudonyms) == ("mine", "ours", "x", "y", 1) and r.text != "mail robert@b.co"


def feistel(text, key, tag):
    """The permutation again, in plain Python."""
    import hashlib

    digest = lambda *parts: hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()
    kind = lambda c: (48, 10) if c.isdigit() else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else None
    if len(text) == 1:
        first, size = kind(text)
        return chr(first + sorted(range(size), key=lambda i: digest(key, tag, "one", i))[ord(text) - first])
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def moved(half, other, r):
        h, out = digest(key, tag, r, other.lower()), ""
        for i, c in enumerate(half):
            k = kind(c)
            out += chr(k[0] + (ord(c) - k[0] + int(h[2 * (i % 32) : 2 * (i % 32) + 2], 16)) % k[1]) if k else c
        return out

    for r in range(1, 9):
        if r % 2:
            a = moved(a, b, r)
        else:
            b = moved(b, a, r)
    return a + b


def test_plain_python_gives_the_same(spark):
    """Mail addresses, telephone and card numbers of random texts, found and replaced by a second implementation."""
    import random

    rng = random.Random(4)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c) % 10 == 0)

    def mail(m):
        name, domain = m[0].split("@")
        return feistel(name, "quern", f"email {domain.lower()}") + "@" + domain

    def number(m):
        d = re.sub("[^0-9]", "", m[0])
        if m[0][0] == "4" and len(d) == 16:
            body = d[0] + feistel(d[1:-1], "quern", "card")
            d = body + str(-luhn(body + "0") % 10)
        else:
            k = 2 if m[0][0] == "+" else 0
            d = d[:k] + feistel(d[k:], "quern", "phone")
        new = iter(d)
        return re.sub("[0-9]", lambda _: next(new), m[0])

    given, want = [], []
    for _ in range(60):
        name = "".join(rng.choice("abcXYZ019._-") for _ in range(rng.randint(1, 12))).strip("._-") or "q"
        parts = [f"{name}@{rng.choice(['Mail', 'a-b', 'x'])}.example.{rng.choice(['com', 'de'])}", card(), f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"+49 30 {rng.randint(100000, 999999)}"]
        rng.shuffle(parts)
        t = " and ".join(parts)
        given.append(t)
        t = re.sub("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", mail, t)
        want.append(re.sub(r"(?<![\w.@+-])(?:\+49 30 [0-9]{6}|\([0-9]{3}\) 555-[0-9]{4}|4[0-9]{15})(?![\w@-])", number, t))
    assert texts(spark, *given) == want
