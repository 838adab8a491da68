import random
import re
import time
from datetime import date

from pyspark.sql import functions as F

from ondula.llm import pii

KEY = "key"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def one(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [(p.kind, p.value) for p in r.pii]) for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_and_validity(spark):
    values = {"email": "Anna.b-7@mail.example.com", "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789", "ip": "203.0.113.77",
              "phone": "+1 (743) 555-3824", "card": "4111 1111 1111 1111"}
    for kind, value in values.items():
        (text, found), = one(spark, [f"x: {value}, y"])
        assert [k for k, _ in found] == [kind] and text == f"x: {found[0][1]}, y"
        new = found[0][1]
        assert new != value and len(new) == len(value) or kind == "ip"
        shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        assert kind == "ip" or shape(new) == shape(value)
    assert luhn(one(spark, ["4111-1111-1111-1111"])[0][0])
    assert iban(one(spark, ["DE89370400440532013000"])[0][0])
    assert all(0 <= int(o) <= 255 for o in one(spark, ["1.2.3.4"])[0][0].split("."))
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", one(spark, ["2001-02-28"])[0][0]) and date.fromisoformat(one(spark, ["2001-02-28"])[0][0])


def test_equal_values_stay_linked_however_written(spark):
    a, b, c, d, e = one(spark, ["4111111111111111", "4111-1111-1111-1111", "28.02.2001", "2001-02-28", "28/2/2001"])
    assert re.sub(r"\D", "", b[0]) == a[0]
    assert d[0] == "-".join(reversed(c[0].split("."))) == "-".join(reversed(e[0].split("/")))
    assert one(spark, ["4111111111111111"], "other key")[0][0] != a[0]


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "300.1.1.1", "2001-02-30", "000-12-3456", "DE88370400440532013000", "version 1.2.3", "12 345", "no data", "a@b"]
    assert [t for t, _ in one(spark, texts)] == texts


def test_values_beside_other_characters(spark):
    card, account = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [(f"{card} 12/27", card, "card"), (f"{card} 123", card, "card"), (f"2 {card}", card, "card"), (f"12 34 56 {card}", card, "card"), (f"CARD:{card} EXP", card, "card"),
             (f"{account} EUR", account, "iban"), (f"IBAN:{account} 12 EUR", account, "iban"), (f"{account} PAID 2 TIMES", account, "iban"),
             ("DOB:1990-01-01", "1990-01-01", "date"), ("2001-02-28T10:00", "2001-02-28", "date"), ("AT 7:28.02.2001", None, None),
             ("SSN:123-45-6789 US", "123-45-6789", "ssn"), ("IP:203.0.113.77 UP", "203.0.113.77", "ip"), ("TEL:743-555-3824 12", "743-555-3824", "phone"),
             ("MAIL:anna@mail.example.com 12", "anna@mail.example.com", "email")]
    for (text, value, kind), (new, found) in zip(cases, one(spark, [c[0] for c in cases])):
        assert [k for k, _ in found] == ([kind] if kind else []), text
        assert new == (text.replace(value, found[0][1]) if kind else text) and (value is None or value not in new)
    both, = one(spark, [f"{account} AAAA {card} 2001-02-28"])
    assert [k for k, _ in both[1]] == ["iban", "card", "date"] and luhn(both[1][1][1]) and iban(both[1][0][1])


def test_feistel_is_a_permutation(spark):
    df = spark.range(17 * 41).select(F.array((F.col("id") % 17).cast("int"), F.floor(F.col("id") / 17).cast("int")).alias("v"))
    ranges = F.array(F.lit(17), F.lit(41))
    out = df.withColumn("w", pii.feistel(F.col("v"), ranges, KEY, "t")).withColumn("b", pii.feistel(F.col("w"), ranges, KEY, "t", back=True))
    rows = out.collect()
    assert len({tuple(r.w) for r in rows}) == 17 * 41
    assert all(r.b == r.v and 0 <= r.w[0] < 17 and 0 <= r.w[1] < 41 for r in rows)
    assert sum(r.v == r.w for r in rows) < 20
    word = spark.sql("SELECT 'Ab9z' AS s")
    assert word.select(pii.permuted(pii.permuted(F.col("s"), KEY, "e"), KEY, "e", back=True)).first()[0] == "Ab9z"


def test_edges(spark):
    long = "text 192.168.0.1 " * 8000
    df = spark.createDataFrame([(1, None, "p"), (1, "", "p"), (None, long, "p"), (2, long, "p")], "doc_id long, text string, pii string")
    rows = pii.pseudonymise(df, KEY).collect()
    assert [r.text for r in rows[:2]] == [None, ""] and [len(r.pii) for r in rows] == [0, 0, 8000, 8000]
    assert rows[2].text == rows[3].text and "192.168.0.1" not in rows[2].text
    assert pii.pseudonymise(df.where("false"), KEY).count() == 0
    plan = pii.pseudonymise(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def greedy(run):
    """The cards in words of digits (none of three or six, which could be a phone number), by trying at each word the longest text that ends with a word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", run)]
    out, free = [], 0
    for a, _ in words:
        if a < free:
            continue
        for b in sorted((b for _, b in words if a < b <= a + pii.LONGEST), reverse=True):
            if re.fullmatch(pii.PATTERNS["card"], run[a:b]) and luhn(run[a:b]):
                out.append((a, b))
                free = b
                break
    return out


def test_values_in_long_runs_equal_plain_search(spark):
    rng = random.Random(5)
    cards = ["4111 1111 1111 1111", "5500 0055 5555 5559", "340000000000009", "6011-0009-9013-9424"]
    runs = []
    for _ in range(12):
        parts = [rng.choice(cards) if rng.random() < 0.2 else str(rng.randrange(10 ** (n := rng.choice([1, 2, 5, 7, 8])) // 10, 10 ** n)) for _ in range(150)]
        if rng.random() < 0.5:
            parts[70] = "7" * 120
        runs.append(" ".join(parts))
    for run, (text, found) in zip(runs, one(spark, [f"n: {r}, end" for r in runs])):
        want = greedy(run)
        assert len(found) == len(want) > 15 and {k for k, _ in found} == {"card"}
        rest, at = "", 0
        for (a, b), (_, new) in zip(want, found):
            rest += run[at:a] + new
            at = b
        assert text == f"n: {rest}{run[at:]}, end"


def test_time_grows_with_the_length(spark):
    blanks = " ".join(str(k % 97) for k in range(60_000))
    solid, upper = "12" * 500_000, "AB12 " * 30_000
    start = time.time()
    out = one(spark, [blanks, solid, upper])
    assert time.time() - start < 120
    assert out[1] == (solid, []) and len(out[0][0]) == len(blanks) and len(out[2][0]) == len(upper)
