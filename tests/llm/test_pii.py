import datetime
import hashlib
import re

from pyspark.sql import functions as F

from cairn.llm import pii
from tests.llm.fixtures import folder, frame, rows, with_clashes


def luhn(s):
    total = 0
    for i, ch in enumerate(reversed(s)):
        x = int(ch) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n_replaced) for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_checks_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111, 4111-1111-1111-1111 or 4111111111111111.",
        "bad card 4111111111111112",
        "born 1984-02-29, 29.02.1984, 02/29/1984; 13/02/1984; not 1983-02-29",
        "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432; bad DE88370400440532013000",
        "ssn 123-45-6789; bad 666-45-6789 and 000-12-3456",
        "ip 10.0.0.1; bad 300.1.1.1 and 1.2.3.4.5",
        "call +1 (017) 555-7713, (212) 555-0100, +1-212-555-0100 or +44 20 7946 0958",
        "mail John.Doe99@example.com or a@b.co",
        None,
        "",
    ]
    out = replaced(spark, texts)
    cards = re.findall(r"\d[\d -]{14,}\d", out[0][0])
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and out[0][1] == 3
    assert [len(c) for c in cards] == [19, 19, 16] and "4111" not in out[0][0][:9]
    assert out[1] == (texts[1], 0)
    iso, dot, mdy = re.findall(r"\d{4}-\d\d-\d\d", out[2][0])[0], re.findall(r"\d\d\.\d\d\.\d{4}", out[2][0])[0], re.findall(r"\d\d/\d\d/\d{4}", out[2][0])[0]
    day = datetime.date.fromisoformat(iso)
    assert day.strftime("%d.%m.%Y") == dot and day.strftime("%m/%d/%Y") == mdy and out[2][1] == 4 and out[2][0].endswith("1983-02-29")
    for s in re.findall(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?", out[3][0].split("bad")[0]):
        flat = s.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert out[3][1] == 2 and out[3][0].endswith("bad DE88370400440532013000")
    area, group, serial = re.search(r"(\d{3})-(\d\d)-(\d{4})", out[4][0]).groups()
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and out[4][1] == 1
    assert all(int(x) < 256 for x in re.search(r"[\d.]{7,}", out[5][0]).group().strip(".").split(".")) and out[5][1] == 1
    phones = re.findall(r"[\d]{3}\) \d{3}-\d{4}|1-\d{3}-\d{3}-\d{4}", out[6][0])
    assert out[6][1] == 4 and re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2])[1:]
    assert re.fullmatch(r"mail [A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@example\.com or [a-z]@b\.co", out[7][0]) and "John" not in out[7][0]
    assert out[8] == (None, 0) and out[9] == ("", 0)


def test_cards_within_longer_runs(spark):
    card, short = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [card, f"{card} 12/27", f"{card} 123", f"12 {card}", f"1 {card} 12 {card.replace(' ', '')} 7", f"{card} 5500 0000 0000 0004", f"{card} 123-45-6789", f"{card} 2024-02-29", short, f"{short} 1234", "4111 1111 1111 1112 123", f"{card} 212-555-0100"]
    out = replaced(spark, texts)
    new, amex = out[0][0], out[8][0]
    assert luhn(new.replace(" ", "")) and new != card and luhn(amex.replace(" ", "")) and amex != short
    assert out[1] == (f"{new} 12/27", 1) and out[2] == (f"{new} 123", 1) and out[3] == (f"12 {new}", 1)
    assert out[4] == (f"1 {new} 12 {new.replace(' ', '')} 7", 2)
    assert out[5][0].startswith(new + " ") and "5500" not in out[5][0] and out[5][1] == 2 and luhn(out[5][0][20:].replace(" ", ""))
    for i, value in ((6, "123-45-6789"), (7, "2024-02-29"), (11, "212-555-0100")):
        assert out[i][0].startswith(new + " ") and value not in out[i][0] and out[i][1] == 2
    assert out[9] == (f"{amex} 1234", 1)
    long = replaced(spark, [" ".join(["7"] * 3000) + f" {card}", "9" * 50_000])
    assert long[0][0].endswith(new) and long[1][1] == 0


def test_bare_phones(spark):
    out = replaced(spark, ["212-555-0100", "(212) 555-0100", "1-212-555-0100", "x 212-555-0100-7"])
    a, b, c = (re.sub(r"\D", "", t) for t, _ in out[:3])
    assert a == b == c[1:] and a != "2125550100" and [n for _, n in out] == [1, 1, 1, 0]


def test_long_ibans_are_permuted_whole(spark):
    tail = {"FR": "30006000011234567890189", "MT": "MALT011000012345678901234567890"[:27]}
    for land, account in tail.items():
        flat = account + land + "00"
        check = 98 - int("".join(str(int(c, 36)) for c in flat)) % 97
        text, n = replaced(spark, [f"{land}{check:02}{account}"])[0]
        assert n == 1 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1 and text[-5:] != account[-5:]
    texts = [f"{i:023}" for i in range(300)]
    ibans = [f"FR{98 - int(t + '152700') % 97:02}{t}" for t in texts]
    out = [t for t, n in replaced(spark, ibans)]
    assert len(set(out)) == 300 and len({t[22:] for t in out}) > 200


def test_permutations_are_one_to_one(spark):
    ips = [f"10.{i // 256}.{i % 256}.{i % 7}" for i in range(1500)]
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(1500)]
    ssn = [f"{i // 900 + 1:03}-{i % 90 + 1:02}-{i + 1:04}" for i in range(1500)]
    for values in (ips, days, ssn):
        out = [t for t, n in replaced(spark, values)]
        assert len(set(out)) == len(set(values)) and sum(a == b for a, b in zip(out, values)) < 5
        assert out != [t for t, n in replaced(spark, values, "other")]


def test_clean_texts_unchanged_and_native(spark):
    df = with_clashes(frame(spark))
    out = pii.pseudonymise(df, "k")
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r[0], r[1]) for r in rows()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


def feistel(key, kind, left, right, n_left, n_right):
    draw = lambda t, x: int(hashlib.sha256(f"{key}|{kind}|{t}|{x}".encode()).hexdigest()[:15], 16)
    for t in range(1, pii.ROUNDS + 1):
        if t % 2:
            right = (right + draw(t, left)) % n_right
        else:
            left = (left + draw(t, right)) % n_left
    return left, right


def test_values_equal_a_plain_feistel(spark):
    ips, days = ["10.0.0.1", "255.255.255.255", "0.0.0.0"], ["1900-01-01", "2099-12-31", "2024-02-29"]
    cards = ["4111111111111111", "378282246310005"]
    want = []
    for s in ips:
        a, b, c, d = map(int, s.split("."))
        x, y = feistel("k", "ip", a * 256 + b, c * 256 + d, 65536, 65536)
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
    first = datetime.date(1900, 1, 1)
    for s in days:
        n = (datetime.date.fromisoformat(s) - first).days
        x, y = feistel("k", "date", n // 4297, n % 4297, 17, 4297)
        want.append((first + datetime.timedelta(x * 4297 + y)).isoformat())
    for s in cards:
        h = (len(s) - 1) // 2
        x, y = feistel("k", "card", int(s[:h]), int(s[h:-1]), 10**h, 10 ** (len(s) - 1 - h))
        pay = f"{x:0{h}}{y:0{len(s) - 1 - h}}"
        want.append(pay + next(c for c in "0123456789" if luhn(pay + c)))
    assert [t for t, _ in replaced(spark, ips + days + cards)] == want


def plain_digits(kind, d):
    h = len(d) // 2
    x, y = feistel("k", kind, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{x:0{h}}{y:0{len(d) - h}}"


def refill(text, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def plain_email(name):
    left, right = name[: len(name) // 2], name[len(name) // 2 :]

    def moved(half, other, t):
        h = hashlib.sha256(f"k|email|{t}|{other}".encode()).digest()
        kinds = [("a", 26), ("A", 26), ("0", 10)]
        out = ""
        for i, c in enumerate(half):
            kind = next(((f, n) for f, n in kinds if 0 <= ord(c) - ord(f) < n), None)
            out += c if kind is None else chr(ord(kind[0]) + (ord(c) - ord(kind[0]) + h[i % 32]) % kind[1])
        return out

    for t in range(1, pii.ROUNDS + 1):
        if t % 2:
            right = moved(right, left, t)
        else:
            left = moved(left, right, t)
    return left + right


def plain_day(day, month_first):
    """The day after one step of the permutation; on along its cycle for a day that reads as dd/mm only."""
    first = datetime.date(1900, 1, 1)
    while True:
        n = (day - first).days
        x, y = feistel("k", "date", n // 4297, n % 4297, 17, 4297)
        day = first + datetime.timedelta(x * 4297 + y)
        if month_first or day.day > 12:
            return day


def test_other_kinds_equal_a_plain_feistel(spark):
    texts, want = [], []
    for s in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR7630006000011234567890189"):
        rest = refill(s[4:], plain_digits("iban", "".join(c for c in s[4:] if c.isdigit())))
        n = int("".join(str(int(c, 36)) for c in rest.replace(" ", "") + s[:2] + "00")) % 97
        texts.append(s)
        want.append(f"{s[:2]}{98 - n:02}{rest}")
    for s in ("123-45-6789", "899-99-9999", "001-01-0001", "667-01-0001"):
        area, group, serial = map(int, s.split("-"))
        x, y = feistel("k", "ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 88902, 9999)
        area = x // 99 + 1
        texts.append(s)
        want.append(f"{area + (area > 665):03}-{x % 99 + 1:02}-{y + 1:04}")
    for s, keep in (("+1 (212) 555-0100", 1), ("212-555-0100", 0), ("+44 20 7946 0958", 2)):
        d = "".join(c for c in s if c.isdigit())
        texts.append(s)
        want.append(refill(s, d[:keep] + plain_digits("phone", d[keep:])))
    for s in ("John.Doe99", "a", "x_Y-9", "q" * 64):
        texts.append(f"{s}@example.com")
        want.append(f"{plain_email(s)}@example.com")
    for s in ("13/01/1984", "31/12/2099", "29/02/2024", "02/29/2024", "03/10/1992"):
        a, b, y = map(int, s.split("/"))
        month_first = a <= 12
        day = plain_day(datetime.date(y, a, b) if month_first else datetime.date(y, b, a), month_first)
        texts.append(s)
        want.append(day.strftime("%m/%d/%Y" if month_first else "%d/%m/%Y"))
    assert [t for t, _ in replaced(spark, texts)] == want


def test_every_day_in_every_format_turns_back(spark):
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(i) for i in range(73_049)]
    assert days[-1] == datetime.date(2099, 12, 31)
    for form in ("%Y-%m-%d", "%d.%m.%Y", "slash"):
        if form == "slash":
            texts = [d.strftime("%m/%d/%Y") for d in days] + [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
        else:
            texts = [d.strftime(form) for d in days]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
        there = pii.pseudonymise(df, "k").select("doc_id", F.col("text").alias("new"), "n_replaced").cache()
        both = df.join(there, "doc_id").join(pii.pseudonymise(there.select("doc_id", F.col("new").alias("text")), "k", back=True).select("doc_id", F.col("text").alias("again")), "doc_id")
        n = both.agg(F.count("*"), F.countDistinct("new"), F.count_if(F.col("again") == F.col("text")), F.sum("n_replaced")).first()
        assert tuple(n) == (len(texts),) * 4, form
        there.unpersist()


def test_octets_with_leading_zeros_stay(spark):
    assert replaced(spark, ["ip 010.1.1.1 and 1.02.3.4"]) == [("ip 010.1.1.1 and 1.02.3.4", 0)]


def test_pseudonyms_turn_back(spark):
    texts = ["4111-1111-1111-1111", "FR7630006000011234567890189", "1984-02-29 and 31.12.2001", "ssn 123-45-6789", "ip 10.0.0.1", "+1 (212) 555-0100 or +44 20 7946 0958", "mail John.Doe99@example.com"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    there = pii.pseudonymise(df, "k")
    assert there.columns == ["doc_id", "text", "n_replaced", "kinds"] and all(a.text != b for a, b in zip(there.orderBy("doc_id").collect(), texts))
    assert [r.text for r in pii.pseudonymise(there, "k", back=True).orderBy("doc_id").collect()] == texts


def test_registered_query_takes_the_key_from_the_session(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "ip 10.0.0.1", "en", "s", 0)])
    spark.conf.set(pii.KEY_CONF, "k")
    try:
        got = pii.op10_pii_pseudonyms(spark, path).first()
    finally:
        spark.conf.unset(pii.KEY_CONF)
    assert (got.text, got.n_replaced, got.kinds) == (*replaced(spark, ["ip 10.0.0.1"])[0], "ip")
