"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Validated values are replaced by others of the same kind and format, chosen by a keyed permutation:
equal values get equal pseudonyms in every document, different values different ones, and with the
key the permutation can be undone.  Each kind is permuted on its own domain:

kind   validated by                                permuted
card   13-19 digits in whole groups of a run, Luhn all digits but the last, which is the new check digit
iban   mod-97 check                                the digits of the account part; new check digits
ssn    ddd-dd-dddd with issued number ranges       within those ranges
ip     four numbers up to 255                      as a 32-bit number
phone  +1 or bare (ddd) ddd-dddd or ddd-ddd-dddd,  the last ten digits; of other numbers all but the
       or + and 10 to 15 digits                    first two after the +
date   calendar days 1900-01-01 to 2099-12-31      within those days
email  name@domain                                 letters and digits of the name, each within its kind

Dates are yyyy-mm-dd, dd.mm.yyyy and mm/dd/yyyy, or dd/mm/yyyy where mm/dd/yyyy is no day; such a date becomes another
that reads as dd/mm/yyyy only.  Ten digits in a row without separators are no phone and stay.  Digits keep
their separators, so a card number with and without spaces stays linked.  Values that fail their
check, such as a 16-digit number with a wrong check digit, are left as they are.

The permutation is a Feistel network of `ROUNDS` rounds over two parts of the value, whose round
function is SHA-256 of key, kind, round and the other part; `Cipher(key, back=True)` undoes it.  The
key is a literal in the query plan: keep plans and event logs as safe as the key, or redact them with
spark.sql.redaction.string.regex.  The registered query takes it from the session (`KEY_CONF`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read

ROUNDS = 8
#: Session setting with the key of the registered query; where it is unset, a key that is no secret serves for trials.
KEY_CONF, TRIAL_KEY = "spark.cairn.pseudonym.key", "trial"


@dataclass(frozen=True)
class Cipher:
    """SQL for the key, and whether pseudonyms are made or turned back into values."""

    key: str
    back: bool = False

    @property
    def sign(self) -> str:
        return "-" if self.back else "+"

    @property
    def turns(self) -> str:
        return f"sequence({ROUNDS}, 1)" if self.back else f"sequence(1, {ROUNDS})"

# Shapes of the kinds; the first that matches at a place is tried.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+(])(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[2-9][0-9](?:[ .-]?\(?[0-9]+\)?){2,6}(?![0-9])|(?<![0-9+(.-])(?:1[ -])?[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])",
}
# a whole run of digits, up to the next value of another kind; possessive, as Java recurses on other repeated groups
SHAPES["card"] = rf"(?<![0-9])[0-9](?:(?! (?:{'|'.join(SHAPES[k] for k in ('email', 'date', 'ip', 'ssn', 'phone'))}))[ -]?[0-9]){{12,}}+"
#: The windows of a run that are taken before others: one group, 4-4-4-4, 4-6-5 and 4-6-4.
USUAL_CARD = "^[ -]?(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ANY = "|".join(SHAPES.values())


def _digest(key: Cipher, kind: str, turn: str, value: str) -> str:
    """SQL for a 60-bit number from the key, the kind, the round and a value."""
    return f"cast(conv(substring(sha2(concat_ws('|', {key.key}, '{kind}', {turn}, {value}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: Cipher, kind: str, left: str, right: str, n_left: str, n_right: str) -> str:
    """SQL for a struct (l, r): the permutation of (left, right) on [0, n_left) x [0, n_right)."""
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    new_l = f"pmod(s.l {key.sign} {_digest(key, kind, 't', 's.r')} % {n_left}, {n_left})"
    new_r = f"pmod(s.r {key.sign} {_digest(key, kind, 't', 's.l')} % {n_right}, {n_right})"
    step = f"if(t % 2 = 0, named_struct('l', cast({new_l} as bigint), 'r', s.r), named_struct('l', s.l, 'r', cast({new_r} as bigint)))"
    return f"aggregate({key.turns}, {start}, (s, t) -> {step})"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once under a name for body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _permute_digits(key: Cipher, kind: str, d: str, tag: str) -> str:
    """SQL for a string of as many digits as d (2 to 36), permuted among those."""
    h = f"cast(length({d}) div 2 as int)"
    n_l, n_r = f"cast(rpad('1', {h} + 1, '0') as bigint)", f"cast(rpad('1', length({d}) - {h} + 1, '0') as bigint)"
    body = feistel(key, kind, f"substring({d}, 1, {h})", f"substring({d}, {h} + 1)", n_l, n_r)
    return _let(body, f"p{tag}", f"concat(lpad(cast(p{tag}.l as string), {h}, '0'), lpad(cast(p{tag}.r as string), length({d}) - {h}, '0'))")


def _refill(m: str, digits: str) -> str:
    """SQL for m with its digits replaced, in order, by those of digits."""
    at = f"length(regexp_replace(substring({m}, 1, i), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({m})), i -> if(substring({m}, i, 1) rlike '[0-9]', substring({digits}, {at}, 1), substring({m}, i, 1))), '')"


def _luhn_sum(d: str, odd: int) -> str:
    """SQL for the Luhn sum of digits d; odd is 1 where the last digit counts once, 0 where it counts twice."""
    x = f"cast(substring({d}, length({d}) - j + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, j) -> a + if(j % 2 = {odd}, {x}, if({x} > 4, 2 * {x} - 9, 2 * {x})))"


def _card(m: str, key: Cipher) -> str:
    """The cards of a run of digits: of its windows of whole groups with 13 to 19 digits that pass Luhn, the usual
    formats first, else the leftmost and longest, none overlapping another."""
    def window(i: str, k: str) -> str:
        return f"array_join(slice(g, {i} + 1, {k}), '')"

    def longest(usual: str) -> str:
        ok = f"(w rlike '{USUAL_CARD}') = {usual} and {_let(_digits('w'), 'd', f'length(d) between 13 and 19 and ({_luhn_sum(chr(100), 1)}) % 10 = 0')}"
        return f"transform(sequence(0, size(g) - 1), i -> coalesce(array_max(filter(sequence(1, least(19, size(g) - i)), k -> {_let(window('i', 'k'), 'w', ok)})), 0))"

    pay = _permute_digits(key, "card", "substring(d, 1, length(d) - 1)", "c")
    new = _let(pay, "q", f"concat(q, cast(pmod(10 - ({_luhn_sum('q', 0)}) % 10, 10) as string))")
    moved = _let(window("c.at", "c.n"), "w", _let(_digits("w"), "d", _let(new, "n", _refill("w", "n"))))
    # a window of another format gives way to a usual one that starts in it
    n = "if(u[i] > 0, u[i], if(o[i] > 0 and array_max(slice(u, i + 1, o[i])) = 0, o[i], 0))"
    take = f"if(i < s.next, s, {_let(n, 'n', 'if(n = 0, s, named_struct({0}next{0}, i + n, {0}cards{0}, concat(s.cards, array(named_struct({0}from{0}, s.next, {0}at{0}, i, {0}n{0}, n)))))'.format(chr(39)))})"
    start = "named_struct('next', 0, 'cards', cast(array() as array<struct<from:int,at:int,n:int>>))"
    found = _let(longest("true"), "u", _let(longest("false"), "o", f"aggregate(sequence(0, size(g) - 1), {start}, (s, i) -> {take})"))
    pieces = f"array_join(transform(s.cards, c -> concat({window('c.from', 'c.at - c.from')}, {moved})), '')"
    text = f"if(size(s.cards) = 0, cast(null as string), concat({pieces}, {window('s.next', 'size(g)')}))"
    return _let(f"regexp_extract_all({m}, '[ -]?[0-9]+', 0)", "g", _let(found, "s", f"named_struct('value', {text}, 'n', size(s.cards))"))


def _mod97(s: str) -> str:
    """SQL for the number spelt by s, with letters as 10 to 35, modulo 97."""
    c = f"substring({s}, j, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (a, j) -> if({c} rlike '[0-9]', (a * 10 + cast(if({c} rlike '[0-9]', {c}, '0') as int)) % 97, (a * 100 + ascii({c}) - 55) % 97))"


def _iban(m: str, key: Cipher) -> str:
    flat = f"replace({m}, ' ', '')"
    valid = _mod97("concat(substring(f, 5), substring(f, 1, 4))")
    account = f"substring({m}, 5)"
    new = _let(_digits(account), "d", f"if(length(d) < 2, {account}, {_let(_permute_digits(key, 'iban', 'd', 'b'), 'q', _refill(account, 'q'))})")
    check = _mod97(f"concat(replace(w, ' ', ''), substring({m}, 1, 2), '00')")
    out = _let(new, "w", f"concat(substring({m}, 1, 2), lpad(cast(98 - ({check}) as string), 2, '0'), w)")
    return _let(flat, "f", f"if(length(f) between 15 and 34 and ({valid}) = 1, {out}, cast(null as string))")


def _ssn(m: str, key: Cipher) -> str:
    # areas 001-665 and 667-899 (898 of them), groups 01-99, serials 0001-9999
    a, g, s = (f"cast(substring({m}, {p}, {n}) as int)" for p, n in ((1, 3), (5, 2), (8, 4)))
    perm = feistel(key, "ssn", f"({a} - if({a} > 666, 2, 1)) * 99 + {g} - 1", f"{s} - 1", "88902", "9999")
    area = "cast(p.l div 99 + 1 as int)"
    out = _let(perm, "p", f"concat_ws('-', lpad(cast(if({area} > 665, {area} + 1, {area}) as string), 3, '0'), lpad(cast(p.l % 99 + 1 as string), 2, '0'), lpad(cast(p.r + 1 as string), 4, '0'))")
    return f"if({a} between 1 and 899 and {a} <> 666 and {g} > 0 and {s} > 0, {out}, cast(null as string))"


def _ip(m: str, key: Cipher) -> str:
    o = [f"cast(split({m}, '[.]')[{k}] as int)" for k in range(4)]
    perm = feistel(key, "ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536")
    out = _let(perm, "p", "concat_ws('.', cast(p.l div 256 as string), cast(p.l % 256 as string), cast(p.r div 256 as string), cast(p.r % 256 as string))")
    # an octet with a leading zero has no place in the result, so such an address is none
    return f"if({m} not rlike '(^|[.])0[0-9]' and {' and '.join(f'{x} <= 255' for x in o)}, {out}, cast(null as string))"


def _phone(m: str, key: Cipher) -> str:
    # the permuted part: the last ten digits of a +1 or bare number, all but two digits of another
    keep = f"if({m} rlike '^[+]1|^[^+]', length(d) - 10, 2)"
    perm = _permute_digits(key, "phone", "u", "h")
    out = _let(f"substring(d, {keep} + 1)", "u", _let(perm, "q", _refill(m, f"concat(substring(d, 1, {keep}), q)")))
    return _let(_digits(m), "d", f"if(length(d) between 10 and 15, {out}, cast(null as string))")


def _date(m: str, key: Cipher) -> str:
    parts = {"iso": ("yyyy-MM-dd", "-"), "dot": ("dd.MM.yyyy", "."), "mdy": ("MM/dd/yyyy", "/"), "dmy": ("dd/MM/yyyy", "/")}
    order = {"iso": (1, 6, 9), "dot": (7, 4, 1), "mdy": (7, 1, 4), "dmy": (7, 4, 1)}

    def day(kind: str) -> str:
        y, mo, d = order[kind]
        text = f"concat_ws('-', substring({m}, {y}, 4), substring({m}, {mo}, 2), substring({m}, {d}, 2))"
        return f"try_cast({text} as date)"

    style = f"case when {m} rlike '^[0-9]{{4}}-' then 'yyyy-MM-dd' when {m} rlike '^..[.]' then 'dd.MM.yyyy' when {day('mdy')} is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    value = f"case when {m} rlike '^[0-9]{{4}}-' then {day('iso')} when {m} rlike '^..[.]' then {day('dot')} else coalesce({day('mdy')}, {day('dmy')}) end"
    # 73,049 days from 1900 to 2099: 17 x 4,297
    perm = feistel(key, "date", "datediff(w, date'1900-01-01') div 4297", "datediff(w, date'1900-01-01') % 4297", "17", "4297")
    step = _let(perm, "p", "date_add(date'1900-01-01', cast(p.l * 4297 + p.r as int))")
    # a day that reads as dd/mm only has to become such a one again, or it would meet an mm/dd value: on along its cycle,
    # of which two in five days are passed over, so that 64 steps do not end before one is found
    walk = f"aggregate(sequence(1, 64), v, (w, i) -> if(i > 1 and (f <> 'dd/MM/yyyy' or dayofmonth(w) > 12), w, {step}))"
    shown = " ".join(f"when '{f}' then date_format(w, '{f}')" for f, _ in parts.values())
    new = _let(style, "f", _let(walk, "w", f"case f {shown} end"))
    return _let(value, "v", f"if(v between date'1900-01-01' and date'2099-12-31', {new}, cast(null as string))")


def _email(m: str, key: Cipher) -> str:
    """Each letter or digit of the name moves within its kind by a stream from the other half, in turns."""
    name = f"substring_index({m}, '@', 1)"

    def moved(half: str, other: str) -> str:
        c = f"substring({half}, i, 1)"
        # one byte of the digest per character, reused beyond 32 characters
        shift = "cast(conv(substring(h, 1 + 2 * ((i - 1) % 32), 2), 16, 10) as int)"
        def within(first: int, n: int) -> str:
            return f"chr({first} + pmod(ascii({c}) - {first} {key.sign} {shift}, {n}))"
        one = f"case when {c} rlike '[a-z]' then {within(97, 26)} when {c} rlike '[A-Z]' then {within(65, 26)} when {c} rlike '[0-9]' then {within(48, 10)} else {c} end"
        stream = f"sha2(concat_ws('|', {key.key}, 'email', t, {other}), 256)"
        return f"if(length({half}) = 0, '', {_let(stream, 'h', f'array_join(transform(sequence(1, length({half})), i -> {one}), {chr(39)}{chr(39)})')})"

    h = f"cast(length({name}) div 2 as int)"
    start = f"named_struct('l', substring({name}, 1, {h}), 'r', substring({name}, {h} + 1))"
    step = f"if(t % 2 = 0, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')}))"
    body = f"aggregate({key.turns}, {start}, (s, t) -> {step})"
    return _let(body, "e", f"concat(e.l, e.r, substring({m}, instr({m}, '@')))")


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: str, key: Cipher) -> str:
    """SQL for struct (kind, value, n): the first kind whose shape and check the string in SQL expression match passes, with how many values it replaces; nulls and 0 if none does."""
    tries = []
    for kind, make in _KINDS.items():
        shape = SHAPES[kind].replace("\\", "\\\\").replace("'", "\\'")
        made = make(match, key) if kind == "card" else f"named_struct('value', {make(match, key)}, 'n', 1)"
        tries.append(f"if({match} rlike '^(?:{shape})$', {_let(made, 'z', f'named_struct({chr(39)}kind{chr(39)}, {chr(39)}{kind}{chr(39)}, {chr(39)}value{chr(39)}, z.value, {chr(39)}n{chr(39)}, z.n)')}, null)")
    found = f"filter(array({', '.join(tries)}), x -> x.value is not null)"
    return f"coalesce(get({found}, 0), named_struct('kind', cast(null as string), 'value', cast(null as string), 'n', 0))"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "text", counts: str = "n_replaced", kinds: str = "kinds", back: bool = False) -> DataFrame:
    """docs with `out` (the text with every validated value replaced), `counts` (how many were) and `kinds` (of which kinds).

    A null text stays null with count 0; texts without personal data come back unchanged.  Columns of these names in docs
    are replaced.  With back, pseudonyms made with the same key are turned into the values again.
    """
    source = F.col(text).cast("string")
    some = F.coalesce(source.rlike("[0-9@]"), F.lit(False)) & F.coalesce(source.rlike(ANY), F.lit(False))
    quoted = F.lit(key)
    d = docs.withColumn("__source", source).withColumn("__key", quoted)
    d = d.withColumn("__found", F.when(some, F.regexp_extract_all("__source", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__new", F.expr(f"transform(__found, m -> {pseudonym('m', Cipher('__key', back))})"))
    gaps = F.split(F.col("__source"), ANY, -1)
    filled = F.zip_with(gaps, F.zip_with("__found", "__new", lambda m, p: F.coalesce(p["value"], m)), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    n = F.aggregate("__new", F.lit(0), lambda a, p: a + p["n"])
    changed = F.when(n > 0, F.array_join(filled, "")).otherwise(F.col("__source"))
    kept = [c for c in docs.columns if c not in (out, counts, kinds)]
    return d.select(*kept, changed.alias(out), n.cast("long").alias(counts), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("__new", lambda p: p["kind"])))), ",").alias(kinds))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, TRIAL_KEY)
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "text", "n_replaced", "kinds")
