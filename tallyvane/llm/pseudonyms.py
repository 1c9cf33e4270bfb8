"""Personal numbers and dates replaced by format-preserving Feistel pseudonyms.

A match is validated (Luhn for cards, mod 97 for IBANs, calendar for dates, ranges for
addresses), reduced to its canonical digits, permuted by a keyed Feistel network over
exactly that domain (walking on until the result is valid), and written back into the
match's own format. The permutation depends on key, kind and value only, so equal values
get equal pseudonyms in all documents, however they were punctuated, and different values
never share one.

Defined cases: a null text stays null and has no spans. Overlapping matches: the leftmost
wins, then the longer, then the kind named first. Repeated rows stay repeated. Whole texts
are searched. Extra columns are kept by `pseudonymised`, which adds a column of spans; if
its name is taken, "_" is put after it. What is not valid stays as it is (a date that is no
day, a number with a wrong check digit), and so do numbers whose words before say that they
are none of these (a version, an ISBN, a commit or checksum). Bare runs of digits are no
phones, nor days with years of two digits dates. A date that can be read both ways is read
as the other dates of its text tell, else as its language writes it (`day_first`). An empty
table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

ROUNDS = 8
#: Symbols that are permuted as one number: what a round's digest of 256 bits can shift.
BLOCK = 64
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()
DIGITS = "0123456789"
ALNUM = DIGITS + "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"


def permuted(key: bytes, kind: str, value: int, left: int, right: int) -> int:
    """value, below left * right, permuted keyed by a Feistel network over the two parts."""
    a, b = divmod(value, right)
    for i in range(ROUNDS):
        size = left if i % 2 == 0 else right
        source = b if i % 2 == 0 else a
        digest = hashlib.blake2b(f"{kind}|{left}|{right}|{i}|{source}".encode(), key=key[:64], digest_size=32).digest()
        shift = int.from_bytes(digest, "big") % size
        if i % 2 == 0:
            a = (a + shift) % size
        else:
            b = (b + shift) % size
    return a * right + b


def permuted_symbols(key: bytes, kind: str, text: str, alphabet: str) -> str:
    """text over an alphabet, permuted among the texts of its length (one symbol: rotated).

    A text of more than BLOCK symbols goes by blocks, each keyed by the new one before it, in
    one pass from either end, so that every symbol hangs on all others.
    """
    n = len(text)
    if n <= BLOCK:
        return permuted_block(key, f"{kind}{n}", text, alphabet)
    for way in ("first", "second"):
        out = [""]
        for i in range(0, n, BLOCK):
            out.append(permuted_block(key, f"{kind}{n}|{way}|{i}|{out[-1]}", text[i : i + BLOCK], alphabet))
        text = "".join(out)[::-1]
    return text


def permuted_block(key: bytes, kind: str, text: str, alphabet: str) -> str:
    """At most BLOCK symbols, as one number of the Feistel network."""
    radix, n = len(alphabet), len(text)
    if not n:
        return text
    value = 0
    for c in text:
        value = value * radix + alphabet.index(c)
    value = permuted(key, kind, value, radix ** (n - n // 2), radix ** (n // 2))
    out = []
    for _ in range(n):
        value, digit = divmod(value, radix)
        out.append(alphabet[digit])
    return "".join(reversed(out))


def refilled(shape: str, digits: str, alphabet: str = DIGITS) -> str:
    """shape with its symbols of the alphabet replaced in turn; letters keep their case."""
    left = iter(digits)
    return "".join((d.upper() if c.isupper() else d) if c.lower() in alphabet and (d := next(left)) is not None else c for c in shape)


def only(text: str, alphabet: str = DIGITS) -> str:
    return "".join(c for c in text if c in alphabet)


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def card(key, text):
    """A card number with a Luhn digit: all digits but that one are permuted, and it is set anew."""
    digits = only(text)
    if len(set(digits)) < 2 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = permuted_symbols(key, "card", digits[:-1], DIGITS)
    return refilled(text, body + luhn_digit(body))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban_valid(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and iban_number(plain[4:] + plain[:4]) % 97 == 1


def iban(key, text):
    """A bank account with a valid check: its digits are permuted and the check is set anew."""
    plain = text.replace(" ", "")
    if not iban_valid(plain):
        return None
    body = refilled(plain[4:], permuted_symbols(key, "iban", only(plain[4:]), DIGITS))
    check = f"{98 - iban_number(body + plain[:2] + '00') % 97:02d}"
    left = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(left) for c in text)


def phone(key, text):
    """8 to 15 digits, as the library's detector has it; the shape of a date, valid or not, is no phone."""
    digits = only(text)
    if not 8 <= len(digits) <= 15 or text.isdigit() or len(set(digits)) < 2 or DATE_SHAPE.fullmatch(text):
        return None
    lead = 1 if text.startswith("+") else 0  # the first digit after a plus is (part of) the country's
    return refilled(text, digits[:lead] + permuted_symbols(key, f"phone{digits[:lead]}", digits[lead:], DIGITS))


def iban_matches(text: str):
    """(start, end) of what may be IBANs. The pattern takes words that follow, so ends are tried at the words' borders: the country's length first, then the longest."""
    at = 0
    while m := IBAN.search(text, at):
        size = lambda end, start=m.start(): end - start - text.count(" ", start, end)
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
        at = m.start() + 1
        for end in sorted(ends, key=lambda end: size(end) != IBAN_SIZES.get(text[m.start() : m.start() + 2])):
            if iban_valid(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break


def social(key, text):
    """A social number of the ranges in use, permuted within them."""
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = only(text)
    if not valid(digits):
        return None
    digits = permuted_symbols(key, "social", digits, DIGITS)
    while not valid(digits):
        digits = permuted_symbols(key, "social", digits, DIGITS)
    return refilled(text, digits)


def address(key, text):
    """Four octets, each permuted among those of its number of digits."""
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(str(int(p)) != p for p in text.split(".")):
        return None
    # Octets keep their number of digits: 0-9, 10-99 or 100-255.
    lowest = [(0, 10, 100)[len(str(p)) - 1] for p in parts]
    sizes = [(10, 90, 156)[len(str(p)) - 1] for p in parts]
    value = 0
    for p, low, size in zip(parts, lowest, sizes, strict=True):
        value = value * size + p - low
    value = permuted(key, f"address{lowest}", value, sizes[0] * sizes[1], sizes[2] * sizes[3])
    out = []
    for low, size in zip(reversed(lowest), reversed(sizes), strict=True):
        value, rest = divmod(value, size)
        out.append(str(low + rest))
    return ".".join(reversed(out))


def other_day(key, ordinal: int) -> int:
    """The day that stands for a day: those of FIRST_DAY to LAST_DAY among themselves, so are all others."""
    inside = FIRST_DAY <= ordinal <= LAST_DAY
    span = LAST_DAY - FIRST_DAY + 1
    if inside:
        value, size, left, right, kind = ordinal - FIRST_DAY, span, 512, 256, "date"
    else:
        value, size = (ordinal - 1 if ordinal < FIRST_DAY else ordinal - 1 - span), datetime.date.max.toordinal() - span
        left, right, kind = 2048, 1792, "far date"
    while True:  # walks within the permutation's cycle, so it comes back to a valid day
        value = permuted(key, kind, value, left, right)
        if value < size:
            break
    if inside:
        return FIRST_DAY + value
    return value + 1 if value + 1 < FIRST_DAY else value + 1 + span


def day_first(text: str) -> bool:
    """Whether a text writes the day before the month: as its dates of one reading do, else as its language does; English has the month first."""
    told = [(int(m[1]) > 12, int(m[3]) > 12) for m in NUMBERED.finditer(text)]
    days, months = sum(a and not b for a, b in told), sum(b and not a for a, b in told)
    if days != months:
        return days > months
    words = set(text.lower().split())
    return len(words & DAY_FIRST_WORDS) > len(words & MONTH_FIRST_WORDS)


def date(key, text, first=False):
    """A day in numbers, permuted among days; numbers without leading zeros stay without. first: of two readings, the one with the day first."""
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    year_first = len(parts[0]) == 4
    if year_first:
        year, month, day = map(int, parts)
        order = "ymd"
    else:
        a, b, year = map(int, parts)
        order = "dmy" if mark == "." or a > 12 or (first and b <= 12) else "mdy"
        day, month = (a, b) if order == "dmy" else (b, a)
    try:
        ordinal = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    day = datetime.date.fromordinal(other_day(key, ordinal))
    width = 2 if sum(map(len, parts)) == 8 else 1
    shown = {"y": f"{day.year:04d}", "m": f"{day.month:0{width}d}", "d": f"{day.day:0{width}d}"}
    return mark.join(shown[c] for c in order)


def worded_date(key, text):
    """A day with its month's name, which stays in the name's language, length of name and capitals."""
    m = WORDED.fullmatch(text)
    day_first = m["month1"] is not None
    day, name, year = (m["day1"], m["month1"], m["year1"]) if day_first else (m["day2"], m["month2"], m["year2"])
    names = next(n for n in MONTHS if name.lower() in n)
    try:
        ordinal = datetime.date(int(year), names.index(name.lower()) % 12 + 1, int(day)).toordinal()
    except ValueError:
        return None
    new = datetime.date.fromordinal(other_day(key, ordinal))
    told = names[names.index(name.lower()) // 12 * 12 + new.month - 1]
    told = told.upper() if name.isupper() else told.capitalize() if name[0].isupper() else told
    ordinal_sign = "" if day_first or not m["sign2"] else "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    ordinal_sign = ordinal_sign.upper() if ordinal_sign and m["sign2"].isupper() else ordinal_sign
    shown = {"day": f"{new.day:0{2 if day[0] == '0' else 1}d}" + ordinal_sign, "month": told, "year": f"{new.year:04d}"}
    out, at = [], 0
    for part in ("day", "month", "year") if day_first else ("month", "day", "year"):
        a, b = m.span(part + ("1" if day_first else "2"))
        b = m.end("sign2") if part == "day" and not day_first and m["sign2"] else b
        out += [text[at:a], shown[part]]
        at = b
    return "".join(out)


def address6(key, text):
    """A version 6 address, permuted group by group among those of the same number of digits."""
    try:
        plain = ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None
    groups = [g for g in plain.split(":") if g not in ("", "0")]
    if not groups:
        return None  # "::" and the like are nobody's
    sizes = [15 * 16 ** (len(g) - 1) for g in groups]
    value = 0
    for g, size in zip(groups, sizes, strict=True):
        value = value * size + int(g, 16) - 16 ** (len(g) - 1)
    half = len(groups) // 2
    value = permuted(key, "address6" + "".join(c if c == ":" else "0" if c == "0" else "f" for c in plain), value, math.prod(sizes[:half]), math.prod(sizes[half:]))
    new = []
    for g, size in zip(reversed(groups), reversed(sizes), strict=True):
        value, rest = divmod(value, size)
        new.append(f"{rest + 16 ** (len(g) - 1):x}")
    out = ":".join(g if g in ("", "0") else new.pop() for g in plain.split(":"))
    return out.upper() if text.isupper() else out


def provider_secret(key, text):
    """A provider's secret: its prefix stays, the rest is permuted, signs in their places."""
    prefix = next(p for p in PREFIXES if text.startswith(p))
    rest = text[len(prefix) :]
    alphabet = DIGITS + string.ascii_uppercase if prefix in ("AKIA", "ASIA") else DIGITS + string.ascii_letters
    new = iter(permuted_symbols(key, prefix, only(rest, alphabet), alphabet))
    return prefix + "".join(next(new) if c in alphabet else c for c in rest)


def email(key, text):
    """A mail address: letters and digits of the local part are permuted, by domain."""
    local, domain = text.split("@")
    symbols = only(local.lower(), ALNUM)
    return refilled(local, permuted_symbols(key, "email" + domain.lower(), symbols, ALNUM), ALNUM) + "@" + domain if symbols else None


def secret(key, text):
    """A long hexadecimal secret, permuted among those of its length."""
    new = permuted_symbols(key, "secret", text.lower(), HEX)
    return new if text.islower() or not text.isupper() else new.upper()


DATE_SHAPE = re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}")
#: Names of the months and their short forms, by language.
MONTHS = [
    "january february march april may june july august september october november december jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
]
_NAME = "(?i:" + "|".join(sorted({m for months in MONTHS for m in months}, key=len, reverse=True)) + ")"
WORDED = re.compile(
    rf"(?<![\w./-])(?:(?P<day1>[0-9]{{1,2}})(?:\.? | de )(?P<month1>{_NAME})(?: | de |\.? )(?P<year1>[0-9]{{4}})|(?P<month2>{_NAME})\.? (?P<day2>[0-9]{{1,2}})(?P<sign2>(?i:st|nd|rd|th))?,? (?P<year2>[0-9]{{4}}))(?![\w-])"
)
#: Dates in numbers that end with the year.
NUMBERED = re.compile(r"(?<![\w./-])([0-9]{1,2})([/-])([0-9]{1,2})\2[0-9]{4}(?![\w/-])")
#: Frequent words of languages that write the day first, and of English.
DAY_FIRST_WORDS = set("der die das und ist nicht ein le la les et des est une el los las que una y".split())
MONTH_FIRST_WORDS = set("the of and to in is that for with".split())
#: Beginnings of providers' secrets.
PREFIXES = ["AKIA", "ASIA", "ghp_", "github_pat_", "sk_live_", "sk_test_", "sk-proj-", "xoxb-", "xoxp-", "glpat-"]
#: Words before a number that say what it is.
NOT = "".join(f"(?<!{w})(?<!{w.capitalize()})(?<!{w.upper()})" for w in ("version ", "isbn ", "isbn: ", "isbn-13: ", "isbn-10: "))
NOT_SECRET = "".join(f"(?<!{w})" for w in ("commit ", "Commit ", "sha1:", "sha256:", "sha512:", "md5:", "SHA256 ", "SHA256: ", "sha1 ", "MD5 "))
#: A grouped number ends with its groups, whatever number follows; a loose one must stand apart from other digits.
PHONE = re.compile(
    NOT + r"(?<![\w+.-])(?:\+?[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?:\+|(?<![0-9] ))(?:\([0-9]{1,4}\)|[0-9])(?:(?:[ .-]| ?/ ?)?(?:\([0-9]{1,4}\)[ -]?)?[0-9]){6,14}(?!\w| [0-9]))"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Lengths by country; other countries take any length with a valid check.
IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Kind, pattern, what it becomes (None: not valid). The order decides ties.
KINDS = [
    ("card", re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![\w-])"), card),
    ("iban", IBAN, iban),
    ("social", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), social),
    ("address", re.compile(NOT + r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), address),
    ("address6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}:?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])"), address6),
    # A time of day may follow.
    ("date", re.compile(r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4})(?:(?=T[0-9]{2}:)|(?![\w/-]|\.[0-9]))"), date),
    ("worded date", WORDED, worded_date),
    ("phone", PHONE, phone),
    ("provider secret", re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?:" + "|".join(PREFIXES[2:]) + r")[A-Za-z0-9_-]{16,})"), provider_secret),
    ("secret", re.compile(NOT_SECRET + r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"), secret),
]
EMAIL = ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w])"), email)
HAS_DIGITS = re.compile(r"[0-9]")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, int]]]:
    """(text with pseudonyms, spans in it: start, end, kind, start in the old text)."""
    kinds = (KINDS if HAS_DIGITS.search(text) else []) + ([EMAIL] if "@" in text else [])
    found, first = [], None
    for rank, (kind, pattern, change) in enumerate(kinds):
        for start, end in iban_matches(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
            if kind == "date":
                first = day_first(text) if first is None else first
                new = date(key, text[start:end], first)
            else:
                new = change(key, text[start:end])
            if new is not None:
                found.append((start, -end, rank, kind, new))
    if not found:
        return text, []
    out, spans, at, size = [], [], 0, 0
    for start, end, _, kind, new in sorted(found):
        if start < at:
            continue
        out += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), kind, start))
        size += len(new)
        at = -end
    return "".join([*out, text[at:]]), spans


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("old_start", T.IntegerType())]
    )
)


def pseudonymised(docs: DataFrame, key: bytes, text_col="text", spans_col="spans") -> DataFrame:
    """docs with text replaced, and a column of spans."""
    while spans_col in docs.columns:
        spans_col += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, SPANS)])
    at = docs.columns.index(text_col)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SPANS)
        for batch in slices(batches):
            texts, spans = [], []
            for text in batch.column(at).to_pylist():
                new, found = pseudonymise(text, key) if text is not None else (None, [])
                texts.append(new)
                spans.append([dict(zip(("start", "end", "kind", "old_start"), s, strict=True)) for s in found])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*batch.schema.names, spans_col])

    return docs.mapInArrow(run, schema)


def kind_counts(spans):
    """Map of kind to number of spans, from a spans Column."""
    kinds = [k for k, _, _ in KINDS] + [EMAIL[0]]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind)))
    return F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(count, kinds)))
