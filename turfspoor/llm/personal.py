"""Personal information in free text: find it, replace it by typed, linkable placeholders.

Kinds: ``email``, ``telefoon``, ``idnummer``, ``adres``, ``naam``. Numbers are found by their format
and validated (eleven-test, modulo 97, number of digits, a naming word nearby); names need a given
name or initials beside a surname, both known from the list given or from the texts themselves.

Placeholders keep equal values linked over all documents without a table of values. A value is first
brought to one form, whatever its notation. Phone numbers, citizen, register and document numbers
and, where asked for, dates then go through a keyed Feistel permutation within their format: a valid
number becomes another valid one, different ones never the same, and it is written in the notation
found. E-mail addresses, names and street addresses get a keyed code of 80 bits of their one form.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspoor.session import written

KINDS = ("email", "telefoon", "idnummer", "adres", "naam")
#: Bits of a name lexicon for each name, how many of them a name sets, and the most bits there may be (128 MB).
BITS_A_NAME, HASHES, MOST_BITS = 24, 4, 1 << 30

# --- fixed values: words that the rules know ----------------------------------------------------
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "pdf", "txt", "md", "log", "zip", "csv", "json", "xml", "html", "py", "sh", "service", "timer", "socket", "conf", "ini", "yml", "yaml"}
STREETS = "laan|straat|weg|plein|dreef|kade|singel|hof|steeg|gracht|dijk|straße|strasse|str\\.|wg\\.|ln\\.|pln\\.|stg\\."
STREET_FIRST = "oude|nieuwe|korte|lange|eerste|tweede|derde|vierde|grote|kleine|hoge|lage"
PARTICLES = r"(?:van[ ]de[nr]?|van[ ]['’]t|van|de[nr]?|te[nr]?|von|zu|af|la|le|el|al|da|di|du|dos)"
NOT_PERSON = {"ordernummer", "order", "bestelnummer", "serienummer", "kostenplaats", "versie", "factuurnummer", "artikelnummer", "ticket", "klantnummer", "zaal", "studio", "invoice", "version", "serial"}
AFTER_DE = {"de", "het", "een", "the", "a", "an", "over", "na", "is", "was", "heeft", "neemt", "opnieuw", "eerst", "graag", "zonder", "this", "has", "first", "again", "wil", "kan", "moet", "said", "'s", "elke", "in", "op", "bij", "aan", "tijdens", "vóór", "voor", "sinds", "twee", "halverwege", "binnen", "direct", "dit", "zie", "via", "en", "omdat", "want", "zodat"}
# -------------------------------------------------------------------------------------------------

LETTER = r"[^\W\d_]"
MARKED = r"(?:[^\W\d_][̀-ͯ]*)"
#: A name part: letters with marks, apostrophes inside (Mc'Tarrel), no hyphen.
PART = rf"{MARKED}+(?:['’]{MARKED}+)*"
SURNAME = rf"{PART}(?:-{PART})*"

AT = r"(?:@|＠|&\#64;|%40|[ ]?[\[({<][ ]?(?:at|apenstaart(?:je)?)[ ]?[\])}>][ ]?|[ ]apenstaart(?:je)?[ ])"
DOT = r"(?:\.|[ ]?[\[({<][ ]?(?:punt|dot|\.)[ ]?[\])}>][ ]?|[ ](?:punt|dot)[ ])"
EMAIL = re.compile(rf"(?<![\w.+%'-])[a-z0-9_](?:[\w.+%'-]*[\w+-])?{AT}[a-z0-9](?:[\w-]*\w)?(?:{DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+(?![\w@-])", re.I | re.X)
EMAIL_HINT = ("@", "＠", "#64", "%40", "apenst", "at)", "at]", "at}", "at>", "at )", "at ]", "at }", "at >")
DIGITS_HINT = re.compile(r"\d[\d .()-]{4,}\d")
PHONE = re.compile(r"(?<![\w.,/+-])(?:\+\d{2}|00[1-9]\d(?=[ .(-])|\(0\d{1,3}\)|0(?=[1-9]))(?:(?:[ ]?\(0\)[ ]?|[ ]-[ ]|[ .-])?\d){6,12}(?![\w]|-\d|\.\d)")
CITIZEN = re.compile(r"(?<![\w.-])(?:\d{9}|\d{3}([ -])\d{3}\1\d{3}|\d{4}\.\d{2}\.\d{3})(?!\w|-\d|\.\d)")
REGISTER = re.compile(r"(?<![\w.-])(?:\d{11}|\d{2}\.\d{2}\.\d{2}[- ]\d{3}[.-]\d{2}|\d{6}[- ]\d{3}[.-]?\d{2})(?!\w|-\d|\.\d)")
DOCUMENT = re.compile(r"(?<![\w.-])[A-Za-z]{2}[ ]?[A-Za-z0-9]{6}\d(?!\w|-\d)")
DOCUMENT_WORD = re.compile(r"(?<!\w)(?:document|doc|pas|paspoort|passport|kaart|identiteitskaart|identiteitsbewijs|legitimatie|legitimatiebewijs|rijbewijs|id|licen[cs]e|ausweis)(?:nummer|nr|no|number)?[.:#]?\s*(?:(?:no|nr|nummer|number|met nummer)\b[.:]?\s*)?$", re.I)
#: Parts of which every word before a document number holds one.
DOCUMENT_HINT = ("doc", "pas", "kaart", "identi", "legitim", "rijbewijs", "id", "licen", "ausweis")
NUMBERED = re.compile(r"(?<=[a-zß.])\s?\d", re.I)
STREET_ENDS = tuple(STREETS.replace("\\", "").split("|"))
ADDRESS = re.compile(rf"(?<![\w-])(?:(?:{STREET_FIRST})[ ])?{LETTER}[^\W\d_'’-]*(?:{STREETS})\s?\d{{1,4}}(?:[ ](?:bis|ter|hs|I{{2,3}}|IV)(?!\w)|[-/ ]?[a-z](?![\w'’])|-[0-9]{{1,3}}(?!\w)|/[0-9]{{1,3}}(?!\w))?(?!\w)", re.I)
LONE_LETTER = re.compile(r"[ ][a-z]$", re.I)

INITIALS = rf"(?:{LETTER}\.[ ]?){{1,4}}"
FORWARD = re.compile(rf"(?<![\w@.'’-])(?P<given>{PART}|{INITIALS})(?P<gap>[ ]+|(?<=\.))(?:{INITIALS}[ ]?)?(?P<particles>(?:{PARTICLES}[ ]+)?)(?P<sur>{SURNAME})(?![\w@])", re.I)
BACKWARD = re.compile(rf"(?<![\w@.'’-])(?P<sur>{SURNAME}),[ ](?P<given>{INITIALS}|{PART})(?P<particles>(?:[ ]{PARTICLES}(?![\w'’]))?)", re.I)
RUNS = re.compile(r"[^\W\d_]+")
CAPITAL = r"(?:\p{Lu}[\p{L}\p{M}'’]+)"
COMPOUND = rf"{CAPITAL}(?:-{CAPITAL})?"
PAIR = rf"[\p{{Ll}}] ({CAPITAL}(?: (?i:van de[nr]?|van ['’]t|van|de[nr]?|te[nr]?))? {COMPOUND})(?![\p{{L}}\p{{M}}-]|\.?\s?\d)"
#: Words after which a person is named, in Dutch and English.
CUE = r"(?:contactpersoon|contact|cc|gesproken met|melding van|afgehandeld door|namens|volgens|de heer|mevrouw|mevr\.|dhr\.|collega|reported by|on behalf of|mr\.|mrs\.|ms\.)"
CUED = rf"(?<![\p{{L}}])(?i:{CUE}):? ({CAPITAL}(?: (?i:van de[nr]?|van ['’]t|van|de[nr]?|te[nr]?))? {COMPOUND}|{COMPOUND}, {CAPITAL})(?![\p{{L}}\p{{M}}-]|\.?\s?\d)"


def folded(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower().replace("’", "'")


def places(word: str, role: str, bits: int) -> list[int]:
    a, b = (int.from_bytes(x, "big") for x in np.split(np.frombuffer(hashlib.blake2b(f"{role}:{word}".encode(), digest_size=16).digest(), np.uint8), 2))
    return [(a + i * (b | 1)) % bits for i in range(HASHES)]


def surname_places(word: str, bits: int) -> list[int]:
    """The places of a surname: itself and, for a quick look into a text, its longest run of letters."""
    whole = folded(word)
    return places(whole, "a", bits) + places(max(RUNS.findall(whole), key=len, default=whole), "q", bits)


def bits_for(names: int) -> int:
    """The size of the map for so many names: one in 1,600 other words passes for a name, at any size."""
    bits = max(1 << 16, 1 << int(np.ceil(np.log2(max(1, names * BITS_A_NAME)))))
    if bits > MOST_BITS:
        raise ValueError(f"{names} names are more than the lexicon may hold")
    return bits


class Lexicon:
    """Given names and surnames as bits of a map that has room for them; asks are remembered per worker."""

    def __init__(self, bits: bytes):
        self.bits, self.size = bits, len(bits) * 8
        self.asked: dict[tuple[str, str], bool] = {}
        self.met: set[str] = set()
        self.hits: set[str] = set()

    @classmethod
    def of(cls, given, surnames):
        size = bits_for(len(list(given)) + 2 * len(list(surnames)))
        bits = bytearray(size // 8)
        for p in [*(p for w in given for p in places(folded(w), "v", size)), *(p for w in surnames for p in surname_places(w, size))]:
            bits[p >> 3] |= 1 << (p & 7)
        return cls(bytes(bits))

    def _has(self, word: str, role: str) -> bool:
        known = self.asked.get((role, word))
        if known is None:
            if len(self.asked) > 500_000:
                self.asked.clear()
            known = self.asked[role, word] = all(self.bits[p >> 3] >> (p & 7) & 1 for p in places(word, role, self.size))
        return known

    def is_given(self, word: str) -> bool:
        return self._has(folded(word), "v")

    def is_surname(self, word: str) -> bool:
        """Every part of a compound counts; one known part is enough to know the other as one."""
        return any(self._has(p, "a") for p in folded(word).split("-"))

    def any_surname(self, text: str) -> bool:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return True
        words = set(RUNS.findall(text))
        for w in words - self.met:
            if self._has(folded(w), "q"):
                self.hits.add(w)
        if len(self.met) > 500_000:
            self.met, self.hits = set(), {w for w in words if w in self.hits}
        self.met |= words
        return not words.isdisjoint(self.hits)


def eleven_test(digits: str) -> bool:
    """The Dutch citizen number: the weighted sum is a multiple of 11."""
    return len(digits) == 9 and digits != "0" * 9 and (sum(int(d) * w for d, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2))) - int(digits[8])) % 11 == 0


def register_test(digits: str) -> bool:
    """The Belgian national number: 97 less the remainder, with a 2 in front for births from 2000 on."""
    if len(digits) != 11:
        return False
    body, check = digits[:9], int(digits[9:])
    return check in (97 - int(body) % 97, 97 - int("2" + body) % 97)


def word_before(text: str, at: int) -> str:
    m = re.search(rf"({LETTER}+)\W{{0,3}}$", text[max(0, at - 30) : at])
    return m.group(1).lower() if m else ""


def _emails(text, low):
    if any(x in low for x in EMAIL_HINT):
        for m in EMAIL.finditer(text):
            last = re.split(r"\W+", m.group().lower())[-1]
            if last.isalpha() and len(last) >= 2 and last not in FILE_ENDINGS:
                yield m.start(), m.end(), "email"


def _numbers(text, low):
    numbers = DIGITS_HINT.search(text) is not None
    for m in PHONE.finditer(text) if numbers else ():
        digits = re.sub(r"\D", "", m.group().replace("(0)", ""))
        head = m.group()[:4]
        national = digits[4:] if head.startswith("00") else digits[2:] if head[0] == "+" else digits[1:]
        dutch = not (head.startswith("00") or head[0] == "+") or digits.lstrip("0").startswith("31")
        if (len(national) == 9 if dutch else 7 <= len(national) <= 11) and word_before(text, m.start()) not in NOT_PERSON:
            yield m.start(), m.end(), "telefoon"
    for pattern, test in ((REGISTER, register_test), (CITIZEN, eleven_test)):
        for m in pattern.finditer(text) if numbers else ():
            if test(re.sub(r"\D", "", m.group())) and word_before(text, m.start()) not in NOT_PERSON:
                yield m.start(), m.end(), "idnummer"
    for m in DOCUMENT.finditer(text) if any(x in low for x in DOCUMENT_HINT) else ():
        if re.search(r"\d", m.group()) and DOCUMENT_WORD.search(text[max(0, m.start() - 40) : m.start()]):
            yield m.start(), m.end(), "idnummer"


def _addresses(text, low):
    # a number right behind the end of a street name; the pattern itself is too slow for every text
    if any(x in low for x in STREET_ENDS) and any(text[max(0, m.start() - 8) : m.start()].lower().endswith(STREET_ENDS) for m in NUMBERED.finditer(text)):
        for m in ADDRESS.finditer(text):
            end = m.end()
            if LONE_LETTER.search(m.group()):  # a letter after a blank may be the next word
                end -= 2
            yield m.start(), end, "adres"


ARTICLE, AFTER, HOUSE_NUMBER = re.compile(r"(?i)\bde$"), re.compile(r"\s*([^\W\d_'’]+|'s)?"), re.compile(r"\.?\s?\d")


def _names(text, lexicon: Lexicon):
    if not lexicon.any_surname(text):
        return
    at = 0
    while m := BACKWARD.search(text, at):
        given, sur = m["given"], m["sur"]
        initials = given.rstrip().endswith(".")
        if lexicon.is_surname(sur) and ((initials and given[0].isupper()) or lexicon.is_given(given)) and word_before(text, m.start()) not in NOT_PERSON:
            end, particles = m.end(), m["particles"]
            if initials and not particles:
                end = m.start("given") + len(given.rstrip())
            if ARTICLE.search(particles):  # the article of what follows, or a particle
                after = AFTER.match(text, end).group(1)
                before = word_before(text, m.start())
                if after and after.lower() not in AFTER_DE and before not in {"en", "and", "so"}:
                    end -= 3
            yield m.start(), end, "naam"
            at = end
        else:
            at = m.start() + len(sur)
    at = 0
    while m := FORWARD.search(text, at):
        given, sur = m["given"], m["sur"]
        initials = given.rstrip().endswith(".")
        known = lexicon.is_surname(sur) and (initials or lexicon.is_given(given))
        if known and not HOUSE_NUMBER.match(text, m.end()):
            yield m.start(), m.end(), "naam"
            at = m.end()
        else:
            at = m.start() + len(given.rstrip() if not initials else given[:1])


DATE = re.compile(r"(?<![\w.,/+-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([-/.])\d{1,2}\1\d{4})(?!\w|[-/.,]\d)")


def _dates(text):
    for m in DATE.finditer(text):
        if date_of(m.group()):
            yield m.start(), m.end(), "datum"


def find(text: str | None, lexicon: Lexicon, dates: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal values of a text, in order and without overlap.

    Where two finds overlap, the earlier rule holds: e-mail, number, address, name and, with
    ``dates``, valid dates of the years 1900 to 2099 written in figures.
    """
    if not text:
        return []
    low, found = text.lower(), []
    for rule in (_emails(text, low), _numbers(text, low), _addresses(text, low), _names(text, lexicon), _dates(text) if dates else ()):
        fresh = []
        for x in rule:
            i, j = bisect_left(found, x), bisect_left(fresh, x)
            if (i == 0 or found[i - 1][1] <= x[0]) and (i == len(found) or found[i][0] >= x[1]) and (j == 0 or fresh[j - 1][1] <= x[0]) and (j == len(fresh) or fresh[j][0] >= x[1]):
                fresh.insert(j, x)  # nearly always at the end
        if fresh:
            found = sorted(found + fresh) if found else fresh
    return found


# --- pseudonyms -----------------------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network over a*b >= size, walked until inside."""
    if size < 2:
        return value
    a = int(np.ceil(np.sqrt(float(size))))
    while a * a < size:
        a += 1
    while True:
        left, right = divmod(value, a)
        for r in range(rounds):
            mixed = hmac.digest(key, tweak + bytes([r]) + right.to_bytes(16, "big"), "sha256")
            left, right = right, (left + int.from_bytes(mixed[:16], "big")) % a
        value = left * a + right
        if value < size:
            return value


def permute_format(value: str, key: bytes, tweak: bytes, valid=None) -> str:
    """Permute the letters and digits of ``value`` within their places; all else stays as it is.

    Digits stay digits and letters stay letters of their case. With ``valid`` the permutation walks on
    until the digits pass that test again, which keeps it a permutation of the valid numbers.
    """
    places = [(i, 10, ord("0")) if "0" <= c <= "9" else (i, 26, ord("A" if c.isupper() else "a")) for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    size, number = 1, 0
    for i, radix, base in places:
        number, size = number * radix + ord(value[i]) - base, size * radix
    while True:
        number = feistel(number, size, key, tweak)
        out, rest = list(value), number
        for i, radix, base in reversed(places):
            rest, digit = divmod(rest, radix)
            out[i] = chr(base + digit)
        if valid is None or valid("".join(out[i] for i, _, _ in places)):
            return "".join(out)


def filled(value: str, at: list[int], digits: str) -> str:
    """``value`` with its digits at the places ``at`` replaced."""
    out = list(value)
    for i, d in zip(at, digits):
        out[i] = d
    return "".join(out)


#: The country of numbers without a country code.
COUNTRY = "31"
ABROAD = re.compile(r"(?:\+|00)(\d{2})")


def phone_parts(value: str) -> tuple[str, list[int]]:
    """The country code and the places of the national digits, without the zero in front."""
    m = ABROAD.match(value)
    start = m.end() if m else value.index("0") + 1 if "0" in value else 0
    trunk = {x.start() + 1 for x in re.finditer(r"\(0\)", value)} if m else set()
    return m[1] if m else COUNTRY, [i for i in range(start, len(value)) if "0" <= value[i] <= "9" and i not in trunk]


def permuted_phone(value: str, key: bytes) -> str:
    """The number with its national digits permuted: equal numbers stay equal in all notations.

    The country code stays, and so does a first digit of 0 or 6 (mobile); any other becomes another
    one that is neither.
    """
    country, at = phone_parts(value)
    digits = "".join(value[i] for i in at)
    tweak = f"telefoon {country}".encode()
    if digits[:1] in ("0", "6", ""):
        return filled(value, at, digits[:1] + permute_format(digits[1:], key, tweak + digits[:1].encode()))
    return filled(value, at, permute_format(digits, key, tweak, lambda d: d[0] not in "06"))


def permuted_citizen(digits: str, key: bytes) -> str:
    """Another citizen number: eight digits are permuted, the ninth follows; bodies without one are passed over."""
    check = lambda d: sum(int(c) * w for c, w in zip(d, (9, 8, 7, 6, 5, 4, 3, 2))) % 11
    body = permute_format(digits[:8], key, b"burger", lambda d: check(d) < 10 and d != "0" * 8)
    return body + str(check(body))


FIRST_DAY, CENTURY_DAYS = {1900: datetime.date(1900, 1, 1).toordinal(), 2000: datetime.date(2000, 1, 1).toordinal()}, {1900: 36_524, 2000: 36_525}


def register_day(digits: str, century: int) -> int | None:
    """The birth date in a register number as a day of its century; None if it is no date."""
    try:
        return datetime.date(century + int(digits[:2]), int(digits[2:4]), int(digits[4:6])).toordinal() - FIRST_DAY[century]
    except ValueError:
        return None


def permuted_register(digits: str, key: bytes) -> str:
    """Another register number: birth date and serial are permuted together within their century.

    A date stays a date of the century that the check digits tell; numbers with no such date (unknown
    birth dates) are permuted among themselves.
    """
    century = 1900 if int(digits[9:]) == 97 - int(digits[:9]) % 97 else 2000
    tweak, day = f"register {century}".encode(), register_day(digits, century)
    if day is None:
        body = permute_format(digits[:9], key, tweak + b" onbekend", lambda d: register_day(d, century) is None)
    else:
        day, serial = divmod(feistel(day * 1000 + int(digits[6:9]), CENTURY_DAYS[century] * 1000, key, tweak), 1000)
        body = f"{datetime.date.fromordinal(FIRST_DAY[century] + day):%y%m%d}{serial:03d}"
    return body + f"{97 - int(('2' if century == 2000 else '') + body) % 97:02d}"


def date_of(value: str) -> datetime.date | None:
    """The date of figures as year-month-day or day-month-year, of the years 1900 to 2099."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", value))
    year, month, day = (a, b, c) if a > 31 else (c, b, a)
    try:
        return datetime.date(year, month, day) if 1900 <= year < 2100 else None
    except ValueError:
        return None


def permuted_date(value: str, key: bytes) -> str:
    """Another date in the same notation; every date has its own, in whatever notation."""
    first, days = FIRST_DAY[1900], CENTURY_DAYS[1900] + CENTURY_DAYS[2000]
    fresh = datetime.date.fromordinal(first + feistel(date_of(value).toordinal() - first, days, key, b"datum"))
    parts = re.split(r"([-/.])", value)
    order = (fresh.year, fresh.month, fresh.day) if len(parts[0]) == 4 else (fresh.day, fresh.month, fresh.year)
    padded = any(len(x) == 2 and x[0] == "0" for x in parts[::2]) or all(len(x) > 1 for x in parts[::2])
    return "".join(x if i % 2 else f"{order[i // 2]:02d}" if padded else str(order[i // 2]) for i, x in enumerate(parts))


AT_SIGN, DOT_SIGN = re.compile(AT, re.I), re.compile(DOT, re.I)
#: Short forms of the ends of street names.
SHORT_STREETS = {"str.": "straat", "wg.": "weg", "ln.": "laan", "pln.": "plein", "stg.": "steeg", "straße": "strasse"}


def canonical(value: str, kind: str) -> str:
    """The one form of an e-mail address, a name or a street address, whatever its notation.

    Disguises are taken off an address; a name is given name or initials, particles, surname; a street
    has its long form and its number with the addition behind a blank.
    """
    if kind == "email":
        local, domain = AT_SIGN.split(value, 1)
        return folded(local + "@" + DOT_SIGN.sub(".", domain))
    same = re.sub(r"\s+", " ", folded(value)).strip()
    if kind == "naam":
        m = BACKWARD.fullmatch(same) or FORWARD.fullmatch(same)
        if m:
            given = same[m.start("given") : m.start("particles")] if m.re is FORWARD else m["given"]
            return " ".join([re.sub(r"[. ]", "", given) if "." in given else given.strip(), *m["particles"].split(), m["sur"]])
    if kind == "adres":
        m = re.match(r"(.*?)\s?(\d+)[-/ ]?(.*)$", same)
        street = m[1]
        for short, long in SHORT_STREETS.items():
            street = street[: -len(short)] + long if street.endswith(short) else street
        return f"{street} {m[2]} {m[3]}".strip()
    return same


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What stands in the placeholder. Values that differ in notation only have the same one, written in theirs."""
    if kind == "telefoon":
        return permuted_phone(value, key)
    if kind == "datum":
        return permuted_date(value, key)
    if kind == "idnummer":
        at = [i for i, c in enumerate(value) if "0" <= c <= "9"]
        digits = "".join(value[i] for i in at)
        if not re.search(r"[A-Za-z]", value):
            if eleven_test(digits):
                return filled(value, at, permuted_citizen(digits, key))
            if register_test(digits):
                return filled(value, at, permuted_register(digits, key))
        return permute_format(value.upper().replace(" ", ""), key, b"document")
    code = hmac.digest(key, f"{kind}:{canonical(value, kind)}".encode("utf-8", "surrogatepass"), "sha256")[:10]
    return base64.b32encode(code).decode().lower()


class Pseudonyms:
    """The pseudonyms of one key; those of frequent values are remembered per worker."""

    def __init__(self, key: bytes):
        self.key, self.known = checked(key), {}

    def of(self, value: str, kind: str) -> str:
        got = self.known.get((kind, value))
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[kind, value] = pseudonym(value, kind, self.key)
        return got


def checked(key: bytes) -> bytes:
    if not isinstance(key, bytes) or len(key) < 16:
        raise ValueError("pseudonyms need a secret key of 16 bytes or more")
    return key


def replace(text: str | None, lexicon: Lexicon, names: Pseudonyms, dates: bool = False) -> str | None:
    """The text with ``[kind:pseudonym]`` for each find and every other character as it was."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in find(text, lexicon, dates):
        out += [text[at:start], f"[{kind}:{names.of(text[start:end], kind)}]"]
        at = end
    return "".join([*out, text[at:]])


# --- Spark ----------------------------------------------------------------------------------------


def learn_lexicon(texts: DataFrame, column: str, names: DataFrame, min_partners: int = 2, share: float = 0.2) -> Lexicon:
    """Given names and surnames: those listed and those the texts show.

    Evidence is two capitalised words with particles between, in the middle of a sentence and not
    before a house number. A word is a given name (surname) if it stands so with at least
    ``min_partners`` different surnames (given names) known so far, in two rounds from the listed
    ones on, or once after a word that introduces a person; and these must be ``share`` of all the
    words it stands so with, so that a common word does not become a name because the collection
    is large. The counts run over all texts. ``names`` is a fixed list; to the driver come the bits
    of the map, whose size follows from the number of names and has an upper bound.
    """
    spark = texts.sparkSession
    listed = [tuple(r) for r in names.select("naam", "soort").filter("naam is not null").distinct().collect()]
    matches = lambda pattern, cued: F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("pair"), F.lit(cued).alias("cued")))
    pairs = texts.select(F.explode_outer(F.concat(matches(PAIR, False), matches(CUED, True))).alias("x")).select("x.*").filter("pair is not null")
    distinct = pairs.groupBy("pair").agg(F.max("cued").alias("cued"))

    def split(batches):
        for pdf in batches:
            out = []
            for pair, cued in zip(pdf["pair"], pdf["cued"]):
                words = pair.replace(",", "").split()
                given, sur = (words[-1], words[0]) if "," in pair else (words[0], words[-1])
                out += [(folded(given), s, cued) for s in folded(sur).split("-") if not {folded(given), s} & AFTER_DE]
            yield pd.DataFrame(out, columns=["given", "sur", "cued"])

    seen = distinct.mapInPandas(split, "given string, sur string, cued boolean")
    seen = written(seen.groupBy("given", "sur").agg(F.max("cued").alias("cued")), "pairs")
    firsts = [folded(n) for n, s in listed if s == "voornaam"]
    lasts = [folded(n) for n, s in listed if s == "achternaam"]

    def known(words, column):
        return spark.createDataFrame([(w,) for w in words], f"{column} string")

    def more(start, by, column):
        """The words of ``column`` that stand with enough of the words known in ``by``."""
        marked = seen.join(by.withColumn("known", F.lit(1)), by.columns[0], "left")
        counted = marked.groupBy(column).agg(F.count(F.lit(1)).alias("all"), F.count("known").alias("n"), F.count_if("cued").alias("named"))
        enough = ((F.col("n") >= min_partners) & (F.col("n") >= share * F.col("all"))) | ((F.col("named") > 0) & (F.col("named") >= share * F.col("all")))
        return counted.filter(enough).select(column).unionByName(start).distinct()

    given, sur = known(firsts, "given"), known(lasts, "sur")
    all_sur = more(sur, given, "sur")
    all_given = written(more(given, all_sur, "given"), "given")
    all_sur = written(more(sur, all_given, "sur"), "sur")
    size = bits_for(all_given.count() + 2 * all_sur.count())

    def set_bits(role):
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"p": [p for w in pdf["w"] for p in (surname_places(w, size) if role == "a" else places(w, role, size))]}, dtype="int64")

        return run

    block = min(size, 1 << 19)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(block, np.uint8)
        own[pdf["p"].to_numpy() % block] = 1
        return pd.DataFrame({"block": [int(pdf["p"].iloc[0]) // block], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    found = all_sur.select(F.col("sur").alias("w")).mapInPandas(set_bits("a"), "p long").unionByName(all_given.select(F.col("given").alias("w")).mapInPandas(set_bits("v"), "p long"))
    bits = bytearray(size // 8)
    for r in found.distinct().groupBy(F.floor(F.col("p") / block)).applyInPandas(packed, "block long, bits binary").toLocalIterator():
        bits[r.block * block // 8 : (r.block + 1) * block // 8] = r.bits
    return Lexicon(bytes(bits))


def find_values(df: DataFrame, keys: str | list[str], text: str, lexicon: Lexicon, key: bytes) -> DataFrame:
    """(keys, soort, waarde, pseudoniem), one row for each distinct value of a text that is replaced.

    Null and empty texts have none. A key column that repeats gets the values of all its texts. Keys
    come out as strings; a null key stays null. Other columns are not read. ``key`` is the secret of
    the pseudonyms.
    """
    keys = [keys] if isinstance(keys, str) else keys
    shared, secret = df.sparkSession.sparkContext.broadcast(lexicon.bits), checked(key)
    names = [f"_k{i}" for i in range(len(keys))]

    def run(batches):
        own, known = Lexicon(shared.value), Pseudonyms(secret)
        for pdf in batches:
            out = []
            for *k, t in pdf.itertuples(index=False):
                out += [(*k, kind, value, known.of(value, kind)) for kind, value in {(kind, t[start:end]) for start, end, kind in find(t, own)}]
            yield pd.DataFrame(out, columns=[*names, "soort", "waarde", "pseudoniem"])

    rows = df.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], F.col(text).alias("_t")).filter("_t is not null")
    found = rows.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", soort string, waarde string, pseudoniem string").distinct()
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "soort", "waarde", "pseudoniem")


def mask_values(df: DataFrame, text: str, lexicon: Lexicon, key: bytes, into: str | None = None, dates: bool = False) -> DataFrame:
    """``df`` with the text replaced (or the result in column ``into``); all other columns stay.

    ``key`` is the secret of the pseudonyms, without which nobody can undo them. ``dates`` also
    replaces valid dates, which are else left in the text.
    """
    shared, secret = df.sparkSession.sparkContext.broadcast(lexicon.bits), checked(key)

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = Lexicon(shared.value), Pseudonyms(secret)
        for batch in texts:
            yield pd.Series([replace(t, own, known, dates) for t in batch], dtype=object)

    return df.withColumn(into or text, masked(F.col(text)))
