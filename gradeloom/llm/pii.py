"""PII: format-preserving Feistel pseudonyms.

Values that validate (e-mail and IPv4 addresses, payment card numbers by issuer and check digit, IBANs, US social security
numbers, telephone numbers, calendar dates, credentials assigned in hexadecimal digits, passwords assigned in letters and digits,
and access key ids by their prefix) are replaced by keyed permutations of their own format: a card number becomes a card number with a right check digit and the same spacing, a date a date, and so
on. A permutation depends on the key and the kind alone, so equal values stay equal in every document, and the holder of the
key can turn a pseudonym back. Numbers that don't validate are left alone.

A kind's values are counted off as 0 to n - 1 and permuted by a Feistel network over two numbers whose product just covers n,
walking on while the result is n or more.

A card number is found beside other numbers too. Where several runs of the same groups of digits validate, one is taken by
its groups and length (see card_runs); a pseudonym that would make another one the one to take is permuted once more, so there
equal values can differ.

Spelling is kept: spaces of an IBAN, months' short names, days and months without zeros. All spellings share one permutation of
the days; one that can't write a pseudonym (a day without a zero has one digit) walks on to the first that it can. So equal dates
stay equal in one spelling, and in two wherever both can write the first pseudonym.

A telephone number keeps its country's code and its spacing, and is permuted by its digits, so it is one value in every spacing.

Defined cases: a null text stays null; an empty text has nothing; a very long text is searched whole; an empty table gives none; where kinds overlap the leftmost, then the one listed first
in KINDS wins (ties); repeated rows give equal results; result columns replace input columns of the same name.

Scale: one scan in the order of the input, no shuffle. Texts with no digit, @ or access key id are passed on without a look.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import logging
import math
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

log = logging.getLogger(__name__)

#: Stands for a deployment's own secret, which it passes as `key`.
DEMO_KEY = b"gradeloom-demonstration-key"
ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
MONTHS = [m for m in calendar.month_name if m]
MADE = ["n_found", "kinds"]
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

#: Kinds and how they look, in order of precedence; what looks so is then validated.
KINDS = {
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "secret_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret_word": r"(?i:passw(?:or)?d|passphrase|pwd|secret|api[_-]?key|access[_-]?key)[A-Za-z0-9_-]{0,16}[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?(?P<value>(?=[A-Za-z!@#$%^&*_+~-]*[0-9])(?=[0-9!@#$%^&*_+~-]*[A-Za-z])[A-Za-z0-9!@#$%^&*_+~-]{8,128})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2} ?[0-9]{2}(?: ?[A-Z0-9]){11,}(?![A-Za-z0-9])",
    "day_iso": r"(?<![0-9])(?:19|20)[0-9]{2}([-/])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?![0-9])",
    "day_dots": r"(?<![0-9.])(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.(?:19|20)[0-9]{2}(?![0-9])",
    "day_slashes": r"(?<![0-9/])[0-3]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}(?![0-9])",
    "day_words": r"(?<![0-9A-Za-z])(?:0?[1-9]|[12][0-9]|3[01]) (?:%(m)s) (?:19|20)[0-9]{2}(?![0-9])|(?<![A-Za-z])(?:%(m)s) (?:0?[1-9]|[12][0-9]|3[01]), (?:19|20)[0-9]{2}(?![0-9])" % {"m": "|".join([*MONTHS, *(rf"{m[:3]}\.?" for m in MONTHS if m != "May"), r"Sept\.?"])},
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}[ .-]?(?:\(0\)[ .-]?)?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{3}){0,2}(?:[ .-][0-9]{2}){1,5}(?![0-9])(?!\.[0-9]{1,2}\.)|(?<![0-9A-Za-z.-])(?<![0-9] )0[1-9]([ .-])[0-9]{2}(?:\2[0-9]{2}){3}(?![0-9])(?!\2[0-9]{2}(?![0-9/]))",
}
_SECRET_NAME = re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|credential|auth)[\w-]{0,16}\W{0,6}[=:]\W{0,6}$")
#: First digits of the card schemes; a pseudonym keeps them.
ISSUERS = re.compile("4|5[0-8]|6|3[04-8]|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)")
#: How many digits a scheme's numbers have, by first digits that a pseudonym keeps.
CARD_LENGTHS = [(re.compile(a), frozenset(n)) for a, n in (("4", (13, 16, 19)), ("5[1-5]|2", (16,)), ("3[47]", (15,)), ("3[068]", (14, 16, 17, 18, 19)), ("35", range(16, 20)), ("5|6", range(13, 20)))]
CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))})
#: The longest telephone numbers, without the country's code, where they are written in groups of two digits.
PHONE_LENGTHS = {"7": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "45": 8, "46": 9, "47": 8, "48": 9, "90": 10, "225": 10, "380": 9}
#: Country codes of two digits. 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}
_IBAN = re.compile("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
_IBAN_GROUP = re.compile("[A-Z0-9]+")
_DIGIT_GROUP = re.compile("[0-9]+")
LOOKS = {k: re.compile(v, re.ASCII) for k, v in KINDS.items()}


class Permutation:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.width = (max(self.a, self.b).bit_length() + 7) // 8 + 8
        self.seed = hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.sha256(key).digest()).digest()

    def _mask(self, k: int, half: int) -> int:
        out, block = b"", 0
        while len(out) < self.width:
            out += hashlib.blake2b(f"{k}|{block}|{half}".encode(), key=self.seed).digest()
            block += 1
        return int.from_bytes(out[: self.width], "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2:
                right = (right + (-1 if back else 1) * self._mask(k, left)) % self.b
            else:
                left = (left + (-1 if back else 1) * self._mask(k, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x


def luhn_digit(payload: str) -> str:
    total = sum(d if k % 2 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def country_code(digits: str) -> str:
    """The country's code that an international telephone number begins with, whatever its spacing."""
    return digits[:1] if digits[:1] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def _is_card(digits: str) -> bool:
    return bool(ISSUERS.match(digits)) and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def card_runs(digits: list[str], begin: int, end: int) -> list[tuple[bool, bool, int, int, int]]:
    """The runs of whole groups in digits[begin:end] that are card numbers, as (other than the usual groups, other than the
    scheme's length, distance from 16 digits, first group, end): where they overlap, the least is meant.

    Every run of 13 to 19 digits is looked at. One that is neither in the usual groups nor of its scheme's length counts only
    where no other group is beside it, as every tenth run of a list of numbers has a right check digit.
    """
    found = []
    for i in range(begin, end):
        run = ""
        for j in range(i, end):
            run += digits[j]
            if len(run) > 19:
                break
            if len(run) >= 13 and _is_card(run):
                odd = tuple(map(len, digits[i : j + 1])) not in CARD_GROUPS
                unusual = len(run) not in next(n for first, n in CARD_LENGTHS if first.match(run))
                if not (odd and unusual) or j + 1 - i == len(digits):
                    found.append((odd, unusual, abs(len(run) - 16), i, j + 1))
    return found


#: Days and months that a spelling can tell; a pseudonym in it is one of those, so that it is kept.
SPELT_DAYS = {"any": range(1, 32), "under 10": range(1, 10), "10 on": range(10, 32), "over 12": range(13, 32)}
SPELT_MONTHS = {"any": range(1, 13), "month under 10": range(1, 10), "month 10 on": range(10, 13), "not May": [m for m in range(1, 13) if m != 5], "September": [9]}


class Pseudonyms:
    """Replaces what validates; `back` turns pseudonyms back."""

    def __init__(self, key: bytes = DEMO_KEY, back: bool = False):
        self.key, self.back, self.known = key, back, {}
        self.permutation = functools.lru_cache(4096)(lambda tweak, n: Permutation(key, tweak, n))

    def _number(self, tweak: str, x: int, n: int) -> int:
        return self.permutation(tweak, n)(x, self.back)

    def _letters(self, tweak: str, text: str, alphabets=(DIGITS, LOWER, UPPER)) -> str:
        """Permutes the characters of these alphabets, each within its own; all together are one number."""
        own = [next((a for a in alphabets if c in a), None) for c in text]
        x, n = 0, 1
        for c, a in zip(text, own, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        x, out = self._number(tweak, x, n), []
        for c, a in zip(reversed(text), reversed(own), strict=True):
            if a:
                x, k = divmod(x, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))

    def _secret(self, value: str) -> str:
        """Digits stay digits; letters keep their case, where they share one, and with it both cases of a value are linked."""
        large, small = (any(c in letters for c in value) for letters in ("ABCDEF", "abcdef"))
        tweak, alphabet = ("secret mixed", HEX + "ABCDEF") if large and small else ("secret", HEX) if large or small else ("secret digits", DIGITS)
        new = value if large and small else value.lower()
        while True:  # permuted once more where it would look like another sort, so that it can be turned back
            new = self._letters(tweak, new, (alphabet,))
            if (any(c in "abcdef" for c in new) or not (large or small)) and (any(c in "ABCDEF" for c in new) or not (large and small)):
                return new.upper() if large and not small else new

    def _word(self, value: str) -> str:
        """Digits stay digits and letters letters of their case; hexadecimal ones stay so, and others don't become so."""
        is_hex = lambda x: all(c in HEX for c in x.lower() if c.isalpha())
        if is_hex(value):
            return self._letters("secret word in hex", value, (DIGITS, HEX[10:], HEX[10:].upper()))
        while True:
            value = self._letters("secret word", value)
            if not is_hex(value):
                return value

    def _spaced(self, made: str, like: str) -> str:
        found = iter(made)
        return "".join(next(found) if c.isalnum() else c for c in like)

    def _day(self, y: int, m: int, d: int, days: str = "any", months: str = "any") -> datetime.date | None:
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        while True:
            day = FIRST_DAY + self._number("day", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1)
            new = datetime.date.fromordinal(day)
            if new.day in SPELT_DAYS[days] and new.month in SPELT_MONTHS[months]:
                return new

    def _day_in_digits(self, y: str, m: str, d: str) -> tuple[str, str, str] | None:
        """Year, month and day, each as wide as it was."""
        wide = len(m) == len(d) == 2
        new = self._day(int(y), int(m), int(d), "any" if wide else "under 10" if int(d) < 10 else "10 on", "any" if wide else "month under 10" if int(m) < 10 else "month 10 on")
        return new and (str(new.year), f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}")

    def replace(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value that looks like that kind; None if it doesn't validate."""
        digits = re.sub("[^0-9]", "", value)
        if kind == "email":
            name, _, last = value.rpartition(".")
            return f"{self._letters('email', name)}.{last}"
        if kind == "secret":
            return self._secret(value)
        if kind == "secret_id":
            return value[:4] + self._letters("secret id", value[4:], (DIGITS + UPPER,))
        if kind == "secret_word":
            return self._word(value)
        if kind == "iban":
            plain = value.replace(" ", "")
            country, body = plain[:2], plain[4:]
            return None if _iban_check(country, body) != plain[2:4] else self._spaced(f"{country}{_iban_check(country, new := self._letters('iban', body))}{new}", value)
        if kind == "ip":
            x = self._number("ip", int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "ssn":
            a, g, s = map(int, value.split("-"))
            if a in (0, 666) or a > 899 or not g or not s:
                return None
            x = self._number("ssn", ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999)
            a, (g, s) = x // (99 * 9999), divmod(x % (99 * 9999), 9999)
            return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
        if kind == "card":
            if not _is_card(digits):
                return None
            issuer = ISSUERS.match(digits)
            while True:
                body = issuer[0] + self._letters("card", digits[issuer.end() : -1])
                digits = body + luhn_digit(body)
                if len(set(digits)) > 1:
                    return self._spaced(digits, value)
        if kind == "phone":
            code = country_code(digits) if value[0] == "+" else ""
            if "(0)" in value:
                code += "0"
            elif re.fullmatch("0[1-9](?:[ .-][0-9]{2}){4}", value):
                code = value[:2]
            if not 7 <= len(digits) - len(code) <= 12 or len(digits) > 15:
                return None
            return self._spaced(code + self._letters("phone", digits[len(code) :]), value)
        if kind == "day_iso":
            new = self._day_in_digits(*value.split(value[4]))
            return new and value[4].join(new)
        if kind == "day_dots":
            new = self._day_in_digits(*reversed(value.split(".")))
            return new and ".".join(reversed(new))
        if kind == "day_slashes":
            a, b, y = value.split("/")
            if not int(a) or not int(b):
                return None
            if int(a) <= 12:
                new = self._day_in_digits(y, a, b)
                return new and f"{new[1]}/{new[2]}/{new[0]}"
            # the day first, as it can't be a month: among such days
            new = self._day(int(y), int(b), int(a), "over 12", "any" if len(b) == 2 else "month under 10")
            return new and f"{new.day:02d}/{new.month:0{len(b)}d}/{new.year}"
        if kind == "day_words":
            a, b, y = value.replace(",", "").split()
            d, m = (a, b) if a.isdigit() else (b, a)
            name = m.rstrip(".")
            months = "any" if name in MONTHS else "September" if name == "Sept" else "not May"
            number = [n[:3] for n in MONTHS].index(name[:3]) + 1
            new = self._day(int(y), number, int(d), "under 10" if d[0] == "0" else "any", months)
            if not new:
                return None
            spelt = MONTHS[new.month - 1]
            m = (spelt if months == "any" else spelt[: len(name)]) + m[len(name) :]
            d = f"{new.day:0{len(d) if d[0] == '0' else 1}d}"
            return f"{d} {m} {new.year}" if a.isdigit() else f"{m} {d}, {new.year}"
        raise ValueError(kind)

    def cards(self, text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
        """(begin, end, pseudonym) of the card numbers among groups of digits.

        A pseudonym that would make another run the one that is meant is permuted once more, so that it is found again.
        """
        spans = [m.span() for m in _DIGIT_GROUP.finditer(text, begin, end)]
        digits, owner, out = [text[b:e] for b, e in spans], {}, []
        for run in sorted(card_runs(digits, 0, len(digits))):
            if not any(g in owner for g in range(*run[3:])):
                owner |= dict.fromkeys(range(*run[3:]), run)
        chosen = sorted(set(owner.values()), reverse=self.back)
        for run in chosen:
            i, j = run[3:]
            new = text[spans[i][0] : spans[j - 1][1]]
            while True:
                new = self._known("card", new)
                digits[i:j] = _DIGIT_GROUP.findall(new)
                better = [r for r in card_runs(digits, max(0, i - 18), min(len(digits), j + 18)) if r < run and r[3] < j and r[4] > i]
                if all(any(owner.get(g, r) < r for g in range(*r[3:])) for r in better):
                    break
            out.append((spans[i][0], spans[j - 1][1], new))
        return out

    def ibans(self, text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
        """(begin, end, pseudonym) of the IBANs among groups of capitals and digits.

        With spaces inside, a country's IBANs have its length; those of other countries are in groups of four.
        """
        spans, out, i = [m.span() for m in _IBAN_GROUP.finditer(text, begin, end)], [], 0
        while i < len(spans):
            found, plain = None, ""
            for j in range(i, len(spans)):
                plain += text[slice(*spans[j])]
                if len(plain) > 34:
                    break
                length = IBAN_LENGTHS.get(plain[:2])
                fits = j == i or (len(plain) == length if length else all(e - b == 4 for b, e in spans[i:j]))
                if len(plain) >= 15 and fits and _IBAN.match(plain) and (new := self._known("iban", text[spans[i][0] : spans[j][1]])):
                    found = (j, new)
            if found:
                out.append((spans[i][0], spans[found[0]][1], found[1]))
            i = found[0] + 1 if found else i + 1
        return out

    def phones(self, text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
        """(begin, end, pseudonym); groups of two digits beyond a country's longest number are not of it."""
        value = text[begin:end]
        code = country_code(re.sub("[^0-9]", "", value)) if value[0] == "+" else ""
        while code and len(re.sub(r"\(0\)|[^0-9]", "", value)) - len(code) > PHONE_LENGTHS.get(code, 15) and value[-3] in " .-":
            value = value[:-3]
        new = self._known("phone", value)
        return [(begin, begin + len(value), new)] if new else []

    def _known(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[kind, value] = self.replace(kind, value)
        return self.known[kind, value]

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(begin, end, kind, pseudonym) of all values, from left to right."""
        found = []
        for order, (kind, look) in enumerate(LOOKS.items()):
            if (kind == "email" and "@" not in text) or (kind == "secret_word" and "=" not in text and ":" not in text):
                continue
            part = "value" if "value" in look.groupindex else 0
            for m in look.finditer(text):
                if kind == "secret" and not _SECRET_NAME.search(text, max(0, m.start() - 48), m.start()):
                    continue
                within = {"card": self.cards, "iban": self.ibans, "phone": self.phones}.get(kind)
                for begin, end, new in within(text, *m.span()) if within else [(*m.span(part), self._known(kind, m[part]))]:
                    if new is not None:
                        found.append((begin, order, end, kind.split("_")[0], new))
        out, end = [], 0
        for begin, _, stop, kind, new in sorted(found):
            if begin >= end:
                out.append((begin, stop, kind, new))
                end = stop
        return out

    def apply(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found, parts, at = self.find(text), [], 0
        for begin, end, _, new in found:
            parts += [text[at:begin], new]
            at = end
        return "".join([*parts, text[at:]]), found


#: A text without a match has no value. Access key ids may have no digit.
_LOOK_AT = re.compile("[0-9@]|A[KS]IA[A-Z]{16}")


KEY_SETTING = "spark.gradeloom.pii.key"


def secret_key(spark: SparkSession) -> bytes:
    """The key that the session names in KEY_SETTING. Where it names none a local session (tests) gets the demonstration key, which anyone
    can read here, so that anyone can turn its pseudonyms back; a session on a cluster gets an error."""
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"pseudonyms need a secret key: pass one, or name it in {KEY_SETTING}")
    return DEMO_KEY


_made: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """As secret_key(), but a session on a cluster that names no key gets one of its own, made at random and kept by this process alone.

    So a job that passes no key runs whole, its pseudonyms agree within the session, and nobody who reads this can turn them back. Those of
    two sessions agree, and can be turned back later, only where a key is named.
    """
    if spark.sparkContext.master.startswith("local") or spark.conf.get(KEY_SETTING, None):
        return secret_key(spark)
    own = spark.sparkContext.applicationId
    if own not in _made:
        log.warning("%s names no key: pseudonyms are made with a random one of this session", KEY_SETTING)
    return _made.setdefault(own, secrets.token_bytes(32))


def pseudonymise(docs: DataFrame, *, key: bytes | None = None, text: str = "text", back: bool = False, report: bool = True) -> DataFrame:
    """docs with the text's values replaced; with report also n_found and kinds (names and counts, sorted). Without a key, see secret_key()."""
    key = key or secret_key(docs.sparkSession)
    keep = C.others(docs, [text, *(MADE if report else [])])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).toDF(*[f"c{k}" for k in range(len(keep))], "__text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__text", T.StringType()), T.StructField("__n_found", T.LongType()), T.StructField("__kinds", T.MapType(T.StringType(), T.LongType()))])

    def step(batches):
        names = Pseudonyms(key, back)
        for b in batches:
            texts, counts, kinds = b.column(b.num_columns - 1).to_pylist(), [0] * b.num_rows, [[] for _ in range(b.num_rows)]
            for k, x in enumerate(texts):
                if x and _LOOK_AT.search(x):
                    texts[k], found = names.apply(x)
                    counts[k] = len(found)
                    own = [f[2] for f in found]
                    kinds[k] = [(n, own.count(n)) for n in sorted(set(own))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))], names=schema.names)

    found = source.mapInArrow(step, schema)
    columns = [F.col("__text" if c == text else f"c{keep.index(c)}").alias(c) for c in docs.columns if c == text or c in keep]
    return found.select(*columns, *([F.col(f"__{m}").alias(m) for m in MADE] if report else []))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return pseudonymise(docs, key=DEMO_KEY).select("doc_id", "text", "n_found", kinds.alias("kinds"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
