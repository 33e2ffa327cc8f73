"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and account numbers, US
social security numbers, IBANs, secrets assigned to a name such as token or password, and personal
names (honorifics or phrases such as "my name is" with up to three capitalised words, or known given
names with a surname; after that the parts alone, in the same document). Digits of any script count as
digits, and a surrogate is written in the digits of its original.

A surrogate keeps type, script, case, length and format: each character is replaced inside its class
(digit, vowel or consonant of its script, hexadecimal digit; letters of other scripts by letters of
the same script, case and neighbourhood), given names by names of the same script and gender, and check
digits hold if they held. The replacement is a keyed permutation
without fixed points of all values of one format, so no two entities share a surrogate, none keeps
its value, and one entity has one surrogate in every document, on every machine, without a shared
table. ``collisions`` checks this over a corpus, and ``with_collisions`` for each row. A value of which no
character has a class, such as the local part `%%` before a reserved domain, becomes a keyed digest instead.

Defined results. A null text stays null and an empty one empty; texts without entities stay as they
are, to the byte. Where detections overlap, the one that begins first wins, then the longer one.
Repeated rows get equal results. Very long texts are read whole. An empty table gives an empty
result. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, give_back, small_batches, stage

KEY = "surrogates-1"
_CACHED = 200_000
#: Kinds that are written with or without separators.
_SEPARATED = ("phone", "card", "iban")
_SEPARATORS = re.compile(r"[ .()-]")
_PIECE = 512  # characters of a secret that are permuted at a time

#: Classes of characters that replace each other; the first that holds a character counts.
VOWELS = ("aeiou", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "аеёиоуыэюя", "αεηιουωάέήίόύώ")
CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "çñýšžčřďťňłśźć", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρσςτφχψ")
DIGITS = "0123456789"
HEX = "0123456789abcdef"

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Sofia Julia Emma Laura Sarah Lena Claire Elena Carmen Lucia Ingrid Alice Martha Helen Katharina Isabel Camille Monika Teresa Paula Emily Nora".split(),
    ("latin", "m"): "Peter Thomas Martin Daniel Michael Stefan Lukas Jan Pierre Carlos Miguel Juan Erik David Robert James Andreas Pablo Julien Markus Diego Luis John Oscar".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Дарья".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Павел Владимир".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης".split(),
}
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra господин госпожа Κύριος Κυρία".split()
_BY_NAME = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
#: Phrases after which two or three capitalised words are a name.
INTRODUCTIONS = (
    "my name is", "my name's", "I am called", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es",
    "меня зовут", "με λένε", "name:", "Name:", "nom:", "nombre:", "signed by", "signed,", "Signed:", "regards,", "sincerely,", "Sincerely,", "Grüßen,", "Cordialement,", "Atentamente,",
)
_CLUES = frozenset(_BY_NAME) | frozenset(HONORIFICS)
_WORDS = re.compile(r"[^\W\d_]+")
_UPPER = "".join(c for c in map(chr, range(0x41, 0x2000)) if c.isupper())
_CAPITAL = rf"(?:[{_UPPER}][^\W\d_]+(?:[-'’][{_UPPER}]?[^\W\d_]+)?)"
_LISTED = "|".join(_BY_NAME)
_INTRODUCED = re.compile(rf"(?:{'|'.join(map(re.escape, INTRODUCTIONS))})[ \t]*\n?[ \t]*(?P<name>{_CAPITAL}(?: {_CAPITAL}){{1,2}})(?![^\W_])")
_NAME = re.compile(
    rf"\b(?:(?:(?:{'|'.join(HONORIFICS)})\b\.? )+(?P<titled>{_CAPITAL}(?: {_CAPITAL}){{0,2}})|(?P<listed>(?:{_LISTED})(?: (?:{_LISTED}))*) (?P<family>{_CAPITAL}))\b"
)

_LOCAL = re.compile(r"[\w.%+\-]*[\w%+\-]\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
_NUMBER = re.compile(
    r"(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9]))"
    r"|(?P<card>(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?![\w]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?:[.-][0-9]{2,4})?(?![\w-]|\.[0-9]))"
    r"|(?P<phone2>(?<![\w.+])(?:\+[0-9]{8,14}|(?:\+[0-9]{2} ?|0)[0-9](?:[ .-][0-9]{2}){4})(?!\w))"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Candidates, which ``ipaddress`` judges.
_IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9a-fA-F]{0,4}:){2,7}(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})(?![\w:]|\.[0-9])")
_SECRET = re.compile(
    r"(?<![^\W_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\b[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:\"(?P<a>[^\s\"]{6,})\"|'(?P<b>[^\s']{6,})'|(?P<c>[A-Za-z\d_\-+/=.]{16,}))", re.IGNORECASE)  # fmt: skip
_SECRET_CLUE = re.compile(r"token|secret|passw|pwd|key|auth", re.IGNORECASE)
_DIGIT_CLUE = re.compile(r"[0-9][0-9 ().-]{5}|[0-9]:")
_DIGITS_OF_SCRIPTS = {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
_OTHER_DIGIT = re.compile(r"(?![0-9])\d")
#: Issuers' first digits with their numbers' lengths (fixed values): a bare run of digits that has them is a card.
_ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720))\d{12}|3[47]\d{13}|6(?:011|4[4-9]\d|5\d\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}")


class Permutation:
    """Keyed permutations without fixed points of range(n), for any n above 1."""

    def __init__(self, key: str) -> None:
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tag: bytes, k: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(tag + bytes([k, block & 255]) + x.to_bytes(size, "big"), key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _feistel(self, tag: bytes, x: int, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for k in reversed(range(6)) if back else range(6):
            if back:
                left, right = right ^ self._round(tag, k, left, bits), left
            else:
                left, right = right, left ^ self._round(tag, k, right, bits)
        return left << bits | right

    def _walk(self, tag: bytes, x: int, n: int, back: bool) -> int:
        bits = ((n - 1).bit_length() + 1) // 2
        while True:
            x = self._feistel(tag, x, bits, back)
            if x < n:
                return x

    def __call__(self, tag: str, x: int, n: int) -> int:
        """Shifts x between two passes of a permutation and its inverse: a permutation that moves every value."""
        name = f"{tag}/{n}".encode()
        shift = 1 + int.from_bytes(hashlib.blake2b(name, key=self.key, digest_size=16).digest(), "big") % (n - 1)
        return self._walk(name, (self._walk(name, x, n, False) + shift) % n, n, True)


def _lower(c: str) -> str:
    return low if len(low := c.lower()) == 1 else c


@lru_cache(maxsize=1 << 16)
def _class_of(c: str) -> str:
    """The characters that may replace one: a listed class, or those of its script and category near it."""
    listed = (DIGITS, *VOWELS, *CONSONANTS)
    for chars in listed:
        if c in chars:
            return chars
    if not c.isalpha() and not c.isdecimal():
        return ""
    known, kind, script = set("".join(listed)), unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
    near = map(chr, range(ord(c) & ~0x7F, (ord(c) & ~0x7F) + 0x80))
    own = [x for x in near if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and _lower(x) == x and x not in known]
    return "".join(own) if len(own) > 1 and c in own else ""


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: str = KEY) -> None:
        self.permute, self.key = Permutation(key), key.encode()
        self.known: dict[tuple[str, str], str] = {}

    def __call__(self, kind: str, text: str) -> str:
        found = self.known.get((kind, text))
        if found is None:
            if len(self.known) >= _CACHED:
                self.known.clear()
            found = getattr(self, kind)(text)
            if found == text:  # nothing in it has a class
                digest = hashlib.blake2b(f"{kind}/{text}".encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=8).hexdigest()
                found = f"{digest}@{text.rpartition('@')[2]}" if kind == "email" else digest
            self.known[kind, text] = found
        return found

    def entity_id(self, kind: str, text: str) -> str:
        """A keyed digest that stands for the entity, however it is written."""
        return hashlib.blake2b(f"{kind}/{self._canonical(kind, text)}".encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=12).hexdigest()

    @staticmethod
    def _canonical(kind: str, text: str) -> str:
        """One writing of the entity: without separators where they are free, IPv6 in full."""
        if kind in _SEPARATED:
            return _lower_all(_compact(text))
        return ":".join(_ipv6_groups(text)) if kind == "ipv6" else _lower_all(text)

    def chars(self, kind: str, text: str, classes: Callable[[int, str], str], fits: Callable[[str], bool] = lambda _: True, shout: bool | None = None) -> str:
        """Replaces characters inside their classes ('' keeps one). `fits` may restrict both originals
        and surrogates to a subset of a format; the permutation is then walked until it is met."""
        low = [_lower(c) for c in text]
        own = [classes(i, c) for i, c in enumerate(low)]
        n, x = 1, 0
        for c, chars in zip(low, own, strict=True):
            if chars:
                n, x = n * len(chars), x * len(chars) + chars.index(c)
        if n < 2:
            return text
        tag = f"{kind}/" + "".join(chars[0] if chars else f"={c}" for c, chars in zip(low, own, strict=True))
        while True:
            x = y = self.permute(tag, x, n)
            new = list(low)
            for i in reversed(range(len(low))):
                if own[i]:
                    y, k = divmod(y, len(own[i]))
                    new[i] = own[i][k]
            if fits("".join(new)):
                break
        shout = text.isupper() if shout is None else shout  # digits that become letters follow the whole text's case
        upper = (n.upper() if (o != l or shout and not o.isalpha()) and len(n.upper()) == 1 else n for n, o, l in zip(new, text, low, strict=True))
        return "".join(upper)

    def email(self, text: str) -> str:
        """The domain keeps a reserved ending, or gets one after its own last label."""
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        reserved = len(labels) > 1 and _lower_all(labels[-2]) == "example" and _lower_all(labels[-1]) in ("com", "net", "org")
        kept = 2 if reserved else 1
        hosts = [self.chars("label", x, lambda _, c: _class_of(c)) for x in labels[:-kept]]
        ending = labels[-kept:] + ([] if reserved else ["EXAMPLE" if text.isupper() else "example"])
        return self.chars("local", local, lambda _, c: _class_of(c)) + "@" + ".".join([*hosts, *ending])

    def _digits(self, kind: str, text: str, start: int = 0) -> str:
        """A zero that begins a group of digits stays, and no other digit becomes one."""

        def of(i: int, c: str) -> str:
            if i < start or not ("0" <= c <= "9"):
                return ""
            first = i == 0 or not text[i - 1].isdigit()
            return ("" if c == "0" else DIGITS[1:]) if first else DIGITS

        return self.chars(kind, text, of)

    def phone(self, text: str) -> str:
        """The country code stays. A zero that begins the rest stays, and no other digit becomes one there."""
        own = _compact(text)
        code = re.match(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", own)
        start = code.end() if code else 0
        of = lambda i, c: "" if i < start or i == start and c == "0" else DIGITS[1:] if i == start else DIGITS
        return _laid_over(text, self.chars("phone", own, of))

    def ssn(self, text: str) -> str:
        return self._digits("ssn", text)

    def card(self, text: str) -> str:
        """The first digit stays, and the last one differs from the right check digit as before."""
        own = _compact(text)
        off = (int(own[-1]) - _luhn(own[:-1])) % 10
        new = self.chars("card", own[:-1], lambda i, c: DIGITS if i else "")
        return _laid_over(text, new + str((_luhn(new) + off) % 10))

    def iban(self, text: str) -> str:
        """Country and check digits' validity are kept."""
        own = _compact(text)
        off = (int(own[2:4]) - _mod97(own[4:], own[:2])) % 97
        classes = lambda i, c: "" if i < 4 else DIGITS if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else ""
        new = self.chars("iban", own, classes)
        check = (_mod97(new[4:], new[:2]) + off) % 97
        return _laid_over(text, f"{new[:2]}{check:02d}{new[4:]}")

    def ipv4(self, text: str) -> str:
        """Private addresses stay private, others stay out of private and reserved ranges if they were."""
        kind = _ip_kind(text)
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        while True:
            x = self.permute(f"ipv4/{kind}", x, 1 << 32)
            new = ".".join(map(str, x.to_bytes(4, "big")))
            if _ip_kind(new) == kind:
                return new

    def ipv6(self, text: str) -> str:
        """The first group stays if others follow, and zeros do; each group keeps its digits' number."""
        groups = _ipv6_groups(text)
        first = len(groups[0]) + 1 if groups[0] != "0" and set(groups[1:]) != {"0"} else 0
        canonical = ":".join(groups)

        def of(i: int, c: str) -> str:
            if i < first or c == ":":
                return ""
            return HEX if i and canonical[i - 1] != ":" else "" if c == "0" else HEX[1:]

        new = [int(g, 16) for g in self.chars("ipv6", canonical, of).split(":")]
        head, gap, tail = text.partition("::")

        def written(part: str, at: int) -> str:
            out = []
            for g in part.split(":") if part else []:
                if "." in g:
                    out.append(".".join(str(x) for two in new[at : at + 2] for x in divmod(two, 256)))
                else:
                    out.append(f"{new[at]:0{len(g)}x}")
                    at += 1
            return ":".join(out)

        found = written(head, 0) + gap + written(tail, 8 - len(tail.split(":")) - ("." in tail))
        return found.upper() if re.search("[A-F]", text) else found

    def secret(self, text: str) -> str:
        """Long ones are permuted in pieces, each under a key that all before it decide: a permutation of the whole."""
        low = _lower_all(text)
        kind, of = "secret", lambda _, c: DIGITS if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else _class_of(c)
        if re.fullmatch(r"[\da-f]+", low):
            kind, of = "hex", lambda _, c: HEX
        before, out = hashlib.blake2b(digest_size=16), []
        for at in range(0, len(text), _PIECE):
            tag = f"{kind}/{before.hexdigest()}" if at else kind
            out.append(self.chars(tag, text[at : at + _PIECE], of, shout=text.isupper()))
            before.update(low[at : at + _PIECE].encode("utf-8", "surrogatepass"))
        return "".join(out)

    def given(self, text: str) -> str:
        if text not in _BY_NAME:
            return self.family(text)
        group, i = _BY_NAME[text]
        return GIVEN[group][self.permute(f"given/{group}", i, len(GIVEN[group]))]

    def family(self, text: str) -> str:
        """Vowels stay vowels and consonants consonants; endings that show gender stay."""
        ending = re.search(r"(?:[оеё]ва?|ина?|ская|ский|ова|ová)$", text.lower())
        to = ending.start() if ending and ending.start() > 1 else len(text)
        return self.chars("family", text[:to], lambda _, c: _class_of(c), lambda new: new.capitalize() not in _BY_NAME) + text[to:]


def _lower_all(text: str) -> str:
    return "".join(map(_lower, text))


def _compact(text: str) -> str:
    return _SEPARATORS.sub("", text)


def _laid_over(text: str, new: str) -> str:
    """The characters of `new` with the separators of `text` between them."""
    chars = iter(new)
    return "".join(c if _SEPARATORS.match(c) else next(chars) for c in text)


def _luhn(payload: str) -> int:
    """The right check digit after the payload's digits."""
    total = 0
    for k, c in enumerate(reversed([c for c in payload if c.isdigit()])):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(account: str, country: str) -> int:
    """The right check digits of an IBAN, by ISO 7064."""
    letters = "".join(str(int(c, 36)) for c in account.replace(" ", "").lower() + country.lower() + "00")
    return 98 - int(letters) % 97


def _ip_kind(text: str) -> str:
    a, b, *_ = map(int, text.split("."))
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return f"private{a}"
    return "reserved" if a in (0, 127) or a >= 224 or (a == 169 and b == 254) else "public"


def _ipv6_groups(text: str) -> list[str]:
    """The eight groups in lower case without leading zeros."""
    packed = ipaddress.IPv6Address(text).packed
    return [f"{int.from_bytes(packed[i : i + 2], 'big'):x}" for i in range(0, 16, 2)]


def _is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text) != ipaddress.IPv6Address("::")
    except ValueError:
        return False


def _local_start(text: str, at: int, least: int) -> int | None:
    """Where the local part that ends before `at` begins, not before `least`."""
    span = 64
    while True:
        begin = max(least, at - span)
        found = _LOCAL.search(text[begin:at])
        if not found:
            return None
        if found.start() or begin == least:
            start = begin + found.start()
            while text[start] == "." and start < at - 1:
                start += 1
            return start
        span *= 8


def _is_card(text: str) -> bool:
    """Digits in groups, the usual 16 digits, a right check digit, or an issuer's digits and length."""
    own = _compact(text)
    return own != text or len(own) == 16 or int(own[-1]) == _luhn(own[:-1]) or bool(_ISSUED.fullmatch(own))


def plain_digits(text: str) -> str:
    """The text with the digits of all scripts as ASCII digits, place by place."""
    return text.translate(_DIGITS_OF_SCRIPTS) if _OTHER_DIGIT.search(text) else text


def _in_digits_of(text: str, new: str) -> str:
    """The ASCII digits of `new` in the script of the text's digits."""
    other = _OTHER_DIGIT.search(text)
    if not other:
        return new
    zero = ord(other[0]) - unicodedata.decimal(other[0])
    return new.translate({48 + d: chr(zero + d) for d in range(10)})


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    at, least = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = _local_start(text, at, least) if domain else None
        if start is not None:
            found.append((start, domain.end(), "email"))
        least = at + 1
        at = text.find("@", at + 1)
    text = plain_digits(text)
    if _DIGIT_CLUE.search(text):
        for m in _NUMBER.finditer(text):
            kind = "phone" if m.lastgroup == "phone2" else m.lastgroup
            if kind != "card" or _is_card(m[0]):
                found.append((m.start(), m.end(), kind))
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    if ("=" in text or ":" in text) and _SECRET_CLUE.search(text):
        found += [(*m.span(m.lastgroup), "secret") for m in _SECRET.finditer(text)]
    names = []
    if not _CLUES.isdisjoint(_WORDS.findall(text)):
        names = [m["titled"] or f"{m['listed']} {m['family']}" for m in _NAME.finditer(text)]
    if any(phrase in text for phrase in INTRODUCTIONS):
        names += [m["name"] for m in _INTRODUCED.finditer(text)]
    parts: dict[str, str] = {}
    for name in names:
        *given, family = name.split(" ")
        parts |= dict.fromkeys(given, "given") | {family: "family"}
    if parts:
        alone = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, parts), key=len, reverse=True))})\b")
        found += [(m.start(), m.end(), "given" if m[0] in _BY_NAME else parts[m[0]]) for m in alone.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple]]:
    """The text with surrogates, and (kind, start, end, surrogate, entity id) of each, start and end in the old text."""
    entities, out, at = [], [], 0
    for start, end, kind in detect(text):
        written = text[start:end]
        own = plain_digits(written)
        new = _in_digits_of(written, surrogates(kind, own))
        entities.append((kind, start, end, new, surrogates.entity_id(kind, own)))
        out += [text[at:start], new]
        at = end
    return ("".join([*out, text[at:]]), entities) if entities else (text, entities)


_ENTITIES = "array<struct<kind:string,start:int,end:int,surrogate:string,entity_id:string>>"


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """row (a struct of all columns), text (with surrogates) and entities of every row."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(f"text string, entities {_ENTITIES}")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(key)
        for texts in batches:
            found = [(None, []) if t is None else replace(t, surrogates) for t in texts]
            yield pd.DataFrame({"text": [x[0] for x in found], "entities": [[dict(zip(("kind", "start", "end", "surrogate", "entity_id"), e, strict=True)) for e in x[1]] for x in found]})
        surrogates = found = texts = None
        give_back()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("found", each(F.col(f"row.`{text_col}`").cast("string")))
    return rows.select("row", "found.text", "found.entities")


def _one_writing(kind: str, surrogate: str) -> Column:
    """Surrogates are compared without separators where those are free."""
    low = F.lower(surrogate)
    return F.when(F.col(kind).isin(*_SEPARATED), F.regexp_replace(low, _SEPARATORS.pattern, "")).otherwise(low)


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for several entities: none, unless detection or
    keys were mixed. Entities are compared by their keyed digests; both are combined before the shuffle."""
    each = replaced.select(F.explode("entities").alias("e")).select("e.kind", _one_writing("e.kind", "e.surrogate").alias("surrogate"), "e.entity_id")
    found = each.groupBy("kind", "surrogate").agg(F.min("entity_id").alias("least"), F.max("entity_id").alias("most"), F.count(F.lit(1)).alias("n"))
    return found.filter("least <> most").select("kind", "surrogate", "n")


def with_collisions(replaced: DataFrame) -> DataFrame:
    """Adds `collisions`: how many of a row's entities have a surrogate that stands for another entity too.

    The corpus is read once more for the check. Where it finds nothing, as the permutations promise, no
    row has to be joined."""
    found = stage(collisions(replaced), "collisions")
    n = found.count()
    if not n:
        return replaced.withColumn("collisions", F.lit(0).cast("long"))
    rows = stage(replaced.withColumn("_rid", F.monotonically_increasing_id()), "replaced")
    each = rows.select("_rid", F.explode("entities").alias("e")).select("_rid", "e.kind", _one_writing("e.kind", "e.surrogate").alias("surrogate"))
    hits = each.join(broadcast_if_small(found.select("kind", "surrogate"), n), ["kind", "surrogate"], "left_semi").groupBy("_rid").agg(F.count(F.lit(1)).alias("collisions"))
    return rows.join(hits, "_rid", "left").select(*replaced.columns, F.coalesce("collisions", F.lit(0).cast("long")).alias("collisions"))
