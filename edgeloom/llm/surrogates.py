"""Operator 4: personal data replaced by keyed surrogates.

Entities are found by patterns: e-mail addresses, phone numbers, card and account
numbers, IP addresses, social security numbers, IBANs, passport numbers and dates of
birth next to a word that tells them, street addresses, access tokens next to a
word such as ``token``, names after a title, names that begin with a first name of the
lexicon and names written as ``Surname, First``, with all further mentions of their words in the
same document.  Card numbers have a valid check digit or a word such as ``card`` ahead of them;
book numbers and version numbers are no entities; a word of a name that is also a month or a
day stays where a preposition or a number makes it one.  Digits of any script, no-break
blanks and full-width signs count as their plain forms.  An entity's surrogate is a keyed
permutation of its own format: every character is drawn from the same alphabet
(script, case, digit, vowel, usual or rare consonant), a valid check digit stays valid, a first
name of the lexicon becomes one of the same gender and script, a surname of the lexicon one of
its script (and, where it shows it, gender), a date of birth one of its decade, punctuation
and words such as ``Street`` stay.  A
permutation maps distinct entities of a format to distinct surrogates, and the same
entity, however it is written (case, separators, country code), to the same one.

What a permutation cannot rule out is a surrogate that is itself an entity of the
corpus, and clashes after a retry.  So all distinct entities are gathered by
aggregation, such surrogates, and those equal to the entity itself, are drawn again
with the next tweak, and the check is repeated until none is left; from tweak
``NARROW`` on, in a longer format (more letters or digits, composite first names), so a
format whose members are all taken does not end the search.  If some are still left
after ``ROUNDS`` rounds (card numbers, IBANs and IP addresses have one length only), it
raises with their number.  Dates of birth are left out of this check, as a corpus holds each
day of a decade: their permutation is one cycle, so none stays.  The few entities with a tweak are broadcast if they
are at most ``BROADCAST_ROWS``, else they are joined to the documents that hold them.

The key is an argument, else the session's ``spark.edgeloom.surrogates.key``; where neither
is set, a random key is drawn and kept in the session, so all calls of an application agree
and nobody else can undo them.

Defined cases: null text stays null, text without entities stays as it is;
overlapping finds count once, the earlier and then the longer; repeated rows get
equal texts; an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from edgeloom.llm.runtime import cut, ship, stored, table

KEY_SETTING = "spark.edgeloom.surrogates.key"
BROADCAST_ROWS = 100_000
ROUNDS = 20
#: Tweaks below this keep the length of the entity; each second one from here on adds to it.
NARROW = 4

FEMALE = (
    "Alice Amelie Andrea Angela Anita Anna Antonia Barbara Beatriz Carla Carmen Caroline Catherine Charlotte Clara Claudia Cristina Diana Elena Elisabeth Elizabeth Emily Emma Eva Fatima "
    "Francesca Greta Hannah Helen Helga Ines Ingrid Isabel Jane Jennifer Jessica Johanna Julia Karin Kavita Laura Linda Lucia Margaret Maria Marie Marta Mary Michelle Monika Nathalie Nora Olga "
    "Olivia Patricia Paula Petra Priya Rachel Rosa Ruth Sabine Sandra Sarah Silvia Sofia Sophie Sunita Susan Svetlana Teresa Ursula Valentina Victoria Yasmin Yvonne"
).split()
MALE = (
    "Adam Ahmed Alain Alexander Amit Andrew Anthony Antonio Arjun Boris Brian Bruno Carlos Charles Christian Daniel David Diego Dmitri Edward Emil Felix Fernando Francisco Georg George "
    "Hans Hassan Henry Hugo Ibrahim Ivan Jacob James Javier John Jorge José Joseph Juan Karl Kevin Klaus Luis Manuel Marc Martin Matthew Michael Miguel Mohammed Nikolai Omar "
    "Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Rajesh Ricardo Richard Robert Sanjay Sergio Stefan Steven Suresh Thomas Uwe Vijay Vladimir Walter William Wolfgang Yusuf"
).split()
FEMALE_CYRILLIC = "Анастасия Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Нина Ольга Светлана София Татьяна Юлия".split()
MALE_CYRILLIC = "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Михаил Николай Олег Павел Пётр Сергей Юрий".split()
SURNAMES = (
    "Adams Allen Anderson Bailey Baker Bauer Becker Bernard Bianchi Brown Campbell Carter Castro Clark Collins Cooper Costa Davies Davis Delgado Díaz Dubois Dupont Durand Edwards Evans "
    "Fernández Ferrari Fischer Fournier García Garnier Gómez González Graham Green Gupta Hall Harris Herrera Hill Hoffmann Hughes Iglesias Jackson Jiménez Johnson Jones Keller Kelly "
    "Khan Klein Koch Krüger Kumar Lambert Lefebvre Leroy Lewis López Martínez Mehta Meyer Mitchell Moore Morales Moreau Morris Müller Navarro Nguyen Novak Ortega Parker Patel Pérez "
    "Phillips Ramírez Reddy Richter Rivera Roberts Rodríguez Romero Rossi Roussel Ruiz Sánchez Schäfer Schmidt Schneider Schröder Schulz Schwarz Sharma Silva Singh Smith Suárez "
    "Taylor Thompson Torres Turner Vargas Vidal Wagner Walker Weber Williams Wilson Wright Zimmermann"
).split()
SURNAMES_CYRILLIC = "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Орлов Макаров Никитин Захаров".split()

_TITLES = (
    "(?:Mr|Mrs|Ms|Mx|Miss|Madam|Dr|Dra|Prof|Professor|Herr|Herrn|Frau|Fräulein|Monsieur|Madame|Mademoiselle|Mme|Mlle|M(?=[.])|Señor|Señora|Señorita|Sra|Srta|Sr|"
    "господин|госпожа|Господин|Госпожа|г-н|г-жа|Г-н|Г-жа|κύριος|κυρία|Κύριος|Κυρία|κ(?=[.])|السيد|السيدة|الدكتور|الدكتورة)"
)
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_WORD = re.compile(rf"\s(?P<v>[^\W\d_]\.(?=\s)|{_NAME})")
#: Small words inside a name; they stay as they are.
_PARTICLES = frozenset("von van der den de del della di da do dos du la le las los y zu zum zur ter ten bin ibn al el".split())
_PHONE_WORDS = r"(?:tel|tél|telephone|téléphone|telefon|telefono|teléfono|phone|ph|mobile|mobil|móvil|movil|cell|portable|handy|fax|whatsapp|call|ring|rufnummer|appelez|llame)"

#: Words ahead of a date of birth, months, words of streets.
_BIRTH_WORDS = r"date of birth|d\.?o\.?b\.?|born(?: on)?|geboren(?: am)?|geb\.|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|дата рождения"
_MONTH_NAMES = [
    "january february march april may june july august september october november december".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
_MONTHS = {name: k + 1 for names in _MONTH_NAMES for k, name in enumerate(names)}
_DAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag".split())
_STREETS_EN = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Terrace Way".split()
_STREETS_FR = "rue avenue boulevard place chemin impasse allée quai".split()
_STREETS_ES = "Calle Avenida Avda Plaza Paseo Carrera".split()
_STREET_NAME = r"[A-ZÀ-Þ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_STREET_WORDS = frozenset(w.lower() for w in (*_STREETS_EN, *_STREETS_FR, *_STREETS_ES, *"bis ter des d' l' les".split()))
_STREET_END = re.compile(r"(.+)(straße|strasse|str\.|gasse|weg|platz|allee)")

PATTERNS: list[tuple[str, str, re.Pattern]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])[\w.+-]*\w@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", ".", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?!\w|\.\d)")),
    ("ip", ":", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f]{0,4}(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?(?![\w:])")),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|-\d)")),
    ("phone", "-", re.compile(r"(?<![\w-])\d{3}-\d{4}(?![\w-])")),
    ("phone", "+", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,12}){1,6}(?!\w)")),
    ("phone", "0", re.compile(r"(?<![\w+./-])(?:00[ .-]?[1-9]\d{0,2}(?:[ ./-]?\(0\))?(?:[ ./-]?\d{1,12}){1,6}|0[1-9](?P<s>[ .-]?)\d\d(?:(?P=s)\d\d){3}|(?:\(0\d{1,4}\)[ -]?|0\d{1,4}(?: ?[/-] ?| ))\d{3,9}(?:[ -]\d{1,5}){0,3}|01[567]\d{8,9})(?![\w/]|[.-]\d)")),
    ("phone", "", re.compile(r"(?<![\w+./-])(?:[6-9]\d\d(?:[ .-]\d\d){3}|[6-9]\d[ .-]\d{3}[ .-]\d\d[ .-]\d\d|(?:1[ .-])?[2-9]\d{9}|1[ .-](?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4})(?![\w/]|[.-]\d)")),
    ("phone", "", re.compile(rf"(?i)(?<!\w){_PHONE_WORDS}\b[^\w+(\n]{{0,3}}(?:(?:no|nr|number|num|numéro|número|nummer|me|us|at|is|on|au|al)\b[^\w+(\n]{{0,3}}){{0,2}}(?P<v>[+(]?\d(?:[ ./()-]{{0,2}}\d){{6,14}})(?!\w)")),
    ("card", "", re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)")),
    ("token", "", re.compile(r"(?i)(?<!\w)(?:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?(?P<v>(?-i:[A-Za-z0-9+/_=-]{16,}))")),
    ("name", "", re.compile(rf"{_TITLES}\.?(?=\s[^\W\d_])")),
    ("ssn", "", re.compile(r"(?i)(?<!\w)(?:ssn|social security)(?: (?:number|no\.?|#))?(?: is)?[\s:#=]{1,3}(?P<v>\d{9})(?!\w)")),
    ("passport", "", re.compile(r"(?i)(?<!\w)(?:passport|reisepass|passeport|pasaporte|паспорт)(?:nummer|-nr\.?)?(?: (?:no|nr|number|num|numéro|número|n°|номер)\b\.?)?(?: is)?[\s:#=]{1,3}(?P<v>(?-i:(?=[A-Z]*\d(?:[A-Z]*\d){4})[A-Z0-9]{6,10}))(?!\w)")),
    ("birth", "", re.compile(rf"(?i)(?<!\w)(?:{_BIRTH_WORDS})[\s:=]{{1,3}}(?P<v>\d{{4}}-\d\d?-\d\d?|\d\d?([./-])\d\d?\2\d{{4}}|\d\d?\.? (?:de )?(?:{'|'.join(_MONTHS)}) (?:de )?\d{{4}}|(?:{'|'.join(_MONTHS)}) \d\d?,? \d{{4}})(?!\w|[.-]\d)")),
    ("address", "", re.compile(rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]? (?:{_STREET_NAME} ){{1,3}}(?:{'|'.join(_STREETS_EN)})(?!\w)")),
    ("address", "", re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|gasse|weg|platz|allee) \d{1,4}(?: ?[a-z])?(?![\w.]\d|\w)")),
    ("address", "", re.compile(rf"(?<![\w.,-])\d{{1,4}},? (?:bis |ter )?(?:{'|'.join(_STREETS_FR)}) (?:(?:de|du|des|de la|d'|de l'|la|le|les) ?)?{_STREET_NAME}(?: {_STREET_NAME}){{0,2}}(?!\w)")),
    ("address", "", re.compile(rf"(?<!\w)(?:{'|'.join(_STREETS_ES)}) (?:(?:de|del|de la|de los|la|el) )?{_STREET_NAME}(?: {_STREET_NAME}){{0,2}},? (?:n[º°] ?)?\d{{1,4}}(?!\w)")),
]
_DIGIT = re.compile(r"\d")
#: A capitalised word that may be a first name, the whole name from there on, and ``Surname, First``.
_CAPITAL = re.compile(r"(?<![\w@.-])[A-ZÀ-ÞА-ЯЁ][^\W\d_]+(?=[\s-][^\W\d_])")
_FULL = re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+)?(?:\s(?:{'|'.join(sorted(_PARTICLES))})){{0,2}}\s(?!{_TITLES}\b)[^\W\d_a-zß-ÿа-яё][^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")
_LISTED = re.compile(r"(?<![\w@.-])(?P<last>[A-ZÀ-ÞА-ЯЁ][^\W\d_]+(?:-[^\W\d_]+)?), (?P<first>[A-ZÀ-ÞА-ЯЁ][^\W\d_]+)(?!\w)")
_FIELD_ENDS = "\n\t;|:()"
#: Numbers of books and versions; nothing inside them is an address, a card or a phone.
_NO_ENTITY = re.compile(r"(?i)isbn(?:-1[03])?:?\s*[\dx][\dx -]{8,16}[\dx]|(?<![\w-])97[89](?:[ -]?\d){10}(?![\w-])|(?<!\w)(?:version|ver|v|release|build|firmware)\.?\s*\d+(?:\.\d+)+")
_CARD_WORD = re.compile(r"(?i)(?:card|karte|carte|tarjeta|visa|amex|карт)[^\n]{0,24}$")
_OF_TIME = re.compile(r"(?i)(?<!\w)(?:in|on|by|of|since|until|till|during|before|after|early|late|last|next|this|every|from|to|im|am|seit|bis|ab|vom|en|el|de|le|depuis|desde|hasta|\d{1,2}\.?)\s$")
_TITLE_WORD = re.compile(f"{_TITLES}(?:[.]|$)")
#: What counts as another character, one for one, where entities are looked for.
_PLAIN = {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()} | {ord(c): p for c, p in zip("    ‐‑＋－．＠（）：／", "    --+-.@():/", strict=True)}
_NOT_PLAIN = frozenset(map(chr, _PLAIN))


# ---- keyed permutation of a format --------------------------------------------


def _scramble(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): Feistel on the next even number of bits, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            seed = tweak + bytes((r,)) + half.to_bytes(4, "big") + right.to_bytes(half // 8 + 1, "big")
            pad, n = b"", 0
            while len(pad) * 8 < half:
                pad += hashlib.blake2b(seed + bytes((n,)), key=key[:64], digest_size=64).digest()
                n += 1
            left, right = right, left ^ (int.from_bytes(pad, "big") & mask)
        x = left << half | right
        if x < size:
            return x


_VOWELS, _CONSONANTS, _DIGITS, _HEX = "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789", "0123456789abcdef"


_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿ"


@lru_cache(maxsize=4096)
def _alphabet(ch: str) -> str:
    """The letters that may stand for a lower-case character; itself if it is punctuation."""
    if ch.isascii():
        for letters in (_VOWELS, _CONSONANTS, _DIGITS):
            if ch in letters:
                return letters
        return ch
    for letters in (_ACCENTED, "çñ"):
        if ch in letters:
            return letters
    if not ch.isalpha():
        return ch
    like = (unicodedata.category(ch), unicodedata.name(ch, "").split(" ")[0])
    block = ord(ch) & ~0x3F  # neighbours of the same script and case
    return "".join(c for c in map(chr, range(block, block + 64)) if (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]) == like and c not in _ACCENTED + "çñ")


def permuted(text: str, kind: str, key: bytes, tweak: int, ok: Callable[[str], bool] = lambda s: True, alphabets: list[str] | None = None) -> str:
    """A text of the same format for which ``ok`` holds (it must hold for ``text``)."""
    sets = alphabets or [_alphabet(c) for c in text]
    size, x = 1, 0
    for letters, c in zip(sets, text, strict=True):
        size *= len(letters)
        x = x * len(letters) + letters.index(c)
    label = f"{kind}:{tweak}:{'|'.join(sets)}".encode()
    label = hashlib.blake2b(label, digest_size=16).digest()
    while size > 1:
        x = _scramble(x, size, key, label)
        out, rest = [], x
        for letters in reversed(sets):
            rest, k = divmod(rest, len(letters))
            out.append(letters[k])
        made = "".join(reversed(out))
        if ok(made):
            return made
    return text


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and _mod97(flat[4:] + flat[:4]) == 1


# ---- kinds of entities: normal form, surrogate of it, and how it is written --------


_LEAD = r"\+|00[ .-]?(?=[1-9])"


def _abroad(phone: str) -> str:
    """An international number with + and without the trunk zero."""
    phone = re.sub(f"^(?:{_LEAD})", "+", phone)
    return phone.replace("(0)", " ") if phone.startswith("+") else phone


def normal(kind: str, found: str) -> str:
    """What all layouts of an entity have in common; ``found`` is in plain characters."""
    if kind in {"card", "ssn"}:
        return re.sub(r"\D", "", found)
    if kind == "phone":
        found = _abroad(found)
        digits = re.sub(r"\D", "", found)
        code = re.match(r"\+(\d{1,3})(?!\d)", found)
        if code:
            return f"{digits[len(code[1]):]}" if code[1] == "1" else f"+{code[1]} {digits[len(code[1]):]}"
        return ("+" if found.startswith("+") else "") + digits
    if kind == "ip":
        return str(ipaddress.IPv6Address(found)) if ":" in found else ".".join(str(int(x)) for x in found.split("."))
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "name":
        last, comma, first = found.lower().partition(",")
        return " ".join((f"{first} {last}" if comma else found.lower()).split())
    if kind == "birth":
        return _date(found).isoformat()
    if kind == "address":
        return " ".join(_parts(found.lower()))
    return found.lower() if kind == "email" else found


def surrogate(kind: str, value: str, key: bytes, tweak: int) -> str:
    """The surrogate of a normal form, again a normal form; longer by ``more`` characters where ``tweak`` is large."""
    more = max(0, (tweak - NARROW) // 2 + 1)
    if kind == "card":
        valid = luhn(value)
        return permuted(value, kind, key, tweak, lambda s: luhn(s) == valid and (s[0] == "0") == (value[0] == "0"))
    if kind == "ssn":
        return permuted(value + "0" * more, kind, key, tweak)
    if kind == "phone":
        lead, _, rest = value.rpartition(" ")
        first = lambda s: s.lstrip("+")[:1] if s.lstrip("+")[:1] in "01" else "2"
        out = permuted(rest + "0" * more, kind, key, tweak, lambda s: first(s) == first(rest))
        return f"{lead} {out}" if lead else out
    if kind == "ip" and ":" in value:  # the first group tells the class of the address and stays
        x = int(ipaddress.IPv6Address(value))
        return str(ipaddress.IPv6Address(x >> 112 << 112 | _scramble(x & ((1 << 112) - 1), 1 << 112, key, f"ip6:{x >> 112}:{tweak}".encode())))
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        x = _scramble(int.from_bytes(bytes(octets), "big"), 1 << 32, key, f"ip:{tweak}".encode())
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "iban":
        sets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else _DIGITS for c in value[4:]]
        body = permuted(value[4:], kind, key, tweak, alphabets=sets)
        return f"{value[:2]}{98 - _mod97(body + value[:2] + '00'):02d}{body}"
    if kind == "birth":
        day = datetime.date.fromisoformat(value)
        first = datetime.date(day.year // 10 * 10 or 1, 1, 1)
        return (first + datetime.timedelta(_next_day(key, first)[(day - first).days])).isoformat()
    if kind == "address":
        return " ".join(_address_part(p, key, tweak, more) for p in value.split(" "))
    if kind in {"token", "passport"}:
        hexadecimal = kind == "token" and all(c in _HEX for c in value)
        value += "0" * more
        sets = [_HEX if hexadecimal else _DIGITS if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c for c in value]
        return permuted(value, kind, key, tweak, alphabets=sets)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{permuted(local + 'z' * more, 'local', key, tweak)}@{permuted(host, 'host', key, tweak)}.{top}"
    return " ".join(_name_part(p, key, tweak, more) for p in value.split(" "))


_GROUPS = [[n.lower() for n in names] for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC)]
_ALL_FIRST = {n: k for k, names in enumerate(_GROUPS) for n in names}
#: Surnames by script, and in Cyrillic by gender.
_GROUPS += [[n.lower() for n in SURNAMES if n.lower() not in _ALL_FIRST], [n.lower() for n in SURNAMES_CYRILLIC], [f"{n.lower()}а" for n in SURNAMES_CYRILLIC]]
_LEXICON = {n: k for k, names in enumerate(_GROUPS) for n in names}
_NAME_LETTERS = ("aeiou", "bdfgklmnprst", "chjvwz", "qxy")


def _name_part(part: str, key: bytes, tweak: int, more: int = 0) -> str:
    """Names of the lexicon are permuted within their gender and script, or become composites of ``more`` + 1 of them; others keep their letters' kinds."""
    if part in _PARTICLES:
        return part
    if part in _LEXICON:
        names = _GROUPS[_LEXICON[part]]
        x = _scramble(names.index(part), len(names) ** (more + 1), key, f"first{_LEXICON[part]}:{tweak}".encode())
        return "-".join(names[x // len(names) ** k % len(names)] for k in range(more + 1))
    part += "z" * more  # no name of the lexicon ends with z where this is not empty
    if part in _LEXICON:
        part += "z"
    sets = [next((letters for letters in _NAME_LETTERS if c in letters), None) or _alphabet(c) for c in part]
    return permuted(part, "name", key, tweak, lambda s: s not in _LEXICON, sets)


@lru_cache(maxsize=64)
def _next_day(key: bytes, first: datetime.date) -> list[int]:
    """For each day of the decade from ``first`` on the one that stands for it: the next of a keyed circle."""
    n = (datetime.date(first.year // 10 * 10 + 10, 1, 1) - first).days if first.year < 9990 else (datetime.date.max - first).days + 1
    circle = sorted(range(n), key=lambda d: hashlib.blake2b(f"birth:{first}:{d}".encode(), key=key[:64], digest_size=16).digest())
    out = [0] * n
    for here, there in zip(circle, circle[1:] + circle[:1], strict=True):
        out[here] = there
    return out


def _date(found: str) -> datetime.date | None:
    """The day that is written; between two numbers of at most 12 the first is the day."""
    numbers = [int(x) for x in re.findall(r"\d+", found)]
    month = next((_MONTHS[w] for w in re.findall(r"[^\W\d_]+", found.lower()) if w in _MONTHS), None)
    if month:
        day, year = numbers
    elif numbers[0] > 31:
        year, month, day = numbers
    else:
        day, month, year = numbers
        if month > 12:
            day, month = month, day
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def _date_like(layout: str, day: datetime.date) -> str:
    """``day`` written as ``layout`` is."""
    numbers, names = re.findall(r"\d+", layout), [w for w in re.findall(r"[^\W\d_]+", layout) if w.lower() in _MONTHS]
    if names:
        order = [day.day, day.year]
        language = next(held for held in _MONTH_NAMES if names[0].lower() in held)
        layout = layout.replace(names[0], _cased(language[day.month - 1], names[0]))
    elif int(numbers[0]) > 31:
        order = [day.year, day.month, day.day]
    else:
        order = [day.month, day.day, day.year] if int(numbers[1]) > 12 else [day.day, day.month, day.year]
    rest = iter(zip(order, numbers, strict=True))
    return re.sub(r"\d+", lambda m: f"{(x := next(rest))[0]:0{len(x[1])}d}", layout)


def _parts(address: str) -> list[str]:
    return re.findall(r"[dl]['’](?=[^\W\d_])|[^\s,]+", address)


def _address_part(part: str, key: bytes, tweak: int, more: int = 0) -> str:
    """Words such as ``street`` stay, the number is one as long or longer by ``more``, other letters keep their kinds."""
    if part in _STREET_WORDS or part in _PARTICLES:
        return part
    end = _STREET_END.fullmatch(part)
    if end:
        return permuted(end[1], "street", key, tweak) + end[2]
    if part[0].isdigit():
        digits = re.match(r"\d+", part)[0]
        return permuted(digits + "0" * more, "number", key, tweak, lambda s: (s[0] == "0") == (digits[0] == "0")) + part[len(digits) :]
    return permuted(part, "street", key, tweak)


def written(kind: str, found: str, made: str, value: str) -> str:
    """The surrogate's normal form in the layout of the entity found."""
    plain = _plain(found)
    out = _written(kind, plain, made, value)
    if plain == found:
        return out
    if len(out) == len(found):  # signs and digits of the own script
        return "".join(_digit_like(c, f) if f.isdecimal() and c.isdecimal() else f if c == p else c for c, p, f in zip(out, plain, found, strict=True))
    like = next((f for f in found if f.isdecimal()), "0")
    return "".join(_digit_like(c, like) if c.isdecimal() else c for c in out)


def _written(kind: str, found: str, made: str, value: str) -> str:
    if kind == "name":  # of a mention, the words it has
        words = dict(zip(value.split(" "), made.split(" "), strict=True))
        return "".join(w if w.isspace() or w == "," else _cased(words[w.lower()], w) for w in re.findall(r"\s+|,|[^\s,]+", found))
    if kind == "birth":
        return _date_like(found, datetime.date.fromisoformat(made))
    if kind == "address":
        rest = iter(made.split(" "))
        return re.sub(r"[dl]['’](?=[^\W\d_])|[^\s,]+", lambda m: _cased(next(rest), m[0]), found, flags=re.IGNORECASE)
    if kind == "ip":
        return made.upper() if re.search("[A-F]", found) else made
    if kind == "email":
        return _cased(made, found) if len(made) == len(found) else made
    if kind == "phone":
        lead, code = re.match(_LEAD, found), re.match(r"\+(\d{1,3})(?!\d)", _abroad(found))
        head = (lead[0] if lead else "") + (code[1] if code else "")
        rest = found[len(head) :]
        rest = rest.replace("(0)", "()") if lead else rest
        out = _digits_into(rest, re.sub(r"\D", "", made.rpartition(" ")[2]))
        return head + (out.replace("()", "(0)") if lead else out)
    if kind in {"card", "ssn"}:
        return _digits_into(found, made)
    if kind == "iban":
        rest = iter(made)
        return "".join(c if c == " " else next(rest) for c in found)
    return made


def _plain(text: str) -> str:
    return text if text.isascii() or _NOT_PLAIN.isdisjoint(text) else text.translate(_PLAIN)


def _digit_like(digit: str, like: str) -> str:
    return chr(ord(like) - unicodedata.decimal(like) + int(digit))


def _cased(made: str, found: str) -> str:
    if len(made) == len(found):
        return "".join(m.upper() if f.isupper() and len(m.upper()) == 1 else m for m, f in zip(made, found, strict=True))
    return made.upper() if found.isupper() and len(found) > 1 else made.title() if found[:1].isupper() else made


def _digits_into(layout: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdecimal() else c for c in layout) + "".join(rest)


# ---- detection --------------------------------------------------------------------


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order and without overlap."""
    text = _plain(text)
    found, named = [], {}
    digits = _DIGIT.search(text) is not None
    for kind, needs, pattern in PATTERNS:
        if needs and needs not in text or kind not in {"email", "token", "name"} and not digits:
            continue
        for m in pattern.finditer(text):
            group = "v" if "v" in pattern.groupindex else 0
            start, end = m.span(group)
            if kind == "name":
                start, end = _name_at(text, end) if not start or not (text[start - 1].isalnum() or text[start - 1] == "_") else (0, 0)
            value = text[start:end]
            if value and _is(kind, value, text, start):
                found.append((start, end, kind, normal(kind, value)))
    if digits and any(e[2] in _NUMBERS for e in found):
        spans = [m.span() for m in _NO_ENTITY.finditer(text) if not m[0].startswith("97") or _book(m[0])]
        found = [e for e in found if e[2] not in _NUMBERS or not any(a < e[1] and e[0] < b for a, b in spans)]
    for start, end in _untitled(text):
        found.append((start, end, "name", normal("name", text[start:end])))
    for start, end, kind, made in found:
        if kind == "name":
            parts = text[start:end].replace(",", " ").split()
            for w in parts[:1] if parts[0].lower() == parts[0].upper() else parts:  # without case, the second may be any word
                if len(w.rstrip(".")) > 1 and w.lower() not in _PARTICLES:
                    for mention in (w, w.upper()):
                        if mention.lower() == w.lower() and len(named.get(mention, "")) < len(made):
                            named[mention] = made
    if named:
        found += _mentions(text, named)
    found.sort(key=lambda e: (e[0], -e[1]))
    out, end = [], -1
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


_NUMBERS = frozenset({"ip", "card", "phone"})


def _is(kind: str, value: str, text: str, start: int) -> bool:
    """Whether a find of a pattern is an entity: check digits, lengths, calendar, words ahead."""
    if kind == "iban":
        return iban(value)
    if kind == "phone":
        return _phone(value)
    if kind == "ip":
        return ":" not in value or _ip6(value)
    if kind == "card":
        return luhn(re.sub(r"\D", "", value)) or _CARD_WORD.search(text, max(0, start - 40), start) is not None
    return kind != "birth" or _date(value) is not None


def _book(number: str) -> bool:
    return sum(int(d) * (1 + 2 * (k % 2)) for k, d in enumerate(re.sub(r"\D", "", number))) % 10 == 0


def _untitled(text: str) -> Iterator[tuple[int, int]]:
    """Names that begin with a first name of the lexicon, and ``Surname, First``: the surname is of the lexicon, or both fill a field."""
    for m in _CAPITAL.finditer(text):
        if m[0].lower() in _ALL_FIRST:
            whole = _FULL.match(text, m.start())
            if whole:
                yield whole.span()
    for m in _LISTED.finditer(text) if ", " in text else ():
        if m["first"].lower() in _ALL_FIRST:
            last = m["last"].lower()
            before, after = text[max(0, m.start() - 2) : m.start()].rstrip(" ")[-1:], text[m.end() : m.end() + 1]
            if last in _LEXICON and last not in _ALL_FIRST or before in _FIELD_ENDS and after in _FIELD_ENDS:  # an end of the text is in them too
                yield m.span()


def _name_at(text: str, at: int) -> tuple[int, int]:
    """Up to three words from ``at`` on that are not in lower case, with initials, and particles between them."""
    start = end = None
    words, small = 0, 0
    m = _WORD.match(text, at)
    while m and words < 3 and small < 3:
        w = m["v"]
        if not w[0].isupper() and not w[0].islower():  # scripts without case: two words, of those without blanks the first characters
            head = re.match("[\u3400-\u9fff]{1,4}|[\u30a0-\u30ff]+|[\uac00-\ud7a3]{1,4}", w)
            if head:
                return (m.start("v") if start is None else start), m.start("v") + head.end()
            words = max(words, 1)
        if w.lower() in _PARTICLES and w[0].islower():
            small += 1
        elif w[0].islower() or start is None and _TITLE_WORD.fullmatch(w):
            break
        else:
            words, small, end = words + 1, 0, m.end()
        if start is None:
            start = m.start("v")
        m = _WORD.match(text, m.end())
    return (start, end) if end else (0, 0)


def _mentions(text: str, named: dict[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """All further places of the words of names, each as a part of the longest name that holds it."""
    for m in re.finditer(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", text):
        w = m[0]
        if w not in named and w[-2:] in {"'s", "’s"}:
            w = w[:-2]
        if w in named and not ((w.lower() in _MONTHS or w.lower() in _DAYS) and _of_time(text, *m.span())):
            yield m.start(), m.start() + len(w), "name", named[w]


def _of_time(text: str, start: int, end: int) -> bool:
    return _OF_TIME.search(text, max(0, start - 12), start) is not None or re.match(r"\s\d", text[end : end + 2]) is not None


def _phone(value: str) -> bool:
    return 7 <= sum(c.isdigit() for c in value) <= 15


def _ip6(value: str) -> bool:
    """An address with a digit and three groups, or with a first group of four: not a slice like ``1::2``."""
    groups = [g for g in value.split(":") if g]
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return _DIGIT.search(value) is not None and (len(groups) > 2 or groups and len(value.split(":")[0]) == 4)


def replaced(text: str, key: bytes, tweaks: dict[tuple[str, str], int], cache: dict) -> tuple[str, int]:
    found = entities(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for start, end, kind, value in found:
        made = cache.get((kind, value))
        if made is None:
            made = surrogate(kind, value, key, tweaks.get((kind, value), 0))
            if len(cache) < 50_000:
                cache[kind, value] = made
        parts += (text[at:start], written(kind, text[start:end], made, value))
        at = end
    return "".join((*parts, text[at:])), len(found)


# ---- Spark -------------------------------------------------------------------------


def session_key(spark: SparkSession) -> bytes:
    """The session's key; a random one is set where there is none."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def found_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """(body, kind, value, made) of ``docs``: body hashes the text, once per entity of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for kind, value in {(e[2], e[3]) for e in entities(text.as_py())}:
                    rows.append((body, kind, value, surrogate(kind, value, key, 0)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["body", "kind", "value", "made"])

    held = docs.filter("text is not null").select(F.xxhash64("text").alias("body"), "text")
    return held.mapInArrow(run, "body long, kind string, value string, made string")


def settle(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, tweak) of entities that need a tweak, from distinct (kind, value, made).

    A surrogate is settled if no entity, the own one included, and no other surrogate equals it.
    Settled ones never change, so a round looks at those that were drawn in it."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "tweak")), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array([surrogate(k, v, key, t) for k, v, t in rows], pa.string()), batch.column("tweak")], ["kind", "value", "made", "tweak"])

    moved = cut(distinct.select("kind", "value", "made", F.lit(0).alias("tweak")))
    occupied = moved.select("kind", F.col("value").alias("made"))
    settled = moved.limit(0)
    for tweak in range(ROUNDS + 1):
        taken = moved.join(occupied.distinct(), ["kind", "made"])
        twice = moved.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "made").orderBy("value"))).filter("rank > 1")
        bad = cut(taken.select("kind", "value").unionByName(twice.select("kind", "value")).distinct())
        good = moved.join(bad, ["kind", "value"], "left_anti")
        occupied = occupied.unionByName(good.select("kind", "made"))
        settled = settled.unionByName(good.filter("tweak > 0").select(settled.columns))
        if bad.isEmpty():
            return settled.select("kind", "value", "tweak")
        if tweak < ROUNDS:
            moved = cut(bad.select("kind", "value", F.lit(tweak + 1).alias("tweak")).mapInArrow(again, "kind string, value string, made string, tweak int"))
    raise RuntimeError(f"{bad.count()} entities have no free surrogate after {ROUNDS} rounds")


def anonymized(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with text replaced, and n_replaced."""
    spark = docs.sparkSession
    ship(spark)
    key = key or session_key(spark)
    found = stored(found_entities(docs, key), "entities")
    tweaked = cut(settle(found.filter("kind <> 'birth'").groupBy("kind", "value").agg(F.min("made").alias("made")), key))
    names = [c for c in docs.columns if c != "n_replaced"]
    body, own_tweaks = (next(n for n in (base, *(f"{base}_{i}" for i in range(len(names) + 1))) if n not in names) for base in ("body", "tweaks"))
    docs = docs.select(names)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_replaced", T.LongType())])
    where, shared = names.index("text"), None
    head = tweaked.limit(BROADCAST_ROWS + 1).collect()
    if len(head) <= BROADCAST_ROWS:
        shared = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["tweak"] for r in head})
        source = docs
    else:
        rows = found.join(tweaked, ["kind", "value"]).select("body", "kind", "value", "tweak").distinct().groupBy("body").agg(F.collect_list(F.struct("kind", "value", "tweak")).alias(own_tweaks)).withColumnRenamed("body", body)
        source = docs.withColumn(body, F.xxhash64("text")).join(rows, body, "left").select(*names, own_tweaks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts, counts = [], []
            own = batch.column(len(names)).to_pylist() if shared is None else None
            for i, cell in enumerate(batch.column(where)):
                text = cell.as_py()
                if text is None:
                    made = (None, 0)
                elif own is None:
                    made = replaced(text, key, shared.value, cache)
                else:
                    made = replaced(text, key, {(t["kind"], t["value"]): t["tweak"] for t in own[i] or []}, {})
                texts.append(made[0])
                counts.append(made[1])
            columns = list(batch.columns)[: len(names)]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_replaced"])

    return source.mapInArrow(run, schema)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymized(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")
