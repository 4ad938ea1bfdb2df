"""Replacement of personal data and secrets by keyed surrogates.

Entities are found by pattern: email addresses, IPv4 and MAC addresses, card
numbers, IBANs, social security numbers, phone numbers, secrets, and personal
names: words with a capital that follow a title, a known given name or words
with which people are introduced. Other names can't be told from other words
with capitals and stay. Each gets a surrogate of its own kind, format and script: digits stay digits,
letters stay letters of their alphabet and case, separators stay where they
are, valid card numbers stay valid, an address stays an address, a given name
becomes one of the same gender and script, and a Cyrillic surname keeps the
ending that shows its gender.

A surrogate is made by a keyed permutation of all values of the entity's form:
the value's number is moved by a keyed Feistel network, shifted by a keyed
amount other than 0, and moved back. So one entity has one surrogate wherever
it stands (coreference), two never share one (distinctness), and none is its own.
What entities have in common for this purpose is their bare value: case and
separators aside, and a phone number's last ten digits. No such value is written
anywhere: what is kept of it is a keyed digest. A check over the whole corpus confirms that no two entities of a kind came to one surrogate; a kind
for which it fails is keyed anew.

Where entities overlap, the kind that comes first in KINDS counts. Null and empty
texts stay as they are; very long texts are searched whole, in time that grows
with their length; text without entities is unchanged to
the byte; a null doc_id is carried along; repeated rows are replaced alike; an
empty table gives an empty result; other columns are ignored by :func:`query`
and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialise

#: The key of the queries; a deployment passes its own secret.
KEY = b"gridloom-surrogates"
ROUNDS = 8
#: Letters of a value that are permuted as one number; of a longer one, each run of so many is.
RUN = 64

# Alphabets within which a letter is replaced.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
)
# Given names by script and gender, surnames by script.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Camille Carmen Charlotte Christine Claire Elena Elizabeth Emily Emma Hannah Isabel Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Martina Mary Michelle Monika Nancy Olivia Patricia Sabine Sandra Sarah Sofia Sophie Susan Ursula".split(),
    ("latin", "m"): "Alexander Andreas Antoine Antonio Carlos Charles Christopher Daniel David Diego Edward Francisco Frank George Hans Henry Jacques James Jean John Jorge Joseph Juan Klaus Louis Luis Manuel Mark Michael Miguel Nicolas Patrick Paul Peter Pierre Richard Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Анастасия Валентина Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Пётр Сергей".split(),
}
SURNAMES = {
    "latin": "Anderson Bauer Becker Bernard Brown Clark Davis Dubois Durand Fernandez Fischer Garcia Gonzalez Green Hall Harris Hoffmann Jackson Johnson Jones Klein Lambert Laurent Lefebvre Lewis Lopez Martin Martinez Meyer Miller Moreau Moreno Müller Perez Petit Robinson Rodriguez Roux Ruiz Sanchez Schmidt Schneider Schulz Smith Taylor Thompson Wagner Walker Weber White Williams Wilson Wright Young".split(),
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Васильев Соколов Михайлов Новиков Фёдоров Морозов Волков".split(),
}
# Endings of Cyrillic surnames, each with the one of the other gender's name that it belongs to.
ENDINGS = {"ская": "ск", "ский": "ск", "ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ов": "ов", "ев": "ев", "ёв": "ёв", "ин": "ин"}
# Words after which a name stands, and those after which two words with a capital are one.
INTRODUCTIONS = "my name is|My name is|I am called|mein Name ist|Mein Name ist|ich heiße|Ich heiße|je m'appelle|Je m'appelle|me llamo|Me llamo|mi nombre es|Mi nombre es|меня зовут|Меня зовут".split("|")
LABELS = "Name:|name:|Full name:|Contact:|contact:|Author:|author:|Sincerely,|sincerely,|Regards,|regards,|Signed,|signed,|Имя:|Nombre:|Nom:".split("|")
TITLES = {"f": "Mrs Ms Miss Mme Madame Mlle Frau Señora Sra Srta Doña Г-жа".split(), "m": "Mr Mister Monsieur Herr Señor Sr Don Г-н".split(), "": "Dr Prof".split()}

_CLASS = {c: k for k, letters in enumerate(ALPHABETS) for c in letters}
_RANK = {c: i for letters in ALPHABETS for i, c in enumerate(letters)}
_SHARP = {"ß"}  # no upper-case letter of its own


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    size = (bits + 7) // 8
    got = hashlib.shake_256(key + b"|" + tweak + b"|" + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8, "big")).digest(size + 4)
    return int.from_bytes(got, "big") & ((1 << bits) - 1)


def _feistel(x: int, bits: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A keyed permutation of the numbers below 2**(2 * bits)."""
    a, b = x >> bits, x & ((1 << bits) - 1)
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if back:
            a, b = b ^ _round(key, tweak, i, a, bits), a
        else:
            a, b = b, a ^ _round(key, tweak, i, b, bits)
    return a << bits | b


def moved(x: int, size: int, key: bytes, tweak: str, ok: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of the numbers below ``size`` that leaves none in its place.

    With ``ok``, of those for which it holds, each goes to another of them;
    that needs more than one, and that they aren't rare.
    """
    if size < 2:
        return x
    t = tweak.encode()
    bits = max(1, (size - 1).bit_length() + 1 >> 1)
    shift = 1 + _round(key, t + b"shift", 0, size, size.bit_length() + 64) % (size - 1)

    def permute(v: int, back: bool) -> int:
        while True:
            v = _feistel(v, bits, key, t, back)
            if v < size:
                return v

    y = x
    while True:  # out of a value that isn't ok the walk goes on, and comes to x only if nothing else is ok
        y = permute((permute(y, False) + shift) % size, True)
        if ok is None or ok(y) or y == x:
            return y


def respell(text: str, key: bytes, tweak: str, ok: Callable[[str], bool] | None = None) -> str:
    """Each letter and digit replaced within its alphabet, case kept, everything else left."""
    if len(text) > RUN:
        return "".join(respell(text[i : i + RUN], key, f"{tweak}/{i}") for i in range(0, len(text), RUN))
    low = [c if c in _SHARP or len(c.lower()) != 1 else c.lower() for c in text]
    at = [i for i, c in enumerate(low) if c in _CLASS]
    if not at:
        return text
    form = "".join(chr(97 + _CLASS[c]) if c in _CLASS else c for c in low)
    number, size = 0, 1
    for i in at:
        base = len(ALPHABETS[_CLASS[low[i]]])
        number, size = number * base + _RANK[low[i]], size * base

    def spell(n: int) -> str:
        out = list(text)
        for i in reversed(at):
            letters = ALPHABETS[_CLASS[low[i]]]
            n, r = divmod(n, len(letters))
            out[i] = letters[r].upper() if text[i] != low[i] and letters[r] not in _SHARP else letters[r]
        return "".join(out)

    return spell(moved(number, size, key, f"{tweak}/{form}", ok and (lambda n: ok(spell(n)))))


def _put_digits(text: str, digits: str) -> str:
    """``text`` with its last digits replaced by ``digits``."""
    it = iter(reversed(digits))
    return "".join(reversed([next(it, c) if c.isascii() and c.isdigit() else c for c in reversed(text)]))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def luhn(digits: str) -> bool:
    total = sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _email(m: str, key: bytes) -> tuple[str, str]:
    local, _, domain = m.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return m.lower(), respell(local, key, f"local/{domain.lower()}") + "@" + respell(host, key, "host") + dot + top


def _ip(m: str, key: bytes) -> tuple[str, str]:
    a, b, c, d = (int(x) for x in m.split("."))
    number = a << 24 | b << 16 | c << 8 | d
    inner = lambda n: n >> 24 == 10 or n >> 20 == 0xAC1 or n >> 16 == 0xC0A8 or n >> 24 == 127
    # addresses of private networks keep their network
    for bits, net in ((24, 10), (24, 127), (20, 0xAC1), (16, 0xC0A8)):
        if number >> bits == net:
            n = net << bits | moved(number & ((1 << bits) - 1), 1 << bits, key, f"ip/{net}")
            break
    else:
        n = moved(number, 1 << 32, key, "ip", lambda x: not inner(x))
    return m, ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _card(m: str, key: bytes) -> tuple[str, str]:
    d = _digits(m)
    if luhn(d):
        body = f"{moved(int(d[:-1]), 10 ** (len(d) - 1), key, f'card/{len(d)}'):0{len(d) - 1}d}"
        new = next(body + c for c in "0123456789" if luhn(body + c))
    else:
        new = f"{moved(int(d), 10 ** len(d), key, f'number/{len(d)}', lambda x: not luhn(f'{x:0{len(d)}d}')):0{len(d)}d}"
    return d, _put_digits(m, new)


def _phone(m: str, key: bytes) -> tuple[str, str]:
    d = _digits(m)[-10:]
    return d, _put_digits(m, f"{moved(int(d), 10 ** len(d), key, f'phone/{len(d)}'):0{len(d)}d}")


def _ssn(m: str, key: bytes) -> tuple[str, str]:
    d = _digits(m)
    return d, _put_digits(m, f"{moved(int(d), 10 ** len(d), key, 'ssn'):0{len(d)}d}")


_HEX = re.compile(r"[0-9a-fA-F]+")


def _secret(m: str, key: bytes) -> tuple[str, str]:
    if _HEX.fullmatch(m) and len({c.isupper() for c in m if c.isalpha()}) < 2:
        runs = [m[i : i + RUN] for i in range(0, len(m), RUN)]
        n = "".join(f"{moved(int(x, 16), 16 ** len(x), key, f'hex/{len(m)}/{i}'):0{len(x)}x}" for i, x in enumerate(runs))
        return m.lower(), n.upper() if m.upper() == m else n
    return m, respell(m, key, "secret")


def _iban_ok(m: str) -> bool:
    x = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _iban(m: str, key: bytes) -> tuple[str, str]:
    x = m.replace(" ", "")
    body = respell(x[4:], key, f"iban/{x[:2]}")
    check = f"{98 - int(''.join(str(int(c, 36)) for c in body + x[:2] + '00')) % 97:02d}"
    it = iter(x[:2] + check + body)
    return x, "".join(c if c == " " else next(it) for c in m)


def _mac(m: str, key: bytes) -> tuple[str, str]:
    x = m.replace(":", "").replace("-", "")
    new = iter(_secret(x.lower(), key)[1])
    return x.lower(), "".join(c if c in ":-" else (next(new).upper() if m.upper() == m else next(new)) for c in m)


def _script(word: str) -> str:
    return "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in word.lower()) else "latin"


def _from_list(word: str, names: list[str], key: bytes, tweak: str) -> str | None:
    known = {n.lower(): i for i, n in enumerate(names)}
    i = known.get(word.lower())
    if i is None:
        return None
    new = names[moved(i, len(names), key, tweak)]
    return new.upper() if word.isupper() and len(word) > 1 else new


#: All listed names, with surnames as women have them.
_LISTED = frozenset(n.lower() for g in GIVEN.values() for n in g) | frozenset(n.lower() for s in SURNAMES.values() for n in s) | frozenset(f"{n.lower()}а" for n in SURNAMES["cyrillic"])


def _surname(word: str, key: bytes) -> str | None:
    """A listed surname's surrogate, or that of a Cyrillic one by its ending."""
    script = _script(word)
    tweak = f"surname/{script}"
    if (got := _from_list(word, SURNAMES[script], key, tweak)) is not None or script == "latin":
        return got
    if word[-1] in "аА" and (got := _from_list(word[:-1], SURNAMES[script], key, tweak)) is not None:
        return got + word[-1]
    low = word.lower()
    end = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), None)
    if end is None or low in _LISTED:
        return None
    stem = word[: -len(end)]
    return respell(stem, key, f"name/{ENDINGS[end]}", lambda w: f"{w.lower()}{ENDINGS[end]}" not in _LISTED) + word[-len(end) :]


def _name_word(word: str, gender: str, last: bool, key: bytes) -> str:
    """One part of a name; a name that no list has keeps its length and capitals."""
    script = _script(word)
    if not last:
        for g in (gender,) if gender else ("f", "m"):
            if (got := _from_list(word, GIVEN[script, g], key, f"given/{script}/{g}")) is not None:
                return got
    if (got := _surname(word, key)) is not None:
        return got
    # never a listed name, so that listed and other names can't meet
    return respell(word, key, "name", lambda w: w.lower() not in _LISTED) if word.lower() not in _LISTED else respell(word, key, "listed")


def _name(m: str, key: bytes) -> tuple[str, str]:
    words = re.split(r"(\s+)", m)
    title = words[0].rstrip(".")
    gender = next((g for g, ts in TITLES.items() if title in ts), None)
    start = 0 if gender is None else 2
    if gender is None:
        gender = "f" if words[0] in GIVEN["latin", "f"] or words[0] in GIVEN["cyrillic", "f"] else "m"
    parts = range(start, len(words), 2)
    for i in parts:
        words[i] = _name_word(words[i], gender, i == parts[-1], key)
    return " ".join(re.split(r"\s+", m)[(1 if start else 0) :]), "".join(words)


GIVEN_ALL = [n for names in GIVEN.values() for n in names]
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+)*"
_TITLE = "|".join(re.escape(t) for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(map(re.escape, GIVEN_ALL))
_INTRODUCED, _LABELLED = "|".join(map(re.escape, INTRODUCTIONS)), "|".join(map(re.escape, LABELS))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Kinds in order of precedence: what an earlier one takes, a later one doesn't see.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], tuple[str, str]]], ...] = (
    ("email", r"(?<![\w.+%-])[\w.+%-]*\w@(?:[\w-]+\.)+[A-Za-z]{2,}", _email),
    ("secret", r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key)\b\s*[=:]\s*)[\"']?(?P<secret>[A-Za-z0-9_\-+/=.]{6,}(?<!\.))[\"']?|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})|(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}|(?<![\w])(?=[A-Fa-f]*\d)(?=\d*[A-Fa-f])[0-9A-Fa-f]{32,}(?!\w)", _secret),
    ("mac", r"(?<![\w:-])(?:[0-9A-Fa-f]{2}([:-]))(?:[0-9A-Fa-f]{2}\2){4}[0-9A-Fa-f]{2}(?![\w:-])", _mac),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", _ip),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("card", r"(?<![\d+])(?:\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)", _card),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("phone", r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{4})(?![\d-])", _phone),
    ("name", rf"(?<!\w)(?:(?:{_TITLE})\.?\s+{_CAPITAL}(?:\s+{_CAPITAL}){{0,2}}|(?:{_GIVEN})(?:\s+(?:{_GIVEN}))?\s+{_CAPITAL}|(?:{_INTRODUCED})\s+(?P<introduced>{_CAPITAL}(?:\s+{_CAPITAL}){{0,2}})|(?:{_LABELLED})\s+(?P<labelled>{_CAPITAL}(?:\s+{_CAPITAL}){{1,2}}))(?!\w)", _name),
)
_COMPILED = [(kind, re.compile(pattern.replace(r"\2", r"\1") if kind == "mac" else pattern), make) for kind, pattern, make in KINDS]
_SIGN = re.compile("[0-9@=:]")
#: Beginnings of secrets, and MAC addresses, that need none of the signs.
_BARE = re.compile(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|(?:[A-Fa-f]{2}-){5}")
#: A whole word before a capital, which it leaves to be the next match's.
_FIRST = re.compile(r"(?<!\w)[A-ZА-ЯЁ]\w++(?=\s+[A-ZÀ-ÖØ-ÞА-ЯЁ])")
_TITLES = [t for ts in TITLES.values() for t in ts]
_GIVEN_SET = frozenset(GIVEN_ALL)
_CUES = [*INTRODUCTIONS, *(x for x in LABELS if ":" not in x)]


def maybe(text: str) -> bool:
    """False only for text without an entity; much faster than the patterns."""
    return bool(_SIGN.search(text)) or any(t in text for t in _TITLES) or any(w in _GIVEN_SET for w in _FIRST.findall(text)) or any(c in text for c in _CUES) or bool(_BARE.search(text))


@dataclass
class Found:
    text: str
    entities: list[tuple[str, str, str]] = field(default_factory=list)  # kind, value, surrogate's value


def digest(value: str, key: bytes) -> str:
    """What is kept of a value: equal for equal values, and no way back without the key."""
    return hashlib.blake2b(value.encode(), key=hashlib.sha256(key).digest(), digest_size=16).hexdigest()


def replace(text: str, keys: dict[str, bytes]) -> Found:
    """The text with its entities replaced, and those entities."""
    if not maybe(text):
        return Found(text)
    taken: list[tuple[int, int, str]] = []
    entities = []
    left = text  # with what is taken blotted out, so that no later match reaches into it
    for kind, pattern, make in _COMPILED:
        first = len(taken)
        for m in pattern.finditer(left):
            group = next((g for g in ("secret", "introduced", "labelled") if m.groupdict().get(g)), 0)
            a, b = m.span(group)
            s = text[a:b]
            if kind == "iban" and not _iban_ok(s):
                continue
            value, new = make(s, keys[kind])
            taken.append((a, b, new))
            entities.append((kind, value, make(new, keys[kind])[0]))
        if len(taken) > first:
            parts, at = [], 0
            for a, b, _ in taken[first:]:
                parts += [left[at:a], "\0" * (b - a)]
                at = b
            left = "".join(parts) + left[at:]
    out, at = [], 0
    for a, b, new in sorted(taken):
        out += [text[at:a], new]
        at = b
    return Found("".join(out) + text[at:] if out else text, entities)


_ENTITY = pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])
_ENTITIES = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "value", "surrogate")]))


def _run(keys: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                found = [None if (t := x.as_py()) is None else replace(t, keys) for x in rows.column("text")]
                text = pa.array([None if f is None else f.text for f in found], pa.string())
                items = pa.array([[] if f is None else [{"kind": k, "value": digest(v, keys[k]), "surrogate": digest(new, keys[k])} for k, v, new in f.entities] for f in found], pa.list_(_ENTITY))
                yield pa.RecordBatch.from_arrays([rows.column("rest"), text, items], names=["rest", "text", "entities"])

    return run


def surrogates(docs: DataFrame, key: bytes = KEY, attempts: int = 3) -> DataFrame:
    """(rest, text, entities): ``rest`` holds the other columns as a struct; the collision check has passed.

    An entity has its kind and the digests of its value and of its surrogate's.
    """
    keys = {kind: key + kind.encode() for kind, _, _ in KINDS}
    rest = [c for c in docs.columns if c != "text"]
    narrow = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["rest"], T.StructField("text", T.StringType()), T.StructField("entities", _ENTITIES)])
    for n in range(attempts):
        done = materialise(narrow.mapInArrow(_run(keys), schema), "surrogates")
        pairs = done.select(F.explode("entities").alias("e")).select("e.kind", "e.value", "e.surrogate").distinct()
        clash = [r[0] for r in pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1").select("kind").distinct().collect()]  # at most one row a kind
        if not clash:
            return done
        for kind in clash:
            keys[kind] = key + f"{kind}/{n + 1}".encode()
    raise ValueError(f"surrogates of {clash} collide under {attempts} keys")


def redact(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced."""
    done = surrogates(docs, key)
    return done.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    done = surrogates(docs.select(F.col("doc_id"), F.col("text")))
    kinds = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return done.select(F.col("rest.doc_id").alias("doc_id"), "text", F.size("entities").cast("bigint").alias("n_entities"), *(kinds(k) for k, _, _ in KINDS))
