"""PII: detected entities get keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity within its own format: digits
stay digits, letters stay letters of their script and case, signs stay.  Equal
entities therefore get equal surrogates in every document (coreference), and
different ones different surrogates (distinctness), without a table of all
entities.  Permutations skip values that would be invalid or taken (collision
checks), and none maps a value to itself.  ``collisions`` verifies this over a
whole corpus.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import warnings
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .textbatch import with_columns

#: Session setting with the owner's secret; who has it can undo the surrogates.
KEY_SETTING = "diurna.pii.key"


def key_of(spark: SparkSession) -> bytes:
    """The session's key; where unset a public one, with a warning, for test tables only."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} isn't set: these surrogates can be undone by anyone", stacklevel=2)
        named = "a public key for tables without real persons"
    return hashlib.blake2b(named.encode(), digest_size=32).digest()


# --- Keyed permutations -------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    # values have at most _PIECE characters, so a digest is long enough
    h = hashlib.blake2b(half.to_bytes((bits + 7) // 8 or 1, "big") + bytes([i]) + tweak, key=key[:64], digest_size=max(8, bits // 8 + 1))
    return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)


_ROUNDS = 8


def _feistel(x: int, size: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A permutation of range(size): a Feistel network, walked until in range."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        a, b = x >> bits, x & mask
        if back:
            for i in reversed(range(_ROUNDS)):
                a, b = b ^ _round(key, tweak, i, a, bits), a
        else:
            for i in range(_ROUNDS):
                a, b = b, a ^ _round(key, tweak, i, b, bits)
        x = a << bits | b
        if x < size:
            return x


def permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size) without fixed points (size > 1)."""
    if size < 2:
        return x
    y = (_feistel(x, size, key, tweak, False) + 1) % size
    return _feistel(y, size, key, tweak, True)


# --- Alphabets ----------------------------------------------------------------

# The alphabets within which letters are replaced.
_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
]
_VOWELS = "aeiouyаеиоуыэюяαεηιουω"
_SOUNDS = []
#: Letters of names: vowels for vowels, others for others, so results read as names.
for _letters in _ALPHABETS[1:]:
    _marked = [unicodedata.normalize("NFD", c)[0].lower() in _VOWELS + "æø" for c in _letters]
    _SOUNDS += ["".join(c for c, m in zip(_letters, _marked, strict=True) if m == vowel) for vowel in (True, False)]
_PLACE = {c: letters for letters in _ALPHABETS for c in letters}
_SOUND_PLACE = {c: letters for letters in _SOUNDS for c in letters}
_CJK = "".join(map(chr, range(0x4E00, 0x9FA6)))
#: Characters that are permuted as one number; longer texts are permuted piece by piece.
_PIECE = 40


@lru_cache(maxsize=1 << 12)
def _letters_like(c: str) -> str:
    """Of any other script: the letters of the same kind in the same 128 code points."""
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return ""
    if c in _CJK:
        return _CJK
    first = ord(c) & ~127
    known = _PLACE if kind[0] == "L" else {}
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in known)


def _permuted(letters: list[str], text: str, key: bytes, tweak: bytes) -> str:
    """Permute a text among all texts with these letters at its places; none: the sign stays."""
    size, value = 1, 0
    for alphabet, c in zip(letters, text, strict=True):
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    value = permute(value, size, key, tweak)
    out = []
    for alphabet, c in zip(reversed(letters), reversed(text), strict=True):
        if alphabet:
            value, i = divmod(value, len(alphabet))
            c = alphabet[i]
        out.append(c)
    return "".join(reversed(out))


def _by_pieces(letters: list[str], text: str, key: bytes, tweak: bytes) -> str:
    """``_permuted`` for any length, one to one in every case.

    Pieces are permuted one after the other, forth and back, each under a
    digest of what was made of those before it, so every piece depends on all.
    """
    if len(text) <= _PIECE:
        return _permuted(letters, text, key, tweak)
    cuts = range(0, len(text), _PIECE)
    pieces = [text[a : a + _PIECE] for a in cuts]
    for way in (range(len(pieces)), reversed(range(len(pieces)))):
        seen = hashlib.blake2b(tweak, key=key[:64], digest_size=16)
        for i in way:
            a = i * _PIECE
            pieces[i] = _permuted(letters[a : a + _PIECE], pieces[i], key, seen.digest())
            seen.update(pieces[i].encode())
    return "".join(pieces)


def _in_format(text: str, key: bytes, kind: str, names: bool = False) -> str:
    """Permute a text among all texts of its format; other signs stay.

    In names the last vowel of a word of three letters or more stays too, as it
    often tells the gender.
    """
    where = _SOUND_PLACE if names else _PLACE
    letters = [where.get(c) or _letters_like(c) for c in text]
    if names and len(text) > 2 and text[-1].lower() in _VOWELS:
        letters[-1] = ""
    # texts of one format share a permutation
    shape = hashlib.blake2b("\0".join(a[:1] + str(len(a)) if a else c for a, c in zip(letters, text, strict=True)).encode(), digest_size=16).digest()
    return _by_pieces(letters, text, key, kind.encode() + b"\0" + shape)


# --- Surrogates by type -------------------------------------------------------


def _luhn(digits: str) -> int:
    """What the Luhn sum of a number lacks to a multiple of 10, as its last digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _put(original: str, digits: str) -> str:
    """The original with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in original)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _card(text: str, key: bytes) -> str:
    d = _digits(text)
    body, off = d[:-1], (int(d[-1]) - _luhn(d[:-1])) % 10
    # valid numbers stay valid, invalid ones invalid; the network's digit stays
    new = body[0] + _in_format(body[1:], key, f"card{off > 0}{body[0]}")
    return _put(text, new + str((_luhn(new) + off) % 10))


def _phone(text: str, key: bytes) -> str:
    m = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|\+[0-9][0-9]", text)
    head = m.group() if m else ""
    rest = text[len(head) :]
    first = d = _digits(rest)
    # a national number's 0 stays, and no other gets one: walk on
    while True:
        d = _in_format(d, key, "phone")
        if (d[0] == "0") == (first[0] == "0"):
            return head + _put(rest, d)


def _ip(text: str, key: bytes) -> str:
    value = 0
    for part in text.split("."):
        value = value << 8 | int(part)
    value = permute(value, 1 << 32, key, b"ip")
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ssn(text: str, key: bytes) -> str:
    d = _digits(text)
    # walk on past numbers that are never issued
    while True:
        d = _in_format(d, key, "ssn")
        if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000":
            return _put(text, d)


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    rest = _in_format(plain[4:], key, "iban" + plain[:2])
    new = iter(f"{plain[:2]}{_iban_check(plain[:2], rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in text)


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    # the reserved example domains stay, others keep their last label
    keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    name, last = ".".join(labels[:-keep]), ".".join(labels[-keep:])
    # case is a matter of spelling: it is kept, not part of the identity
    new = _in_format(_lower(local), key, "local")
    host = _in_format(_lower(name), key, "domain") if name else ""
    return _case(local, new) + "@" + (_case(name, host) + "." if name else "") + last


def _lower(text: str) -> str:
    """Lower case, character by character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _case(like: str, text: str) -> str:
    return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(like, text, strict=True))


# Common given names, by gender.
_GIVEN = {
    "f": (
        "Anna Maria Emma Sophie Laura Julia Marie Sarah Lisa Clara Alice Elena Carmen Lucia Isabel Claire Camille Chloe "
        "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Karen Nancy Margaret Emily Olivia Hannah Grace"
    ).split(),
    "m": (
        "John Paul Peter Thomas Michael David Daniel Martin Hans Karl Felix Max Jean Pierre Louis Jacques Antoine Carlos "
        "Juan Jose Miguel Pedro James Robert William Richard Joseph Charles George Henry Oliver Jack"
    ).split(),
}
_GENDER = {name: g for g, names in _GIVEN.items() for name in names}
# Titles, by gender ("" where a title has none).
_TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Mlle Mademoiselle Señora Señorita Sra Srta Doña Госпожа",
    "m": "Mr Mister Herr Monsieur Señor Sr Don Господин",
    "": "Dr Prof",
}
_TITLE_GENDER = {t: g for g, ts in _TITLES.items() for t in ts.split()}


def _word(word: str, key: bytes, gender: str) -> str:
    """One word of a name: a listed given name by another of its gender, else in its letters."""
    g = _GENDER.get(word)
    if g:
        names = _GIVEN[g]
        return names[permute(names.index(word), len(names), key, b"given" + g.encode())]
    new = word
    while True:  # listed names are taken: walk on
        new = _in_format(new, key, "name" + gender, names=True)
        if new not in _GENDER:
            return new


def _person(text: str, key: bytes) -> str:
    title = re.match(r"[^\W\d_]+(?=\.?\s)", text)
    known = title is not None and title.group() in _TITLE_GENDER
    head = re.match(r"[^\W\d_]+\.?\s+", text).group() if known else ""
    # one person keeps one name, whatever the title: the title's gender isn't a tweak
    return head + re.sub(r"[^\W\d_]+", lambda m: _word(m.group(), key, ""), text[len(head) :])


_HEX = "0123456789abcdef"


def _secret(text: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        new = _by_pieces([_HEX] * len(text), text.lower(), key, b"hex%d" % len(text))
        return new.upper() if text != text.lower() else new
    return _in_format(text, key, "secret")


_MAKE = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone, "person": _person}


@lru_cache(maxsize=1 << 14)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity."""
    return _MAKE[kind](text, key)


def canonical(kind: str, text: str) -> str:
    """What equal entities have in common, beyond spelling."""
    if kind in ("card", "ssn"):
        return _digits(text)
    if kind == "phone":
        m = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|\+[0-9][0-9]", text)
        return _digits(text[m.end() :] if m else text)
    if kind == "email":
        return _lower(text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "person":
        m = re.match(r"([^\W\d_]+)\.?\s+", text)
        return " ".join((text[m.end() :] if m and m.group(1) in _TITLE_GENDER else text).split())
    return text


# --- Detection ----------------------------------------------------------------

_NAME = r"[^\W\d_a-zа-яα-ωß-ÿ][^\W\d_]*(?:[-'’][^\W\d_]+)?"
_titles = "|".join(sorted(_TITLE_GENDER, key=len, reverse=True))
_NAME = rf"(?!(?:{_titles})(?!\w)){_NAME}"  # a title begins another name
_given = "|".join(sorted(_GENDER, key=len, reverse=True))

# Words before a secret; those of pass phrases; words before a person's name.
_SECRET_WORDS = r"(?:api|access|secret|private|session)[_-]?key|(?:auth|access|refresh)[_-]?token|client[_-]?secret|key|token|secret|auth|authorization|bearer|credentials?"
_PASS_WORDS = r"password|passwd|passphrase|passwort|contraseña|pwd"
_NAME_CUES = (
    r"[Mm]y name is|[Nn]ame is|[Nn]ame:|[Cc]ontact:?|[Aa]ttn[.:]?|[Ss]igned,?|[Ss]incerely,|[Rr]egards,|[Yy]ours,|[Ii]ch heiße|"
    r"[Nn]ame ist|[Aa]nsprechpartner(?:in)?:?|[Jj]e m['’]appelle|[Nn]om:|[Mm]e llamo|[Nn]ombre:|[Mm]i nombre es"
)


def _secret_value(m: re.Match) -> bool:
    """Whether what follows a word for secrets is one: it holds letters and digits, or is quoted, or a pass phrase is set."""
    value = m.group(m.lastindex)
    mixed = re.search("[0-9]", value) is not None and re.search("[^\\W\\d_]", value) is not None
    quoted = m.string[m.start(m.lastindex) - 1] in "\"'"
    if re.match(_PASS_WORDS, m.group(), re.IGNORECASE):
        return mixed or quoted or m.group("sign") == "="
    return mixed or (quoted and len(value) >= 16 and " " not in value)


def _valid(kind: str, text: str) -> bool:
    """Whether an account number has the right check digits; other types have none of that kind."""
    plain = text.replace(" ", "")
    return kind != "iban" or (15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)


def _card_holds(m: re.Match) -> bool:
    """A number that banks issue, with the right check digit."""
    d = _digits(m.group())
    return (d[0] in "3456" or 2221 <= int(d[:4]) <= 2720) and _luhn(d[:-1]) == int(d[-1])


def _national(m: re.Match) -> bool:
    return 9 <= len(_digits(m.group())) <= 12


#: (type, what a text must contain, pattern, check), the first claim on a place wins.  A pattern's last group is the entity.
_RULES = [
    ("secret", "=:", re.compile(rf"(?i)(?<![^\W_])(?:{_SECRET_WORDS}|{_PASS_WORDS})[\"']?\s*(?P<sign>[:=])\s*(?:\"([^\"\n]{{4,}})\"|'([^'\n]{{4,}})'|([\w+/=.~-]{{8,}}))"), _secret_value),
    ("secret", "0123456789", re.compile(r"(?<![\w])(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|sk-[\w-]{20,}|xox[abp]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]+)(?![\w])"), None),
    ("secret", "0123456789", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"), None),
    ("email", "@", re.compile(r"(?<![\w.+'-])[_.+'-]*+([^\W_][\w.+'-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)"), None),
    ("iban", "0123456789", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), lambda m: _valid("iban", m.group())),
    ("ip", ".", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"), None),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
    ("card", "0123456789", re.compile(r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"), _card_holds),
    ("phone", "+", re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,5}){1,5}(?![0-9])"), None),
    ("phone", "0123456789", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    ("phone", "0123456789", re.compile(r"(?<![\w+./-])0[0-9]{2,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5})?(?![\w]|[.,/-][0-9])"), _national),
    ("person", "".join({t[0] for t in _TITLE_GENDER}), re.compile(rf"(?<!\w)(?:{_titles})\.?[ \t]+{_NAME}(?:[ \t]+{_NAME}){{0,2}}"), None),
    ("person", "", re.compile(rf"(?<!\w)(?:{_given})(?:[ \t]+{_NAME}){{1,2}}"), None),
    ("person", "", re.compile(rf"(?<!\w)(?:{_NAME_CUES})[ \t]+({_NAME}(?:[ \t]+{_NAME}){{1,2}})"), None),
]
_NAMES_IN_A_ROW = re.compile(rf"(?<!\w){_NAME}(?:[ \t]+{_NAME})+")
_NAME_WORD = re.compile(r"[^ \t]+")


def _claim(found: list[tuple[int, int, str]], new: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both lists in order, without those of ``new`` that lie on one of ``found``, or on an earlier one of ``new``."""
    if not new:
        return found
    out: list[tuple[int, int, str]] = []
    i = last = 0
    for span in new:
        if span[0] < last:
            continue
        while i < len(found) and found[i][1] <= span[0]:
            out.append(found[i])
            i += 1
        if i == len(found) or found[i][0] >= span[1]:
            out.append(span)
            last = span[1]
    return [*out, *found[i:]]


def _told_again(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where names of two words or more that are known from elsewhere in the text stand by themselves."""
    known = {tuple(words) for a, b, k in found if k == "person" if len(words := canonical("person", text[a:b]).split()) > 1}
    out: list[tuple[int, int, str]] = []
    if known:
        longest = max(map(len, known))
        for row in _NAMES_IN_A_ROW.finditer(text):
            words = [(m.start(), m.end(), m.group()) for m in _NAME_WORD.finditer(text, *row.span())]
            for i in range(len(words) - 1):
                n = next((n for n in range(min(longest, len(words) - i), 1, -1) if tuple(w[2] for w in words[i : i + n]) in known), 0)
                if n:
                    out.append((words[i][0], words[i + n - 1][1], "person"))
    return out


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all entities of a text, in order, without overlap.

    Secrets follow a word for them and hold letters and digits, or are quoted;
    cards and accounts have the right check digits; persons follow a title, a
    listed given name or words that announce a name, and are then found
    wherever their whole name stands.  Time is linear in the text and in what
    is found.
    """
    digits = re.search("[0-9]", text) is not None
    found: list[tuple[int, int, str]] = []
    for kind, needs, pattern, check in _RULES:
        if needs and not (digits if needs[0] == "0" else any(c in text for c in needs)):
            continue
        found = _claim(found, [(*m.span(_entity_group(m)), kind) for m in pattern.finditer(text) if check is None or check(m)])
    return _claim(found, _told_again(text, found))


def _entity_group(m: re.Match) -> int:
    return m.lastindex or 0


def replace_entities(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str, int]]]:
    """The text with surrogates, and (type, canonical digest, surrogate, start) of each."""
    out, at, listed = [], 0, []
    length = 0
    for a, b, kind in find_entities(text):
        new = surrogate(kind, text[a:b], key)
        out += [text[at:a], new]
        length += a - at
        digest = hashlib.blake2b(canonical(kind, text[a:b]).encode(), key=key[:64], digest_size=16).hexdigest()
        listed.append((kind, digest, new, length))
        length += len(new)
        at = b
    return ("".join([*out, text[at:]]) if listed else text), listed


_ENTITIES = "array<struct<kind:string,entity:string,surrogate:string,start:int>>"
_LIST_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string()), ("start", pa.int32())]))


def replace_pii(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and a list ``entities``.

    An entity's entry has its type, a keyed digest of the original (equal for
    one entity in any spelling), the surrogate, and its place in the new text.
    Nulls stay null and have no entities, like empty texts; other columns pass
    unchanged; ``entities`` takes the place of an equal name.
    """
    order = [c for c in (docs.columns if keep is None else keep) if c != "entities"]

    def add(data, offsets) -> list[pa.Array]:
        raw = data.tobytes()
        texts, lists = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            new, listed = replace_entities(raw[a:b].decode("utf-8"), key)
            texts.append(new)
            lists.append([dict(zip(("kind", "entity", "surrogate", "start"), x, strict=True)) for x in listed])
        return [pa.array(texts, pa.string()), pa.array(lists, _LIST_TYPE)]

    marked = docs.select(*[F.col(f"`{c}`") for c in order if c != text], F.col(f"`{text}`").alias("_original"))
    rest = [c for c in order if c != text]
    out = with_columns(marked, "_original", add, [("_new", "string"), ("entities", _ENTITIES)], keep=[*rest, "_original"])
    value = F.when(F.col("_original").isNotNull(), F.col("_new"))
    return out.select(*[value.alias(text) if c == text else F.col(f"`{c}`") for c in order], "entities")


def collisions(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """Surrogates that stand for more than one entity in a corpus; none if all is well.

    Returns ``kind, surrogate, n``.  Surrogates are compared without their
    spelling: case, separators, and titles of persons.
    """
    bare = F.regexp_replace("e.surrogate", rf"^(?:{_titles})\\.?\\s+", "")
    plain = F.when(F.col("e.kind") == "person", bare).when(F.col("e.kind") == "phone", F.regexp_replace(F.regexp_replace("e.surrogate", r"^\+\d{1,3}(?=[ .(-])|^\+1|^\+\d\d", ""), r"\D", ""))
    plain = plain.when(F.col("e.kind").isin("card", "ssn"), F.regexp_replace("e.surrogate", r"\D", "")).when(F.col("e.kind") == "iban", F.regexp_replace("e.surrogate", " ", ""))
    plain = plain.when(F.col("e.kind") == "email", F.lower("e.surrogate")).otherwise(F.col("e.surrogate"))
    pairs = replaced.select(F.explode(entities).alias("e")).select("e.kind", "e.entity", plain.alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verified(replaced: DataFrame, strict: bool = True) -> DataFrame:
    """``replaced`` as a table in the shared folder, once ``collisions`` has gone over it.

    A collision raises an error, or gives a warning if not ``strict``.
    """
    out = materialize(replaced)
    n = collisions(out).count()
    if n and strict:
        raise ValueError(f"{n} surrogates stand for more than one entity")
    if n:
        warnings.warn(f"{n} surrogates stand for more than one entity", stacklevel=2)
    return out
