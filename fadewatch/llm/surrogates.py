"""Personal data replaced by keyed surrogates of the same kind, format, script and gender.

An entity is (kind, canonical form). Its surrogate comes from an HMAC of a secret key, so one entity has one surrogate in
the whole corpus (coreference), and nobody without the key can link them back. Surrogates are checked against each other
and against all entities of the corpus by joins; an entity whose surrogate clashes takes its next attempt, round after
round, until all are distinct. Only entities that had to move are looked up again when texts are rewritten.
"""
from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged, text_key

#: Titles that announce a name: m, f or n (no gender). Fixed values.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Don": "m", "Doña": "f",
    "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f", "κύριος": "m", "Κύριος": "m", "κυρία": "f", "Κυρία": "f",
}
#: Titles that follow a name. Fixed values.
TITLES_AFTER = {"先生": "m", "女士": "f", "小姐": "f"}

#: What follows the name of a key: a closing quote (JSON, also escaped) and the sign before its value.
AFTER_KEY = r"\\*+[\"']?\s*+[=:]\s*+"
#: A secret's key may be part of a longer name (aws_secret_access_key, clientSecret, x-api-key), but not the start of a longer word (tokenizer).
PATTERN = regex.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?:(?<![\w-])(?=[\w-]++" + AFTER_KEY + r")(?>[\w-]*?(?i:api[_-]?key|access[_-]?key|secret|token|password|passwd)s?(?:[_\-0-9A-Z][\w-]*+)?(?![\w-]))"
    + AFTER_KEY + r"\\*+[\"']?(?P<secret>(?=[_+/=-]*[A-Za-z0-9])[A-Za-z0-9_+/=-]{16,})(?![A-Za-z0-9_+/=-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?:\b(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.?[ \u00a0](?P<person>\p{Lu}[\p{L}\p{M}'’-]+(?:[ \u00a0]\p{Lu}[\p{L}\p{M}'’-]+){0,2}))"
    r"|(?P<named>\p{Han}{2,3})(?P<after>" + "|".join(TITLES_AFTER) + ")"
)
#: A text without any of these has no entity: every branch of PATTERN needs a digit of any script, an @, the word of a key or a title.
HINT = regex.compile(r"[\d@]|(?i:key|secret|token|passw)|\b(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b|" + "|".join(TITLES_AFTER))


@dataclass(frozen=True)
class Mention:
    begin: int
    end: int
    kind: str
    canon: str


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def script_of(word: str) -> str:
    for name in ("CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI"):
        if any(unicodedata.name(c, "").startswith(name) for c in word):
            return name.lower()
    return "latin"


def _names(text: str, begin: int, gender: str) -> list[Mention]:
    """Each word of a name is an entity, so that a first and a last name keep their surrogates apart from each other."""
    words = [(m.start() + begin, m.group()) for m in regex.finditer(r"[^ \u00a0]+", text)]
    out = []
    for k, (at, word) in enumerate(words):
        role = "last" if k == len(words) - 1 else f"first-{gender}"
        out.append(Mention(at, at + len(word), f"{role}-{script_of(word)}", word.casefold()))
    return out


def mentions(text: str) -> list[Mention]:
    """Entities of a text in order, without overlap; later bare mentions of a name that a title announced belong to it."""
    if not HINT.search(text):
        return []
    out: list[Mention] = []
    for m in PATTERN.finditer(text):
        got = {k: v for k, v in m.groupdict().items() if v is not None}
        if "title" in got or "named" in got:
            name = "person" if "title" in got else "named"
            out += _names(got[name], m.start(name), TITLES[got["title"]] if "title" in got else TITLES_AFTER[got["after"]])
            continue
        kind, surface = next(iter(got.items()))
        if kind == "ip" and any(int(x) > 255 for x in surface.split(".")):
            continue
        if kind == "card" and not luhn(_digits(surface)):
            continue
        if kind == "iban" and iban_rest(surface.replace(" ", "")) != 1:
            continue
        canon = {"email": surface.lower(), "ip": surface, "secret": surface, "iban": surface.replace(" ", "")}.get(kind) or ("+" if surface.startswith("+") else "") + _digits(surface)
        out.append(Mention(m.start(kind), m.end(kind), kind, canon))
    people = {m.canon: m for m in reversed(out) if "-" in m.kind}
    if people:
        taken = [(m.begin, m.end) for m in out]
        bare = regex.compile(r"(?<![\p{L}\p{M}])(?:" + "|".join(regex.escape(text[m.begin : m.end]) for m in people.values()) + r")(?![\p{L}\p{M}])")
        for m in bare.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                of = people[m.group().casefold()]
                out.append(Mention(m.start(), m.end(), of.kind, of.canon))
    return sorted(out, key=lambda m: m.begin)


# ------------------------------------------------------------- surrogates


class Draws:
    """Endless keyed draws for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{canon}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        while len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def of(self, chars: str) -> str:
        return chars[self.below(len(chars))]


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
HEX = "0123456789abcdef"
#: Consonants, vowels, and endings of male, female and other names, by script.
SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", {"m": "nrodk", "f": "a", "n": "ens"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "нврдк", "f": "а", "n": "нвй"}),
    "greek": ("βγδκλμνπρστ", "αεηιο", {"m": "ς", "f": "αη", "n": "ςν"}),
}
#: First and last code point of the letters that other scripts draw from.
BLOCKS = {"cjk": (0x4E00, 0x9FA5), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "hangul": (0xAC00, 0xD7A3), "arabic": (0x0628, 0x064A), "hebrew": (0x05D0, 0x05EA), "devanagari": (0x0915, 0x0939)}


def _shape(word: str, draw: Draws) -> str:
    return "".join(draw.of(LETTERS) if c in LETTERS else draw.of(LETTERS.upper()) if c in LETTERS.upper() else draw.of(DIGITS) if c in DIGITS else c for c in word)


def _name(kind: str, canon: str, draw: Draws, attempt: int) -> str:
    role, script = kind.rsplit("-", 1)
    if script in BLOCKS:
        lo, hi = BLOCKS[script]
        letters = "".join(chr(c) for c in range(lo, hi + 1) if unicodedata.category(chr(c)) == "Lo") if hi - lo < 200 else None
        return "".join(draw.of(letters) if letters else chr(lo + draw.below(hi - lo + 1)) for _ in range(len(canon) + attempt // 4))
    consonants, vowels, ends = SYLLABLES[script]
    n = min(4, max(2, len(canon) // 3)) + attempt // 4
    word = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(n))
    gender = role[-1] if role.startswith("first") else "n"
    last = draw.of(ends[gender])
    return word[:-1] + last if last in vowels else word + last


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the replacement; later attempts also grow where the format leaves room."""
    draw = Draws(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        place = Draws(key, "domain", domain, 0)  # addresses of one domain stay together
        top = labels[-1] if labels[-1] in ("com", "net", "org") else "com"
        return _shape(local + "x" * (attempt // 4), draw) + "@" + ".".join(_shape(x, place) for x in (labels[:-2] or labels[:1])) + ".example." + top
    if kind == "phone":
        plus, digits = canon[: canon.startswith("+")], canon.lstrip("+")
        own = min(10, len(digits))
        new = [draw.of(DIGITS) for _ in range(own)]
        new[0] = draw.of("23456789")
        if own == 10:
            new[3] = draw.of("23456789")
        return plus + digits[: len(digits) - own] + "".join(new)
    if kind == "ip":
        parts = canon.split(".")
        keep = 1 if parts[0] == "10" else 2 if parts[:2] == ["192", "168"] or (parts[0] == "172" and 16 <= int(parts[1]) < 32) else 0
        return ".".join(parts[:keep] + [str(11 + draw.below(115) if k == 0 else 1 + draw.below(254)) for k in range(keep, 4)])
    if kind == "ssn":
        return "9" + "".join(draw.of(DIGITS) for _ in range(8))  # numbers that are never given out
    if kind == "card":
        body = canon[0] + "".join(draw.of(DIGITS) for _ in canon[2:])
        return next(body + c for c in DIGITS if luhn(body + c))
    if kind == "iban":
        body = "".join(draw.of(DIGITS) if c in DIGITS else draw.of(LETTERS.upper()) for c in canon[4:])
        return f"{canon[:2]}{98 - iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        if all(c in HEX for c in canon):
            return "".join(draw.of(HEX) for _ in canon)
        return _shape(canon, draw)
    return _name(kind, canon, draw, attempt)


def rendered(kind: str, surface: str, new: str) -> str:
    """The surrogate in the format of the surface: its separators, its capitals."""
    if kind in ("phone", "ssn", "card", "iban"):
        fill = iter(new.lstrip("+") if kind == "phone" else new)
        return "".join(next(fill) if c.isalnum() else c for c in surface)
    if kind == "email":
        return new.upper() if surface.isupper() else new
    if "-" in kind:
        return new.upper() if surface.isupper() and len(surface) > 1 else new[:1].upper() + new[1:] if surface[:1].isupper() else new
    return new


def rewritten(text: str, key: bytes, moved: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions."""
    out, at, found = [], 0, mentions(text)
    for m in found:
        new = surrogate(key, m.kind, m.canon, moved.get((m.kind, m.canon), 0))
        out += [text[at : m.begin], rendered(m.kind, text[m.begin : m.end], new)]
        at = m.end
    return "".join([*out, text[at:]]), len(found)


# ------------------------------------------------------------- corpus


def corpus_mentions(docs: DataFrame) -> DataFrame:
    """Distinct (text_key1, text_key2, kind, canon) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, canon = [], [], []
            for k, t in enumerate(batch.column(2)):
                for pair in {(m.kind, m.canon) for m in mentions(t.as_py() or "")}:
                    row.append(k)
                    kind.append(pair[0])
                    canon.append(pair[1])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(kind, pa.string()), pa.array(canon, pa.string())], names=["text_key1", "text_key2", "kind", "canon"])

    return docs.select(*text_key(), "text").mapInArrow(run, "text_key1 bigint, text_key2 bigint, kind string, canon string").distinct()


def with_surrogates(entities: DataFrame, key: bytes, attempt: int, make=surrogate) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [make(key, k.as_py(), c.as_py(), attempt) for k, c in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "canon", "new"])

    return entities.select("kind", "canon").mapInArrow(run, "kind string, canon string, new string")


def assign(entities: DataFrame, key: bytes, make=surrogate) -> DataFrame:
    """(kind, canon, new, attempt): distinct surrogates for distinct entities (kind, canon), none of them an entity itself.

    Of entities that draw the same surrogate the first in the order of canon keeps it. Every round settles at least the
    first of each clash; the share that clashes falls with each round.
    """
    entities = staged(entities)
    originals = entities.select("kind", F.col("canon").alias("new"))
    pending, settled, attempt = entities, None, 0
    while True:
        drawn = staged(with_surrogates(pending, key, attempt, make))
        free = drawn.join(originals, ["kind", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "new"), ["kind", "new"], "left_anti")
        won = staged(free.groupBy("kind", "new").agg(F.min("canon").alias("canon")).withColumn("attempt", F.lit(attempt)))
        settled = won if settled is None else staged(settled.unionByName(won))
        pending = staged(drawn.select("kind", "canon").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return settled
        attempt += 1


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities (mentions replaced).

    Texts without entities come back unchanged; a null text stays null with 0. All other columns are kept, but for one
    named n_entities, which is replaced. Copies of a text get the same replacements. The key is a secret of the caller.
    """
    docs = docs.drop("n_entities")
    found = staged(corpus_mentions(docs))
    settled = assign(found.select("kind", "canon").distinct(), key)
    moved = settled.filter("attempt > 0").select("kind", "canon", "attempt")
    moves = found.join(moved, ["kind", "canon"]).groupBy("text_key1", "text_key2").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_moves"))
    keyed = docs.withColumns(dict(zip(("text_key1", "text_key2"), text_key(), strict=True)))
    rows = keyed.join(staged(moves), ["text_key1", "text_key2"], "left").select(*(keyed[c] for c in docs.columns), "_moves")
    schema = docs.select("*", F.lit(0).cast("bigint").alias("n_entities")).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count = [], []
            for t, m in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                new, n = rewritten(t.as_py(), key, {(x["kind"], x["canon"]): x["attempt"] for x in m.as_py() or []}) if t.is_valid else (None, 0)
                texts.append(new)
                count.append(n)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
