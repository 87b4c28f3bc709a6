"""PII surrogates: every detected entity is replaced by a keyed stand-in of its own type.

E-mail addresses, phone and card numbers, IPv4 addresses, social security numbers, IBANs and names are found in whole
texts. A title or a listed given name tells a name, which is all capitalised words that follow; every other mention of
these words in the text is then replaced too. An entity's stand-in comes from an HMAC of its type and its normal form, so one person or number has one
stand-in throughout the corpus (coreference), however it is spelled; shape, separators, letter case, script and, for
given names, gender are kept, and check digits hold. Stand-ins are checked over the corpus: where two values met on
one stand-in, or a stand-in is some other entity's true value, all but the least value draw again (distinctness). Names
and local parts of addresses grow with each redraw, phone numbers after GROWS redraws, and after LENGTHENS redraws also the kinds
whose length is fixed (a digit more; a port for addresses), so that no pool of stand-ins is ever used up.

Defined results: a null or empty text stays as it is, with no entities. Of overlapping entities the one found by the
earlier kind in KINDS stays. Repeated rows are rewritten alike. Columns named like results are replaced; names that
begin with two underscores are reserved.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import extended, narrow_batches, staged

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "given", "family")

# Forms of address by the gender they tell, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    "f": ["Anna", "Maria", "Emma", "Sophie", "Julia", "Laura", "Sarah", "Emily", "Claire", "Camille", "Elena", "Lucía", "Carmen", "Greta", "Ingrid", "Alice", "Mary", "Jennifer", "Linda", "Elizabeth", "Susan", "Анна", "Мария", "Ольга", "Елена", "Μαρία", "Ελένη"],
    "m": ["John", "James", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Michel", "Carlos", "José", "Juan", "Pedro", "Luis", "Henry", "George", "Иван", "Пётр", "Сергей", "Олег", "Γιώργος", "Νίκος"],
}
SYLLABLES = {
    "latin": (list("bdfglmnprstv"), list("aeio")),
    "cyrillic": (list("бвгдклмнпрст"), list("аеио")),
    "greek": (list("βγδκλμνπρστφ"), list("αειο")),
}

# Words that end a name of two words or more even if capitalised, and whose other mentions are no names.
NO_NAMES = frozenset(
    "a an and are as at but by for from had has have he her his i if in is it its my no not of on or our she so that the their then there they this to was"
    " we were what when where which who will with you your aber als am an auf aus bei das dem den der des die ein eine er es für hat ich ihr im ist mit nach"
    " nicht sie sind und uns vom von vor war was wir wo zu zum zur au aux avec ce cette dans de des du elle elles en est et il ils je la le les leur lui mais"
    " ne nous ou où par pas pour qui sa se ses son sur un une vous al como con del el ella ellos era es esta este la las lo los más mi muy o para pero por que"
    " se sin su sus un una y ya и в во на не он она они с со что это как но по к у из за от до мы вы я ο η το οι τα και σε με για από του της των στο στη στην".split()
)
# Words of names that aren't capitalised.
PARTICLES = frozenset("van von der den de del della di da dos du la le las los bin ibn ter ten zu zur".split())

_NAME = r"[^\W\d_](?:[^\W\d_]|[-'’](?=[^\W\d_]))+"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_KNOWN = "|".join(sorted((g for gs in GIVEN.values() for g in gs), key=len, reverse=True))
MAIL_BOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = {
    # what may follow the mailbox; mails() looks for that from each @ to the left
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    # whole runs of groups; _phone tells which are numbers to call, PHONE_IN finds such inside runs that are too long
    "phone": re.compile(r"(?<![\w.+-])(?:\+|\(\+?)?\d+(?:(?:\) ?[-./]?|[ .-]\(?| ?/ ?|\()\d+)*(?![\w-])"),
}
PHONE_IN = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.])\+\d{9,14}(?!\w)")
# Digits in groups that are no number to call: a date with or without its hour, two years, one decimal number.
_DAY, _MONTH, _YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:1[5-9]|20)\d\d"
NO_PHONE = re.compile(
    rf"(?:{_YEAR}([-./ ]){_MONTH}\1{_DAY}|{_DAY}([-./ ]){_MONTH}\2{_YEAR}|{_MONTH}([-./ ]){_DAY}\3{_YEAR})(?: \d\d?(?:\.\d\d)?)?|{_YEAR} ?[-/ ] ?{_YEAR}|\d+\.\d+(?:[ /-]+\d+(?:\.\d+)?)*"
)
TITLED = re.compile(rf"(?<!\w)({_TITLE})\.? +(?=[^\W\d_])")
FULL = re.compile(rf"(?<!\w)({_KNOWN})(?:-[^\W\d_]+)* +(?=[^\W\d_])")
WORD, PART = re.compile(_NAME), re.compile(r"[^-'’]+")
# What may stand between the words of a name: blanks, and initials, which stay.
INITIALS = re.compile(r"(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]\.? +)*")
BETWEEN = re.compile(rf" +{INITIALS.pattern}")
GENDER = {g: s for s, gs in GIVEN.items() for g in gs}
ADDRESS = {t: s for s, ts in TITLES.items() for t in ts}
_DIGIT = re.compile(r"[0-9]")

# Redraws after which a stand-in has a digit more: for phone numbers, and for kinds whose length is fixed
# (their pool is all but used up by then).
GROWS, LENGTHENS = 8, 200


def mails(text: str) -> list[tuple[int, int]]:
    """Bounds of the mail addresses. Only what touches an @ is looked at, so long unbroken runs cost their length."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAIL_BOX:
            start -= 1
        host = PATTERNS["email"].match(text, at) if start < at else None
        if host:
            done = host.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits]
    doubled[-2::-2] = [sum(divmod(2 * d, 10)) for d in doubled[-2::-2]]
    return sum(doubled) % 10 == 0


def iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def script(name: str) -> str:
    first = name[0].lower()
    return "cyrillic" if "а" <= first <= "ё" else "greek" if "ά" <= first <= "ώ" else "latin"


def _bare(text: str, start: int, stop: int) -> int:
    """Where a word ends without an 's."""
    return stop - 2 if text[stop - 2 : stop] in ("'s", "’s") and stop - start > 3 else stop


def _names_from(text: str, at: int) -> list[tuple[int, int]]:
    """The words of a name that begins at a place: all capitalised words in a row, over initials and particles."""
    words: list[tuple[int, int]] = []
    gap = INITIALS.match(text, at)
    while gap:
        word = WORD.match(text, gap.end())
        while word and word[0] in PARTICLES and (gap := BETWEEN.match(text, word.end())):
            word = WORD.match(text, gap.end())
        if not word or not word[0][0].isupper() or (len(words) > 1 and word[0].lower() in NO_NAMES):
            break
        words.append((word.start(), _bare(text, *word.span())))
        gap = BETWEEN.match(text, words[-1][1])
    return words


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names by their places: those a title or a listed given name tells, then every other mention of their words."""
    runs: list[tuple[list[tuple[int, int]], str]] = []
    inside: set[int] = set()
    for m in TITLED.finditer(text):
        if m.start() not in inside:
            words = _names_from(text, m.end())
            runs.append((words, ADDRESS[m[1]]))
            inside.update(start for start, _ in words)
    for m in FULL.finditer(text):
        if m.start() not in inside:
            words = _names_from(text, m.start())
            if len(words) > 1:
                runs.append((words, GENDER[m[1]]))
                inside.update(start for start, _ in words)
    known: dict[str, tuple[str, str]] = {}
    found: dict[int, tuple[int, int, str, str]] = {}
    # full names first: they tell what a single word is
    for words, gender in sorted(runs, key=lambda run: (len(run[0]) < 2, run[0])):
        for k, (start, stop) in enumerate(words):
            low = text[start:stop].lower()
            listed = GENDER.get(low.split("-")[0].capitalize())
            if len(words) > 1 and (k == 0 or (listed and k < len(words) - 1)):
                what = ("given", f"{listed or gender}:{low}")
            else:
                what = ("family", low) if len(words) > 1 else known.get(low, ("family", low))
            found.setdefault(start, (start, stop, *what))
            if low not in NO_NAMES:
                known.setdefault(low, what)
    for m in WORD.finditer(text) if known else ():
        start, stop = m.start(), _bare(text, *m.span())
        if start in found:
            continue
        spans = [(start, stop)]
        if text[start:stop].lower() not in known:
            spans = [(start + part.start(), start + part.end()) for part in PART.finditer(text[start:stop])]
        for start, stop in spans:
            what = known.get(text[start:stop].lower())
            if what and text[start].isupper():
                found.setdefault(start, (start, stop, *what))
    return sorted(found.values())


def _phone(run: str) -> bool:
    """Whether a run of digit groups is a number to call: 8 to 15 digits, in groups or with a prefix."""
    digits = sum(c.isdigit() for c in run)
    grouped = any(not c.isdigit() for c in run)
    return 8 <= digits <= 15 and (grouped or run.startswith("00") or (run[0] == "0" and 10 <= digits <= 11)) and not NO_PHONE.fullmatch(run)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as ``(start, stop, kind, normal form)`` by start, in code points. A given name's form has its gender."""
    found: list[tuple[int, int, str, str]] = []
    taken: set[int] = set()

    def take(start: int, stop: int, kind: str, form: str) -> None:
        if taken.isdisjoint(range(start, stop)):
            taken.update(range(start, stop))
            found.append((start, stop, kind, form))

    if "@" in text:
        for start, stop in mails(text):
            take(start, stop, "email", text[start:stop].lower())
    if _DIGIT.search(text):
        for m in PATTERNS["iban"].finditer(text):
            plain = m[0].replace(" ", "")
            if iban_rest(plain) == 1:
                take(m.start(), m.end(), "iban", plain)
        for m in PATTERNS["card"].finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if luhn(digits):
                take(m.start(), m.end(), "card", digits)
        for m in PATTERNS["ssn"].finditer(text):
            take(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0]))
        for m in PATTERNS["ip"].finditer(text):
            take(m.start(), m.end(), "ip", str(ipaddress.ip_address(".".join(str(int(x)) for x in m[0].split(".")))))
        for m in PATTERNS["phone"].finditer(text):
            if _phone(m[0]):
                take(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0]))
        # what the run missed: numbers in longer runs, or beside another entity
        for m in PHONE_IN.finditer(text):
            take(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0]))
    for entity in _names(text):
        take(*entity)
    return sorted(found)


class Stream:
    """Numbers drawn from an HMAC of what they are for."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.block, self.bytes = key, "\0".join(what), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, f"{self.what}\0{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value % n


def _shaped(text: str, draw: Stream) -> str:
    """Digits for digits and letters for letters."""
    return "".join(str(draw.below(10)) if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[draw.below(26)] if c.isalpha() else c for c in text)


def _made_name(kind: str, form: str, draw: Stream, turn: int) -> str:
    gender, _, name = form.rpartition(":")
    consonants, vowels = SYLLABLES[script(name)]
    size = max(2, len(name) // 2) + (kind == "family") + turn
    word = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(size))
    if gender == "f":
        return word[:-1] + vowels[0]
    return word + consonants[draw.below(len(consonants))]


def stand_in(key: bytes, kind: str, form: str, turn: int) -> str:
    """The normal form of a value's stand-in; ``turn`` counts the draws before."""
    draw = Stream(key, kind, form, str(turn))
    more = turn // (GROWS if kind == "phone" else LENGTHENS)
    if kind == "email":
        local, _, domain = form.partition("@")
        host, _, top = domain.rpartition(".")
        # one domain has one stand-in, so addresses that share it still do
        return f"{_shaped(local + 'x' * turn, draw)}@{_shaped(host, Stream(key, 'domain', domain))}.{top}"
    if kind == "card":
        body = form[0] + "".join(str(draw.below(10)) for _ in range(len(form) - 2 + more))
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)] for c in form[4:] + "0" * more)
        return f"{form[:2]}{98 - iban_rest(form[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        host = ".".join(str(1 + draw.below(254)) for _ in range(4))
        return f"{host}:{10 ** more + draw.below(9 * 10 ** more)}" if more else host
    if kind in ("given", "family"):
        return _made_name(kind, form, draw, turn)
    # phone and social security numbers keep their first digit and, short of many redraws, their length
    return form[0] + "".join(str(draw.below(10)) for _ in range(len(form) - 1 + more))


def dressed(mention: str, kind: str, stand: str) -> str:
    """A stand-in in the style of a mention: its separators and its letter case."""
    if kind in ("card", "ssn", "phone", "iban"):
        signs = iter(stand)
        return "".join(next(signs, "") if c.isalnum() else c for c in mention) + "".join(signs)
    if kind in ("given", "family"):
        return stand.upper() if mention.isupper() else stand[0].upper() + stand[1:]
    if kind == "email" and len(stand) == len(mention):
        return "".join(s.upper() if c.isupper() else s for c, s in zip(mention, stand, strict=True))
    return stand


ENTITY = "struct<start:int,stop:int,kind:string,form:string>"


def entities(documents: DataFrame, text: str) -> DataFrame:
    """``(__id, __th, kind, form)`` with the places, one row per entity."""
    narrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(2).to_pylist()):
                for found in find(value) if value else ():
                    at.append(k)
                    rows.append(found)
            places = pa.array(at, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), *columns], names=["__id", "__th", "start", "stop", "kind", "form"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__th"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"__id {kind}, __th long, start int, stop int, kind string, form string")


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, form, stand)`` for every distinct value, no two values of a kind with one stand-in."""
    values = staged(found.groupBy("kind", "form").agg(F.lit(0).alias("turn")), "pii-values")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [stand_in(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "form", "turn", "stand"])

    # a given name's true value has no gender
    true = values.select(F.col("kind").alias("kind"), F.regexp_replace("form", "^[fmn]:", "").alias("stand")).distinct()
    settled, turn = None, 0
    waiting = values
    while True:
        drawn = staged(waiting.select("kind", "form", "turn").mapInArrow(draw, "kind string, form string, turn int, stand string"), "pii-drawn")
        everyone = drawn if settled is None else settled.unionByName(drawn)
        # whoever settled before keeps its stand-in; of those who draw now the least value does
        first = everyone.groupBy("kind", "stand").agg(F.min(F.struct("turn", "form")).alias("first"))
        good = drawn.join(first, ["kind", "stand"]).where((F.col("first.form") == F.col("form")) & (F.col("first.turn") == F.col("turn")))
        good = staged(good.select("kind", "form", "turn", "stand").join(true, ["kind", "stand"], "left_anti"), "pii-settled")
        settled = good if settled is None else settled.unionByName(good)
        waiting = drawn.join(good, ["kind", "form"], "left_anti").withColumn("turn", F.col("turn") + 1)
        if waiting.isEmpty():
            return settled.select("kind", "form", "stand")
        turn += 1


def pseudonymise(documents: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Rewrite ``text`` and add ``entities``, the number of entities by kind."""
    documents = documents.drop("entities")
    found = staged(entities(documents, text), "pii")
    stands = assigned(found, key)
    per_row = (
        found.dropDuplicates(["__id", "__th", "start"])
        .join(stands, ["kind", "form"])
        .groupBy("__id", "__th")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "stand"))).alias("__found"))
    )
    joined = documents.join(per_row, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left").drop("__id", "__th")
    narrow_batches(documents.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, last = batch.schema.get_field_index(text), batch.num_columns - 1
            texts, counts = [], []
            for value, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                parts, place, count = [], 0, {}
                for e in found or ():
                    parts += [value[place : e["start"]], dressed(value[e["start"] : e["stop"]], e["kind"], e["stand"])]
                    place = e["stop"]
                    count[e["kind"]] = count.get(e["kind"], 0) + 1
                texts.append("".join([*parts, value[place:]]) if parts else value)
                counts.append(list(count.items()))
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=[*batch.schema.names[:last], "entities"])

    return joined.mapInArrow(rewrite, extended(documents.schema, "entities map<string,bigint>"))
