"""Surrogates for personal data: every entity gets a keyed replacement of its own type, gender, script and format.

A replacement depends on a secret key and the entity's normal form alone, so an entity has the same surrogate
wherever it occurs (coreference). Surrogates of different entities are kept apart (distinctness): all
distinct entities of the corpus propose a surrogate, and those whose proposal is taken, or is itself an
entity of the corpus, propose again until none is left. Texts whose entities all kept their first proposal are
rewritten where they lie; only the others meet the table of later ones.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, flagged, materialise

#: Bits of the broadcast bitmap of texts that hold an entity.
FOUND_BITS = 1 << 24

# Titles with the gender they tell, and given names by script and gender.
TITLES = {
    "m": "Mr Herr Señor Sr Monsieur Signor Господин Кύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Signora Госпожа Κυρία".split(),
    "": "Dr Prof Доктор".split(),
}
GIVEN = {
    ("latin", "m"): "James Robert Michael David Thomas Daniel Peter Paul Martin Lukas Felix Jonas Hugo Louis Antoine Pierre Carlos Miguel Javier Pablo".split(),
    ("latin", "f"): "Mary Patricia Linda Susan Karen Anna Laura Julia Sophie Marie Camille Claire Emma Lena Hanna Carmen Lucía Elena Isabel Marta".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Вера Нина".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Πέτρος Παύλος Ανδρέας Μιχάλης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δέσποινα Ειρήνη Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "bar ben cor dal den fal gar hal jen kel lan lor mar mel nor pol ras rem sal ser tal tor van wes zan".split(),
    "cyrillic": "бар вел гор дан жел зор кам лен мар нов пет рус сав тал фед".split(),
    "greek": "βασ γαλ δημ ζαν θεο καλ λαμ μαν νικ παπ ραλ σαβ ταρ φωτ χατ".split(),
}
ENDINGS = {"latin": "son ley ton man er ez ini".split(), "cyrillic": "ов ев ин".split(), "greek": "όπουλος ίδης άκης".split()}

_GENDER = {t: g for g, titles in TITLES.items() for title in titles for t in (title, title.upper())} | {n: g for (_, g), names in GIVEN.items() for n in names}
_GIVEN = {n for names in GIVEN.values() for n in names}
_TITLE = "|".join(sorted({x for ts in TITLES.values() for t in ts for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
NAME = re.compile(rf"\b(?:(?P<title>{_TITLE})\.?[ \xa0](?P<one>{_NAME})(?:[ \xa0](?P<two>{_NAME}))?|(?P<given>{'|'.join(sorted(_GIVEN))})[ \xa0](?P<last>{_NAME}))\b")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b")
NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
)
#: Proposals after which a surrogate may be longer than what it stands for, so that one is always free.
ROOMIER = 12


def script_of(word: str) -> str:
    code = ord(word[0].lower())
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) in order, not overlapping; kinds of names tell script and gender."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in NUMBERS.finditer(text):
        kind = m.lastgroup
        normal = m[0] if kind == "ip" else re.sub(r"[^0-9A-Z+]", "", m[0])
        found.append((m.start(), m.end(), kind, normal))
    for m in NAME.finditer(text):
        last = "last" if m["given"] else "two" if m["two"] else "one"
        first = "given" if m["given"] else "one" if m["two"] else None
        if first:
            gender = _GENDER.get(m["title"] or "") or _GENDER.get(m[first].title(), "") or "m"
            found.append((*m.span(first), f"given:{script_of(m[first])}:{gender}", m[first].lower()))
        found.append((*m.span(last), f"surname:{script_of(m[last])}", m[last].lower()))
    out, end = [], 0
    for entity in sorted(found, key=lambda e: (e[0], -e[1])):
        if entity[0] >= end:
            out.append(entity)
            end = entity[1]
    return out


class Stream:
    """Keyed pseudo-random choices for one proposal of one entity."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{normal}\0{attempt}".encode(), hashlib.sha256).digest()
        self.left, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _shape(text: str, stream: Stream) -> str:
    """Digits become digits, ASCII letters letters of their case; the rest stays."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(chr(48 + stream.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + stream.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + stream.below(26)))
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def proposal(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """Normal form of the surrogate an entity proposes."""
    s = Stream(key, kind, normal, attempt)
    more = "".join(str(s.below(10)) for _ in range(max(0, attempt - ROOMIER)))
    if kind == "email":
        local, _, host = normal.partition("@")
        labels = host.split(".")
        return f"{_shape(local, s)}{more}@{'.'.join(_shape(x, s) for x in labels[:-1])}.{labels[-1]}"
    if kind == "ip":
        return ".".join(str(max(1, s.below(9 if len(o) == 1 else 90 if len(o) == 2 else 155) + {1: 1, 2: 10}.get(len(o), 100))) for o in normal.split(".")) + more
    if kind == "card":
        body = normal[0] + _shape(normal[1:], s) + more
        if luhn(normal):
            body = next(body[:-1] + d for d in "0123456789" if luhn(body[:-1] + d))
        elif luhn(body):
            body = body[:-1] + str((int(body[-1]) + 1) % 10)
        return body
    if kind == "phone":
        keep = 2 if normal[0] == "+" else 0
        return normal[:keep] + _shape(normal[keep:], s) + more
    if kind == "iban":
        return normal[:2] + _shape(normal[2:], s) + more
    if kind.startswith("given:"):
        _, script, gender = kind.split(":")
        pool = GIVEN[script, gender]
        name = pool[s.below(len(pool))]
        if attempt >= 3:
            name += "-" + pool[s.below(len(pool))]
        return (name + SYLLABLES[script][s.below(len(SYLLABLES[script]))] * (attempt >= 6) + "".join(SYLLABLES[script][int(d)] for d in more)).lower()
    if kind.startswith("surname:"):
        script = kind.split(":")[1]
        parts = [SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 4)]
        return "".join(parts) + ENDINGS[script][s.below(len(ENDINGS[script]))]
    return _shape(normal, s) + more


def dressed(seen: str, kind: str, normal: str) -> str:
    """The surrogate's normal form in the format of the occurrence: its separators, its case."""
    if kind.startswith(("given:", "surname:")):
        return normal.upper() if seen.isupper() and len(seen) > 1 else "-".join(p.capitalize() for p in normal.split("-"))
    if kind == "email":
        return normal.upper() if seen.isupper() else normal
    if kind == "ip":
        return normal
    signs = iter(normal)
    body = "".join(next(signs, "") if re.match(r"[0-9A-Z+]", c) else c for c in seen)
    return body + "".join(signs)


def rewritten(text: str, key: bytes, later: dict[tuple[str, str], int]) -> tuple[str, int]:
    """Text with surrogates, and how many entities it had."""
    found, out, end = entities(text), [], 0
    for a, b, kind, normal in found:
        out += [text[end:a], dressed(text[a:b], kind, proposal(key, kind, normal, later.get((kind, normal), 0)))]
        end = b
    return "".join(out) + text[end:], len(found)


def assignments(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, surrogate, attempt) of every entity, surrogates all different and no entity of the corpus.

    Kinds of one space (all given names of a script, say) are compared together. Of the entities that propose
    the same, the one with the smallest normal form has it. Rounds go on until all have one; each is written.
    """
    space = F.element_at(F.split("kind", ":"), 1)
    cells = "kind string, normal string, surrogate string, attempt int"

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([proposal(key, *r) for r in rows], pa.string()), batch.column(2)],
                names=["kind", "normal", "surrogate", "attempt"],
            )

    all_rows = distinct.select(space.alias("space"), F.col("normal").alias("surrogate")).distinct()
    waiting, done = distinct.withColumn("attempt", F.lit(0)), None
    while True:
        offer = materialise(waiting.mapInArrow(propose, cells)).withColumn("space", space)
        free = offer.join(all_rows, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.withColumn("space", space), ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("normal", "kind", "attempt")).alias("w")).select("w.kind", "w.normal", "surrogate", "w.attempt")
        won = materialise(won)
        waiting = materialise(offer.join(won, ["kind", "normal"], "left_anti").select("kind", "normal", (F.col("attempt") + 1).alias("attempt")))
        done = won if done is None else done.unionByName(won)
        if waiting.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: bytes, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``ident``, ``n_entities``, ``text`` with surrogates.

    Whole texts are read. A null text stays null, an empty one empty, both without entities. Repeated rows and
    null idents stay, each rewritten alike. Other columns are not read. A text is rewritten in one task; only
    distinct entities, and texts with an entity whose first proposal was taken, are shuffled.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, 8 << 20):
            rows = [(at, kind, normal) for at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for kind, normal in {e[2:] for e in entities(t)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["at", "kind", "normal"])

    inner = docs.select(F.col(ident).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("at"))
    found = materialise(inner.select("at", "t").mapInArrow(find, "at bigint, kind string, normal string"))
    given = materialise(assignments(found.select("kind", "normal").distinct(), key))
    again = given.filter("attempt > 0").select("kind", "normal", "attempt")
    # entities of one text: as many as it has
    later = materialise(found.join(again, ["kind", "normal"]).groupBy("at").agg(F.collect_set(F.struct("kind", "normal", "attempt")).alias("later")))
    kind = docs.schema[ident].dataType.simpleString()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, 8 << 20):
            out = []
            for t, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(rewritten(t, key, {(r["kind"], r["normal"]): r["attempt"] for r in rows or ()}) if t else (t, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in out], pa.int64()), pa.array([t for t, _ in out], pa.string())], names=["k", "n", "t"]
            )

    # texts without an entity stay as they are and are not searched again
    marked = flagged(flagged(inner, "at", found.select("at").distinct(), "holds", FOUND_BITS), "at", later.select("at"), "meets")
    none = F.lit(None).cast("array<struct<kind:string,normal:string,attempt:int>>")
    plain = marked.filter(~F.col("holds")).select("k", F.lit(0).cast("bigint").alias("n"), "t")
    apart = marked.filter(F.col("holds") & ~F.col("meets")).select("k", "t", none.alias("later"))
    meeting = marked.filter("holds AND meets").join(later, "at", "left").select("k", "t", "later")
    cells = f"k {kind}, n bigint, t string"
    return plain.unionByName(apart.mapInArrow(rewrite, cells)).unionByName(meeting.mapInArrow(rewrite, cells)).toDF(ident, "n_entities", "text")
