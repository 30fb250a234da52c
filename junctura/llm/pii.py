"""Personal data replaced by keyed surrogates of the same type and format.

Emails, phone numbers, card numbers, account numbers (IBAN), IPv4 addresses, passwords and tokens, and
names behind a form of address are found by patterns; names that stand alone are not. Each distinct value has one surrogate in the
whole corpus, whatever its surface (coreference): a keyed hash picks digits for digits, letters for letters
of the same case and script, a given name of the same gender; punctuation, length, country code, top-level
domain and check digits stay valid. Values are made of parts with surrogates of their own: an address of its local part and its domain, a
name of given name and surname, so all addresses of a domain and all names of a family stay together; a surname that has a
form for each gender keeps both.

Surrogates are checked over the whole corpus: no two values of a type share one, and none is itself a
value that occurs. A value that fails is tried again with the next attempt, until none is left; every
``GROW`` attempts names and domains gain a syllable and emails, secrets, phone numbers and names of other scripts a character, so a
small space cannot run out. Cards, accounts and addresses have a fixed length; if a value is
still left after ``MAX_ATTEMPTS``, the job fails rather than give a surrogate twice. Only attempts above 0 are handed to the replacing
pass, with the documents they concern. Texts are searched twice: once for the values, once to replace them.

Defined cases: null text stays null with no entities; without entities a text stays as it is; repeated rows are
treated alike; a null doc_id is no hindrance; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import text as tx

#: The key of the registered query; whoever uses ``pseudonymise`` gives a key of their own.
OP8_KEY = b"key of the registered query"
MAX_ATTEMPTS = 60
GROW = 4
BROADCAST_ROWS = 200_000

EMAIL = re.compile(r"[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
CARD = re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?!\d{4}-\d\d-\d\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w]|\.\d)|(?<![\w.])\+\d{8,15}(?!\w)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"(?i)\b(?:password|passwd|passwort|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{6,})")
#: Forms of address by gender, and titles that may stand between them and a name.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "господин", "г-н", "Κύριος", "κύριος", "Κύριε", "κ.")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mademoiselle", "Mme", "Mlle", "Госпожа", "госпожа", "г-жа", "Κυρία", "κυρία", "κα.")
TITLES = ("Dr", "Drs", "Prof", "Professor", "Professorin", "Doktor", "Doctor", "Dra", "Docteur", "Ing", "Dipl", "Mag", "med", "phil", "rer", "nat", "jur", "h", "c", "mult", "Rev", "Hon", "Maître", "Me", "проф", "д-р", "доктор", "δρ", "Δρ", "καθ")
#: A name is one or two capitalised words, the second one optional, behind a form of address and its titles.
NAME = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, sorted((*MALE, *FEMALE), key=len, reverse=True)))})\.?[ ](?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})(?:\.?-(?=\w)|\.[ ]?|[ ]))*((?!(?:Dr|Dra|Prof|Δρ|δρ)\b)(?:[^\W\d_a-z][^\W\d_]*(?:[-'][^\W\d_]+)*)(?:[ ][^\W\d_a-z][^\W\d_]+)?)")
_ADDRESSED = re.compile("|".join(sorted({re.escape(a[:3]) for a in (*MALE, *FEMALE)})))
#: Given names by script and gender.
GIVEN = {
    ("LATIN", "m"): "James Robert Michael David Daniel Thomas Martin Peter Paul Simon Lukas Felix Carlos Miguel Antoine Louis".split(),
    ("LATIN", "f"): "Mary Linda Susan Karen Laura Emma Anna Sarah Julia Sophie Clara Lena Lucia Carmen Camille Juliette".split(),
    ("CYRILLIC", "m"): "Иван Пётр Сергей Андрей Николай Дмитрий Михаил Павел".split(),
    ("CYRILLIC", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Вера".split(),
    ("GREEK", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
    ("GREEK", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική".split(),
}
#: Calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
SYLLABLES = {
    "LATIN": "ba ben ber bor da del dor fa fen gar hal hol jan kan kel lan len lor mar mel mon nor par per ran rin sal sen sor tal ten tor val ver win".split(),
    "CYRILLIC": "ба бор ва вер гор дан дор ел зар ив кал кол лан лев мар мин нов пав рад род сав сем тар тол".split(),
    "GREEK": "βα γε δη ελ ζα θε κα λα μα να πα ρη σα τα φι χα".split(),
}
#: Endings of surnames by script: masculine, feminine.
ENDS = {"CYRILLIC": ("ов", "ова"), "GREEK": ("δης", "δου")}
#: Feminine endings of surnames and their masculine forms.
FEMININE = (("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ская", "ский"), ("δου", "δης"), ("ου", "ος"))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of the entities of a text, in order and without overlaps."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    if any("0" <= c <= "9" for c in set(text)):
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in CARD.finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(text)]
        found += [(m.start(), m.end(), "phone", value) for m in PHONE.finditer(text) if len(value := re.sub(r"[^\d+]", "", m[0])) >= 8]
    if _ADDRESSED.search(text):
        found += [(m.start(2), m.end(2), "name_m" if m[1] in MALE else "name_f", " ".join(m[2].split()).casefold()) for m in NAME.finditer(text) if m[2][0].isupper()]
    out, last = [], 0
    for x in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
        if x[0] >= last:
            out.append(x)
            last = x[1]
    return out


class _Stream:
    """Numbers from a keyed hash of a value."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.n, self.pool = hmac.new(key, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


def _like(text: str, s: _Stream) -> str:
    """Digits for digits and letters for letters of the same case and script."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(chr(48 + s.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + s.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + s.below(26)))
        elif c.isalpha():
            base = ord(c) & ~31
            near = [chr(x) for x in range(base, base + 32) if chr(x).isalpha() and chr(x).isupper() == c.isupper() and chr(x).islower() == c.islower()]
            out.append(near[s.below(len(near))] if near else c)
        else:
            out.append(c)
    return "".join(out)


def _script(text: str) -> str:
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            return name if name in SYLLABLES else ""
    return "LATIN"


def parts(kind: str, value: str) -> list[tuple[str, str]]:
    """The values that have a surrogate of their own."""
    if kind == "email":
        return [(kind, value), ("domain", value.rpartition("@")[2])]
    if kind.startswith("name"):
        *given, last = value.split(" ")
        if kind == "name_f":
            last = next((last.removesuffix(f) + m for f, m in FEMININE if last.endswith(f) and len(last) > len(f)), last)
        return [*((f"given_{kind[-1]}", g) for g in given), ("surname", last)]
    return [(kind, value)]


def _family(script: str, s: _Stream, n: int) -> str:
    return "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(n))


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a part."""
    s, grown = _Stream(key, kind, value, attempt), attempt // GROW
    if kind == "email":  # with the domain as it was, which has a surrogate of its own
        local, _, domain = value.rpartition("@")
        return f"{_like(local + 'a' * grown, s)}@{domain}"
    if kind == "domain":
        *labels, top = value.split(".")
        kept = ("example", "www", "mail")
        made = [x if x in kept else _like(x, s) for x in labels]
        if all(x in kept for x in labels):  # nothing in it to replace but what is no name
            return value if value in ("example.com", "www.example.com", "mail.example.com") else f"{_family('LATIN', s, 2 + grown)}.{value}"
        return ".".join([*made[:-1], made[-1] + _family("LATIN", s, grown), top])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == luhn(value))
    if kind == "phone":
        code = ""
        if value.startswith("+"):
            code = value[: 2 if value[1] in "17" else 3 if value[1:3] in CALLING_CODES else 4]
        return code + "".join(str(s.below(10)) for _ in value[len(code) :] + "0" * grown)
    if kind == "iban":
        body = _like(value[4:], s)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", value):
            return "".join("0123456789abcdef"[s.below(16)] for _ in range(len(value) + grown))
        # a secret without a letter or digit has nothing to replace
        return _like((value if any(map(str.isalnum, value)) else "a" * len(value)) + "a" * grown, s)
    script = _script(value)
    if not script:
        return _like(value + value[-1] * grown, s)
    if kind == "surname":
        return _family(script, s, 3 + grown) + ENDS.get(script, ("",))[0]
    names = GIVEN[script, kind[-1]]
    return names[s.below(len(names))].casefold() + _family(script, s, grown)


def replacement(kind: str, value: str, tried: dict[tuple[str, str], int], key: bytes) -> str:
    """The canonical surrogate of an entity, put together from those of its parts."""
    made = [surrogate(k, v, tried.get((k, v), 0), key) for k, v in parts(kind, value)]
    if kind == "email":
        return f"{made[0].rpartition('@')[0]}@{made[1]}"
    if kind == "name_f":
        for masculine, feminine in ENDS.values():
            if made[-1].endswith(masculine):
                made[-1] = made[-1].removesuffix(masculine) + feminine
    return " ".join(made)


def formatted(kind: str, surface: str, value: str) -> str:
    """A canonical surrogate in the format of the surface that it replaces."""
    if kind in ("phone", "card", "iban"):
        chars = iter(value)
        return "".join(next(chars, c) if c.isalnum() or c == "+" else c for c in surface) + "".join(chars)
    if kind == "email" and surface != surface.lower():
        return value.upper() if surface.isupper() else "".join(v.upper() if s.isupper() else v for s, v in zip(surface, value, strict=False)) if len(surface) == len(value) else value
    if kind.startswith("name"):
        return value.upper() if surface.isupper() and len(surface) > 1 else " ".join(w[:1].upper() + w[1:] for w in value.split(" "))
    return value


def _document_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct parts of the entities of each document; documents without one give no row."""
    for batch in batches:
        rows = [(d, k, v) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for k, v in sorted({p for _, _, k, v in find(t) for p in parts(k, v)})]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "value"])


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, v, a, key) for k, v, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "surrogate"])

    return run


def attempts(values: DataFrame, key: bytes) -> DataFrame:
    """kind, value and attempt of the values (distinct kind, value) whose first surrogate does not do."""
    schema = "kind string, value string, attempt int, surrogate string"
    made = tx.written(values.withColumn("attempt", F.lit(0)).mapInArrow(_surrogates(key), schema), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        # of values that share a surrogate the one of the fewest attempts and the smallest value keeps it
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
        taken = made.withColumn("place", F.row_number().over(order)).join(values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real")), ["kind", "surrogate"], "left")
        unlike = F.col("surrogate") != F.col("value")  # a domain for examples may stay
        judged = tx.written(taken.select("kind", "value", "attempt", "surrogate", ((F.col("place") > 1) | (F.col("real").isNotNull() & (unlike | (F.col("kind") != "domain")))).alias("bad")), "judged")
        if judged.filter("bad").isEmpty():
            break
        again = judged.filter("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_surrogates(key), schema)
        made = tx.written(judged.filter("not bad").drop("bad").unionByName(again), "surrogates")
    else:
        raise RuntimeError(f"values without a surrogate of their own after {MAX_ATTEMPTS} attempts")
    return made.filter("attempt > 0").select("kind", "value", "attempt")


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("more").to_pylist(), strict=True):
                tried = {(m["kind"], m["value"]): m["attempt"] for m in more or ()}
                out, last, found = [], 0, find(text) if text else []
                for a, b, kind, value in found:
                    # attempts are those of the whole corpus, so a value has one replacement whichever document names it
                    new = known.get((kind, value))
                    if new is None:
                        if len(known) > 100_000:
                            known.clear()
                        new = known[kind, value] = replacement(kind, value, tried, key)
                    out += [text[last:a], formatted(kind, text[a:b], new)]
                    last = b
                texts.append("".join([*out, text[last:]]) if found else text)
                counts.append(len(found))
                kinds.append(sorted({x[2] for x in found}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([",".join(k) for k in kinds], pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "kinds", "text"])

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities, kinds and the text with surrogates in the places of entities."""
    with tx.scratch():
        return tx.written(_pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key), "pseudonymised", keep=True)


def _pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    where = tx.written(docs.mapInArrow(_document_parts, "doc_id long, kind string, value string"), "entities")
    retried = tx.written(attempts(tx.written(where.select("kind", "value").distinct(), "values"), key), "attempts")
    n = retried.count()
    if not n:
        both = docs.withColumn("more", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        hit = tx.written(where.join(F.broadcast(retried) if n <= BROADCAST_ROWS else retried, ["kind", "value"]), "attempts-met")
        small = hit.count() <= BROADCAST_ROWS  # values, however many of them a document has
        hit = tx.written(hit.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("more")), "attempts-by-document")
        both = docs.join(F.broadcast(hit) if small else hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left").select(docs["doc_id"], "text", "more")
    return both.select("doc_id", "text", "more").mapInArrow(_replaced(key), "doc_id long, n_entities long, kinds string, text string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(tx.table(spark, sf_dir, "documents"), OP8_KEY)
