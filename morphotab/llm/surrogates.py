"""Surrogates for personal data: keyed, type-consistent replacements with collision checks.

Found are e-mail addresses, IPv4 addresses, phone and card numbers, IBANs, social security numbers, access keys, quoted
or assigned secrets, and names after a form of address, which also gives the gender. A value is replaced by a keyed
permutation of its characters within its format (digits stay digits, cases stay, check digits and leading parts that
name a country, an issuer or a top-level domain hold), names by names of the same gender and script. Equal values
get equal surrogates in all documents; parts of a name are replaced alike wherever they stand in its document.

Distinct values are gathered once. A surrogate that equals any found value of its kind, or that another value has
too, is drawn again with a higher attempt until none collides. After WIDER attempts a format counts as used up, and each further one
adds a digit to it (IPv4 addresses give up the lengths of their numbers first), so there are more surrogates than values after
as many attempts more as their number has digits; only values with an attempt above 0 are joined back to the
documents that hold them, all other surrogates are computed where the text is read.

Null texts stay null and empty ones empty. Rows with equal doc_id are handled each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

WIDER = 6  # attempts within a value's own format
KEY = b"surrogate-key"  # of the registered query; a real run gives its own secret

# Forms of address by gender, and names by script and gender.
MALE_FORMS = "Mr Sir Herr Monsieur Señor Sr Г-н Κύριος".split()
FEMALE_FORMS = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Sra Г-жа Κυρία".split()
OTHER_FORMS = "Dr Prof Professor Doctor".split()
NAMES = {
    "latin": {
        "m": "Adam Albert Anton Bruno Carlos Daniel David Emil Felix George Hugo Jakob James Johan Julian Leon Louis Martin Oscar Paul Peter Simon Thomas Victor".split(),
        "f": "Alice Amelia Anna Carla Clara Diana Elena Emma Eva Hannah Helena Irene Julia Laura Lena Louise Lucia Maria Marta Nina Nora Olivia Sara Sofia".split(),
        "s": "Adler Bauer Becker Bennett Carter Costa Dubois Evans Fischer Garcia Hansen Jensen Keller Lambert Lopez Martin Meyer Moreau Novak Parker Rossi Santos Silva Weber".split(),
        "end": "a e i o an el in on ar er is us".split(),
    },
    "cyrillic": {"m": "Антон Борис Виктор Иван Максим Павел".split(), "f": "Анна Вера Елена Ирина Мария Ольга".split(), "s": "Волков Зайцев Лебедев Морозов Орлов Соколов".split(), "end": "а о е и ан ин".split()},
    "greek": {"m": "Άγγελος Γιώργος Νίκος Πέτρος".split(), "f": "Άννα Ελένη Μαρία Σοφία".split(), "s": "Γεωργίου Δήμου Λάμπρου Παππάς".split(), "end": "α ο η ι".split()},
}

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_FORMS = "|".join(sorted(map(re.escape, MALE_FORMS + FEMALE_FORMS + OTHER_FORMS), key=len, reverse=True))
NAMED = re.compile(rf"\b({_FORMS})\.?[  ]({_NAME}(?: {_NAME}){{0,2}})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> pattern whose group 1 (or the whole) is the value; earlier kinds win where matches overlap
PATTERNS = {
    "key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}|(?<![A-Za-z0-9])sk[-_][A-Za-z0-9_-]{20,}"),
    "secret": re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?(?=[^\s\"',;]*\d)([^\s\"',;]{6,})"),
    "email": re.compile(r"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
}
_DIGIT = re.compile(r"\d")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def _name_parts(text: str) -> list[Span]:
    """Names after forms of address, and their parts wherever they stand in the text.

    A part is of one kind in the whole text: a given name if any mention has it before another part, of the gender that
    some form of address tells, and a surname otherwise.
    """
    mentions: list[tuple[int, str]] = []
    given: dict[str, str] = {}
    for m in NAMED.finditer(text):
        form, parts, at = m[1], m[2].split(" "), m.start(2)
        gender = "m" if form in MALE_FORMS else "f" if form in FEMALE_FORMS else "n"
        while parts and not parts[-1][0].isupper():
            parts.pop()
        for k, part in enumerate(parts):
            if part[0].isupper():
                mentions.append((at, part))
                if k < len(parts) - 1 and given.get(part.capitalize(), "n") == "n":
                    given[part.capitalize()] = gender
            at += len(part) + 1
    kind = lambda part: f"given-{given[part.capitalize()]}" if part.capitalize() in given else "surname"
    out = {at: Span(at, at + len(part), kind(part), part) for at, part in mentions}
    if known := {part for _, part in mentions}:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, known), key=len, reverse=True))})(?!\w)", text):
            out.setdefault(m.start(), Span(m.start(), m.end(), kind(m[0]), m[0]))
    return list(out.values())


def find(text: str) -> list[Span]:
    """Entities of a text in order, without overlaps."""
    found: list[Span] = []
    kinds = [k for k in PATTERNS if k != "email" or "@" in text] if _DIGIT.search(text) else ["email"] * ("@" in text) + ["key"] * ("AKIA" in text or "ASIA" in text)
    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            at, end = m.span(m.lastindex or 0)
            found.append(Span(at, end, kind, text[at:end]))
    found += _name_parts(text)
    rank = {k: i for i, k in enumerate(PATTERNS)}
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s.start, rank.get(s.kind, 99), -s.end)):
        if not out or s.start >= out[-1].end:
            out.append(s)
        elif rank.get(s.kind, 99) < rank.get(out[-1].kind, 99):
            out[-1] = s
    return out


def canonical(kind: str, value: str) -> str:
    """What decides whether two mentions are the same entity."""
    return value.lower() if kind == "email" else value.capitalize() if kind.startswith(("given", "surname")) else value


def permuted(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the symbol lists with these radices: ten rounds that add a hash of one half to the other."""
    x, half = list(symbols), (len(symbols) + 1) // 2
    for turn in range(10):
        own, other = (range(half), x[half:]) if turn % 2 == 0 else (range(half, len(x)), x[:half])
        stream = hashlib.shake_128(key + f"|{tweak}|{turn}|{other}".encode()).digest(4 * len(own)) if own else b""
        for j, i in enumerate(own):
            x[i] = (x[i] + int.from_bytes(stream[4 * j : 4 * j + 4], "little")) % radices[i]
    return x


def _in_format(value: str, key: bytes, tweak: str, fixed: int = 0, hexadecimal: bool = False) -> str:
    """Letters and digits behind the first `fixed` characters, permuted within their classes."""
    alphabets = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x": "0123456789abcdef"}
    hexadecimal = hexadecimal and all(c in alphabets["x"] for c in value) and any(c.isalpha() for c in value)
    kinds = ["" if i < fixed else "x" if hexadecimal else "d" if c in alphabets["d"] else "l" if c in alphabets["l"] else "u" if c in alphabets["u"] else "" for i, c in enumerate(value)]
    at = [i for i, k in enumerate(kinds) if k]
    shape = value[:fixed] + "".join(k or c for k, c in zip(kinds[fixed:], value[fixed:], strict=True))
    new = permuted([alphabets[kinds[i]].index(value[i]) for i in at], [len(alphabets[kinds[i]]) for i in at], key, f"{tweak}|{shape}")
    out = list(value)
    for i, s in zip(at, new, strict=True):
        out[i] = alphabets[kinds[i]][s]
    return "".join(out)


def _luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", word) else "latin" if re.search("[A-Za-zÀ-ɏ]", word) else "other"


def _name(kind: str, value: str, key: bytes, attempt: int) -> str:
    draw = int.from_bytes(hashlib.blake2b(f"{kind}|{value}|{attempt}".encode(), key=key[:64], digest_size=8).digest(), "little")
    script = _script(value)
    if script == "other":  # letters of the same block of 64 code points
        return "".join(chr(ord(c) - ord(c) % 64 + (ord(c) + 1 + (draw >> (i % 50))) % 64) for i, c in enumerate(value))
    pool = NAMES[script]
    names = pool["s"] if kind == "surname" else pool[kind[-1]] if kind[-1] in "mf" else pool["m"] + pool["f"]
    out, draw = names[draw % len(names)], draw // len(names)
    for _ in range((attempt + 2) // 3):  # more names than the pool has: longer ones
        out, draw = out + pool["end"][draw % len(pool["end"])], draw // len(pool["end"])
    return out


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The surrogate of a canonical value."""
    tweak = f"{kind}|{attempt}"
    if kind.startswith(("given", "surname")):
        return _name(kind, value, key, attempt)
    extra = max(0, attempt - WIDER + 1)  # the format is used up: a wider one
    if kind == "ip" and 0 < extra <= WIDER:
        return ".".join(map(str, permuted(list(map(int, value.split("."))), [256] * 4, key, tweak)))
    if kind == "email":
        value = value.replace("@", "0" * extra + "@", 1)
    elif kind != "ip":
        value += "0" * extra
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        labels[:-1] = [_in_format(x, key, f"domain|{attempt}|{i}") for i, x in enumerate(labels[:-1])]
        return f"{_in_format(local, key, tweak)}@{'.'.join(labels)}"
    if kind == "ip":
        parts = value.split(".")
        low = [0 if len(p) == 1 else 10 if len(p) == 2 else 100 for p in parts]
        wide = [10 if len(p) == 1 else 90 if len(p) == 2 else 156 for p in parts]
        new = permuted([int(p) - x for p, x in zip(parts, low, strict=True)], wide, key, f"{tweak}|{wide}")
        return ".".join(str(n + x) for n, x in zip(new, low, strict=True)) + "0" * max(0, extra - WIDER)
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if int(digits[-1]) == _luhn(digits[:-1]):
            body = _in_format(digits[:-1], key, f"{tweak}|luhn", 1)
            new = iter(body + str(_luhn(body)))
            return "".join(next(new) if c.isdigit() else c for c in value)
        return _in_format(value, key, tweak, 1)
    if kind == "iban":
        body = _in_format(value[4:], key, tweak)
        plain = "".join(str(int(c, 36)) for c in body.replace(" ", "") + value[:2] + "00")
        return f"{value[:2]}{98 - int(plain) % 97:02d}{body}"
    if kind == "phone":
        return _in_format(value, key, tweak, len(re.match(r"\+?\d*", value)[0]) if value[0] == "+" else 0)
    return _in_format(value, key, tweak, 4 if kind == "key" else 0, hexadecimal=kind == "secret")


def dressed(new: str, old: str) -> str:
    """The surrogate in the letter case of the mention."""
    if len(new) == len(old):
        return "".join(n.upper() if o.isupper() and n.islower() else n for n, o in zip(new, old, strict=True))
    return new.upper() if old.isupper() and len(old) > 1 else new.lower() if old.islower() else new


def replaced(text: str, spans: list[Span], key: bytes, special: dict[tuple[str, str], str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, end) of each in it."""
    out, at, size, places = [], 0, 0, []
    for s in spans:
        value = canonical(s.kind, s.value)
        new = special.get((s.kind, value)) or surrogate(s.kind, value, key)
        if s.kind == "email" or s.kind.startswith(("given", "surname")):
            new = dressed(new, s.value)
        out += [text[at : s.start], new]
        start = size + s.start - at
        places.append((s.kind, start, start + len(new)))
        at, size = s.end, start + len(new)
    return "".join([*out, text[at:]]), places


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, value: the distinct canonical values of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            ids, kinds, values = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind, value in {(s.kind, canonical(s.kind, s.value)) for s in find(text)}:
                    ids.append(doc_id), kinds.append(kind), values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["doc_id", "kind", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, value string")


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), batch.column("attempt").to_pylist(), strict=True)
            yield batch.append_column("surrogate", pa.array([surrogate(k, v, key, n) for k, v, n in rows], pa.string()))

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def resolved(values: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, attempt, surrogate of distinct values such that no surrogate is another's or a found value."""
    kind = F.regexp_replace("kind", "^given-.", "name")  # given names of either gender must differ from one another too
    state = T.stored(_drawn(values.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        group = state.select(kind.alias("group"), "*")
        taken = group.select("group", F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        first = group.groupBy("group", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        judged = group.join(first, ["group", "surrogate"]).join(taken, ["group", "surrogate"], "left")
        clash = F.col("real").isNotNull() | (F.struct("kind", "value") != F.col("first"))
        judged = T.stored(judged.select("kind", "value", "attempt", "surrogate", clash.alias("clash")), "judged")
        if judged.where("clash").isEmpty():
            return state
        again = _drawn(judged.where("clash").withColumn("attempt", F.col("attempt") + 1), key)
        state = T.stored(judged.where("NOT clash").drop("clash").union(again), "surrogates")


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (kind, start, end), and `row`: the other columns of docs as a struct."""
    found = T.stored(entities(docs), "entities")
    special = resolved(found.select("kind", "value"), key).where("attempt > 0")
    own = found.join(special, ["kind", "value"]).groupBy(F.col("doc_id").alias("of"))
    own = T.stored(own.agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("special")), "special")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")).join(own, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    fields = f"doc_id long, text string, n_entities int, entities array<struct<kind:string,start:int,end:int>>, row {joined.schema['row'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, places = [], [], []
            for text, special in zip(batch.column("text").to_pylist(), batch.column("special").to_pylist(), strict=True):
                spans = find(text or "")
                other = {(s["kind"], s["value"]): s["surrogate"] for s in special or ()}
                new, where = replaced(text, spans, key, other) if spans else (text, [])
                texts.append(new), counts.append(len(spans)), places.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(places, kind), batch.column("row")], ["doc_id", "text", "n_entities", "entities", "row"])

    return joined.mapInArrow(run, fields)


def private(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The rows of `docs` with surrogates in their texts; `n_chars`, if there, follows the text."""
    out = pseudonymised(docs, key)
    columns = []
    for c, kind in docs.dtypes:
        if c in ("doc_id", "text"):
            columns.append(F.col(c).cast(kind).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return out.select(*columns)
