"""Personal data replaced by surrogates of the same kind and form.

Entities are found by patterns, brought to one form (an e-mail address in lower case, the digits of
a number, a name in title case) and replaced by a surrogate derived from a key, the kind and that
form.  So all mentions of an entity change alike in all documents, and a mention's own form (case,
separators, title) is kept.  Surrogates must differ from each other and from every real entity of
the corpus: clashes are looked for in a table of all distinct entities, and all but one of the
clashing entities draw again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import settle, ship
from .common import numbered

KEY = b"surrogates"

# Titles and given names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Г-н", "Господин", "Κύριος")
FEMALE_TITLES = (
    "Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle",
    "Г-жа", "Госпожа", "Κυρία",
)
OPEN_TITLES = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas",
                     "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul", "Rafael", "Simon", "Tomas", "Victor"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia",
                     "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λεωνίδας", "Μάρκος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "bri"),
    "cyrillic": ("ба", "ве", "ги", "до", "жу", "ка", "ле", "ми", "но", "ру", "са", "те", "фи", "хо", "чу", "ша"),
    "greek": ("βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "φα", "χε", "ψι"),
}
SURNAME_END = {
    ("latin", "m"): "n", ("latin", "f"): "n", ("cyrillic", "m"): "в", ("cyrillic", "f"): "ва",
    ("greek", "m"): "ς", ("greek", "f"): "ου",
}

_TITLES = "|".join(re.escape(t) for t in (*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES))
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
#: In order: what an earlier kind has taken is not looked at again.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\dA-Za-z+])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\dA-Za-z])")),
    ("phone", re.compile(r"(?<![\dA-Za-z])\+\d{7,15}(?![\dA-Za-z])")),
    ("name", re.compile(rf"\b(?:{_TITLES})\.? +({_NAME}(?: {_NAME})?)")),
)
_NEEDS_AT, _NEEDS_DIGIT = {"email"}, {"iban", "ip", "card", "ssn", "phone"}
_DIGIT = re.compile(r"\d")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities; gender is m, f or empty."""
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))  # one mark per character, so a long text costs no more per match
    at, digit = "@" in text, _DIGIT.search(text) is not None
    for kind, pattern in PATTERNS:
        if (kind in _NEEDS_AT and not at) or (kind in _NEEDS_DIGIT and not digit):
            continue
        for match in pattern.finditer(text):
            start, end = match.span(1 if kind == "name" else 0)
            if taken.find(1, start, end) >= 0:
                continue
            gender = ""
            if kind == "name":
                title = match[0].split()[0].rstrip(".")
                gender = "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else ""
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind, gender))
    return sorted(out)


def _script(text: str) -> str:
    for char in text:
        if "Ѐ" <= char <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= char <= "Ͽ":
            return "greek"
    return "latin"


def canonical(kind: str, mention: str, gender: str) -> str:
    """One form for all mentions of an entity."""
    if kind == "email":
        return mention.lower()
    if kind == "ip":
        return mention
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "name":
        return f"{gender}:{' '.join(w.capitalize() for w in mention.split())}"
    return "".join(c for c in mention if c.isdigit())


class _Draw:
    """A stream of numbers below a bound, from a key and a text."""

    def __init__(self, key: bytes, text: str):
        self.key, self.text, self.turn, self.pool = key, text.encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            block = hmac.new(self.key, b"%d|%s" % (self.turn, self.text), hashlib.sha256).digest()
            self.turn += 1
            self.pool, self.left = int.from_bytes(block, "big"), 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def like(self, text: str) -> str:
        """Characters of the same class: digits, letters by case; others stay."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate(kind: str, form: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Surrogate of an entity's canonical form, in canonical form."""
    draw = _Draw(key, f"{attempt}|{kind}|{form}")
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        # the reserved ending keeps surrogates from being anyone's address
        return f"{draw.like(local)}@{draw.like(domain.rsplit('.', 1)[0])}.example"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "iban":
        body = draw.like(form[4:])
        number = int("".join(str(int(c, 36)) for c in body + form[:2] + "00"))
        return f"{form[:2]}{98 - number % 97:02d}{body}"
    if kind == "card":
        body = draw.like(form[:-1])
        valid = (10 - _luhn(body + "0")) % 10
        if _luhn(form):  # no valid number before, none after
            valid = (valid + 1 + draw.below(9)) % 10
        return f"{body}{valid}"
    if kind == "name":
        gender, name = form.split(":", 1)
        script, words = _script(name), name.split()
        gender = gender or "mf"[draw.below(2)]
        out = []
        if len(words) > 1:
            given = GIVEN[script, gender]
            out.append(given[draw.below(len(given))])
        parts = SYLLABLES[script]
        out.append("".join(parts[draw.below(len(parts))] for _ in range(4)).capitalize() + SURNAME_END[script, gender])
        return " ".join(out)
    if kind == "phone":
        keep = 1 if len(form) > 10 else 0  # a leading country digit
        return form[:keep] + draw.like(form[keep:])
    return draw.like(form)


def render(kind: str, mention: str, form: str) -> str:
    """The surrogate ``form`` in the shape of the mention."""
    if kind in ("email", "name"):
        letters = [c for c in mention if c.isalpha()]
        return form.upper() if letters and all(c.isupper() for c in letters) and len(letters) > 1 else form
    if kind == "ip":
        return form
    source = iter(form)
    same = str.isdigit if kind != "iban" else str.isalnum
    return "".join(next(source) if same(c) else c for c in mention)


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, dict[str, int]]:
    """Text with surrogates, and the number of mentions by kind."""
    out, begin, counts = [], 0, {}
    for start, end, kind, gender in find(text):
        mention = text[start:end]
        form = canonical(kind, mention, gender)
        out += [text[begin:start], render(kind, mention, surrogate(kind, form, attempts.get((kind, form), 0), key))]
        begin = end
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[begin:]]), counts


KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "name")


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, form) over all texts, reduced within each batch before they are shuffled."""
    ship(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                (kind, canonical(kind, text[a:b], gender))
                for text in batch.column(0).to_pylist() if text
                for a, b, kind, gender in find(text)
            }
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "form"]
            )

    return docs.select(text_col).mapInArrow(look, "kind string, form string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, forms, attempts = (c.to_pylist() for c in batch.columns)
            got = [surrogate(*x, key) for x in zip(kinds, forms, attempts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got, pa.string())], names=["kind", "form", "attempt", "stand_in"]
            )

    return rows.select("kind", "form", "attempt").mapInArrow(
        draw, "kind string, form string, attempt int, stand_in string"
    )


def settled_attempts(
    found: DataFrame, key: bytes = KEY, max_rounds: int = 50,
    draw: Callable[[DataFrame, bytes], DataFrame] = _drawn,
) -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate clashed.

    A surrogate clashes if it equals a real entity of its kind or the surrogate of an entity with a
    smaller form.  Names clash on the name alone, whatever the gender.
    """
    found = settle(found.withColumn("attempt", F.lit(0)))
    plain = F.when(F.col("kind") == "name", F.substring_index("form", ":", -1)).otherwise(F.col("form"))
    real = found.select("kind", plain.alias("stand_in"), F.lit(True).alias("_real")).distinct()
    state = settle(draw(found, key))
    for _ in range(max_rounds):
        owner = state.groupBy("kind", "stand_in").agg(F.min("form").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        bad = owner.join(real, ["kind", "stand_in"], "left").where("_n > 1 OR _real")
        losers = settle(
            state.join(bad, ["kind", "stand_in"]).where("_real OR form != _owner")
            .select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        )
        if losers.isEmpty():
            return state.where("attempt > 0").select("kind", "form", "attempt")
        again = draw(losers, key)
        state = settle(state.join(losers, ["kind", "form"], "left_anti").unionByName(again))
    raise RuntimeError(f"surrogates still clash after {max_rounds} rounds")


def replace_entities(
    docs: DataFrame, key: bytes = KEY, text_col: str = "text", counts: bool = False
) -> DataFrame:
    """All rows and columns with surrogates in the text; null and empty texts stay.

    With ``counts`` a column ``n_<kind>`` follows for each kind.
    """
    again = settled_attempts(entities(docs, text_col), key)
    at, n = docs.columns.index(text_col), len(docs.columns)
    rows = numbered(docs)
    extra = not again.isEmpty()
    if extra:
        rows = _with_attempts(rows, again, f"c{at}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(n).to_pylist() if extra else [None] * batch.num_rows
            texts, found = [], []
            for text, listed in zip(batch.column(at).to_pylist(), known):
                attempts = {(a["kind"], a["form"]): a["attempt"] for a in listed or ()}
                new, by_kind = replace(text, attempts, key) if text else (text, {})
                texts.append(new)
                found.append(by_kind)
            columns = [*batch.columns[:n]]
            columns[at] = pa.array(texts, columns[at].type)
            if counts:
                columns += [pa.array([f.get(k, 0) for f in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    fields = [T.StructField(f.name, f.dataType) for f in rows.schema[:n]]
    names = [f"n_{k}" for k in KINDS] if counts else []
    fields += [T.StructField(k, T.LongType()) for k in names]
    return rows.mapInArrow(write, T.StructType(fields)).toDF(*docs.columns, *names)


def _with_attempts(docs: DataFrame, again: DataFrame, text_col: str) -> DataFrame:
    """Each row with the clashing entities that it mentions as last column (rows meet by text)."""
    text = F.col(text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (hash_, other, kind, form)
                for hash_, other, text in zip(*(c.to_pylist() for c in batch.columns)) if text
                for kind, form in {(k, canonical(k, text[a:b], g)) for a, b, k, g in find(text)}
            ]
            types = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                names=["_text1", "_text2", "kind", "form"],
            )

    mentions = docs.select(F.xxhash64(text), F.hash(text), text).mapInArrow(
        look, "_text1 long, _text2 int, kind string, form string"
    )
    listed = (
        mentions.join(again, ["kind", "form"]).groupBy("_text1", "_text2")
        .agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("_attempts"))
    )
    return (
        docs.withColumns({"_text1": F.xxhash64(text), "_text2": F.hash(text)})
        .join(listed, ["_text1", "_text2"], "left")
        .select(*[F.col(f"`{c}`") for c in docs.columns], "_attempts")
    )
