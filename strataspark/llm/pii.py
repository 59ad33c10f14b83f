"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Detected entities are reduced to a canonical form (digits of numbers, folded case of names and
addresses). A surrogate is drawn from that form by a keyed hash: same length, separators, script
and case, given names of the same gender, check digits where the original has valid ones. One
canonical form gets one surrogate everywhere.

Names are found after titles. A name's form is the name alone, whatever the title; its surrogate keeps
the surrogate of the last word, which all who share that word share, so "Mr John Smith", "Dr John
Smith" and "Mr Smith" stay one family; its gender is the given name's where known, else that of most
titles it has in all documents, else drawn. Where a document has a name after a title, the bare full
name and the bare last word, spelt as there, are replaced as well.

Over the distinct entities of all documents, draws that meet another entity's surrogate or an entity
of the corpus are drawn again, up to ``TRIES`` times from spaces that grow where the format allows; in
formats with more entities than that leaves room for, the rest exchange their forms among themselves,
so all end up distinct and none keeps its own. Only entities whose surrogate doesn't follow from key and
form alone (few, but for genders of titles) need to be told to the workers.

Null texts stay null and empty ones empty. Rows that repeat, of one id or several, are replaced alike. Other
columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

#: Surrogates to be told are broadcast up to this number; beyond, each document is joined with its own.
BROADCAST_TOLD = 200_000
#: Draws of an entity, and those after which its space grows.
TRIES, GROWS = 24, 6

# Honorifics by gender, and the names surrogates are made of by script and gender.
_TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"),
    "n": ("Dr", "Prof"),
}
_GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carlos Daniel Emil Felix Gabriel Hugo Ivan Jonas Karl Leon Marco Niklas Oscar Pablo Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Anna Beatriz Carla Diana Elena Emma Flora Greta Helena Ines Julia Klara Laura Maria Nina Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Светлана".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da del den do fa fer fi ga gel gor ha hel ho ka kel kor la len lo ma mer mo na nel no pa per po ra ren ro sa sel so ta ten to va vel vo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
}

_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
_GIVEN_GENDER = {name.casefold(): gender for (_, gender), names in _GIVEN.items() for name in names}
_NAME = r"\p{Lu}[\p{L}\p{M}'’]*[\p{L}\p{M}]"
_PATTERNS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"'](?P<name>[^\s\"']{8,}+)[\"']")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])")),
    ("name", regex.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? (?P<name>{_NAME}(?:[ -]{_NAME}){{0,2}})(?!\w)")),
)
#: What a text must hold to be looked at closely.
_LIKELY = "[0-9@]|(?i:token|secret|passw|api[_-]?key)|" + "|".join(sorted(_GENDER))


_WORD = regex.compile(rf"(?<!\w){_NAME}(?!\w)")


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender of its title), in order and without overlaps; earlier patterns win."""
    found: list[tuple[int, int, str, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            s, e = m.span("name") if "name" in pattern.groupindex else m.span()
            if any(taken[s:e]):
                continue
            taken[s:e] = b"\1" * (e - s)
            raw, gender = text[s:e], "n"
            if kind in ("card", "ssn", "phone"):
                form = re.sub(r"[^0-9]", "", raw)
            elif kind == "iban":
                form = raw.replace(" ", "")
            elif kind == "name":
                form, gender = raw.casefold(), _GENDER[m["title"]]
            else:
                form = raw.lower()
            found.append((s, e, kind, form, gender))
    named = {text[s:e] for s, e, kind, _, _ in found if kind == "name"}
    if named:
        found += _bare(text, named, taken)
    return sorted(found)


def _bare(text: str, named: set[str], taken: bytearray) -> list[tuple[int, int, str, str, str]]:
    """Other mentions of names and of their last words, longest first."""
    known: dict[str, list[str]] = {}
    for name in named | {last_word(name) for name in named}:
        known.setdefault(_WORD.match(name)[0], []).append(name)
    for names in known.values():
        names.sort(key=len, reverse=True)
    found = []
    for m in _WORD.finditer(text):
        s = m.start()
        for name in known.get(m[0], ()):
            e = s + len(name)
            if text.startswith(name, s) and not text[e : e + 1].isalnum() and not any(taken[s:e]):
                taken[s:e] = b"\1" * (e - s)
                found.append((s, e, "name", name.casefold(), "n"))
                break
    return found


def last_word(name: str) -> str:
    return re.split("[ -]", name)[-1]


class _Draws:
    """Numbers from a keyed hash in counter mode."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.key, self.seed = key, f"{kind}\0{form}\0{attempt}".encode()
        self.pool, self.counter = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.counter.to_bytes(4, "big"), key=self.key).digest()
            self.counter += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _script(form: str) -> str:
    return "cyrillic" if re.search("[а-яё]", form) else "latin"


def _spoken(d: _Draws, script: str, syllables: int) -> str:
    own = _SYLLABLES[script]
    return "".join(own[d.below(len(own))] for _ in range(syllables))


def full_name(key: bytes, form: str, gender: str, last: str, attempt: int = 0) -> str:
    """The replacement of a name of several words whose last one becomes ``last``."""
    d, script = _Draws(key, "name", form, attempt), _script(form)
    parts = re.split(r"([ -])", form)
    gender = _GIVEN_GENDER.get(parts[0], gender)
    if gender not in ("m", "f"):
        gender = "mf"[_Draws(key, "gender", parts[0], 0).below(2)]
    given = _GIVEN[script, gender]
    for i in range(0, len(parts) - 1, 2):
        name = given[d.below(len(given))].casefold()
        # there are few given names: later draws make longer ones that end alike
        parts[i] = name if attempt < 2 else _spoken(d, script, 1 + attempt // GROWS) + name
    return "".join([*parts[:-1], last])


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """The canonical form of the replacement for ``form``, not a name of several words; ``attempt`` counts redraws."""
    d, grown = _Draws(key, kind, form, attempt), attempt // GROWS
    if kind == "surname":
        return _spoken(d, _script(form), 2 + d.below(2) + grown)
    if kind == "ip":
        own = form.split(".")
        # a private address stays one; its range grows to the widest private one, then to the reserved one
        head = [own[:2], ["10"], [], []][grown] if own[:2] == ["192", "168"] else [own[:1], own[:1], [], []][grown] if own[0] in ("10", "127") else []
        first = [str(240 + d.below(15))] if own[0] in ("10", "127", "192") and grown >= 2 else [str(1 + d.below(223))]
        head = head or first
        return ".".join(head + [str(1 + d.below(254)) for _ in range(4 - len(head))])
    if kind == "secret" and not form.strip("0123456789abcdef"):
        return "".join("0123456789abcdef"[d.below(16)] for _ in form)
    if kind in ("email", "secret"):
        form = "a" * grown + form
    keep = {"phone": max(len(form) - 10, 0), "card": 1, "iban": 2}.get(kind, 0)
    end = len(form) - len(form.rpartition(".")[2]) if kind == "email" else len(form)
    out = []
    for i, c in enumerate(form):
        if i < keep or i >= end:
            out.append(c)
        elif c.isdigit():
            out.append(str(1 + d.below(9) if i == keep else d.below(10)))
        elif c.isalpha():
            letter = "abcdefghijklmnopqrstuvwxyz"[d.below(26)]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    text = "".join(out)
    if kind == "card" and luhn(form):
        text = next(t for t in (text[:-1] + x for x in "0123456789") if luhn(t))
    return text


def render(kind: str, raw: str, form: str) -> str:
    """``form`` with the separators and the case of ``raw``."""
    if kind == "name":
        return re.sub(r"[^ -]+", lambda m: m[0][:1].upper() + m[0][1:], form)
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(form)
        return "".join(next(left) if c.isalnum() else c for c in raw)
    if raw.isupper() or len(form) != len(raw):
        return form.upper() if raw.isupper() else form
    return "".join(f.upper() if r.isupper() else f for f, r in zip(form, raw, strict=True))


def drawn_for(key: bytes, kind: str, form: str, told: dict[tuple[str, str], str]) -> str:
    """The surrogate of an entity as ``detect`` gives it: told, or following from key and form."""
    if kind != "name":
        return told.get((kind, form)) or surrogate(key, kind, form)
    last = last_word(form)
    after = told.get(("surname", last)) or surrogate(key, "surname", last)
    if last == form:
        return after
    return told.get(("name", form)) or full_name(key, form, "n", after)


def replace(text: str, key: bytes, told: dict[tuple[str, str], str]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    parts, at, found = [], 0, detect(text)
    for s, e, kind, form, _ in found:
        parts += [text[at:s], render(kind, text[s:e], drawn_for(key, kind, form, told))]
        at = e
    return "".join([*parts, text[at:]]), len(found)


def _likely(column) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(column, _LIKELY), False).to_pylist()


def _entities(batches) -> Iterator[pa.RecordBatch]:
    """(fp, kind, form, gender) of each text's entities; names also as their last words, as which they may stand alone."""
    for batch in batches:
        found: set[tuple[int, str, str, str]] = set()
        column = batch.column("text")
        for i, likely in enumerate(_likely(column)):
            if likely:
                for _, _, kind, form, gender in detect(column[i].as_py()):
                    last = last_word(form) if kind == "name" else form
                    if last == form:
                        found.add((i, "surname" if kind == "name" else kind, form, "n"))
                    else:
                        found |= {(i, "name", form, gender), (i, "surname", last, "n")}
        if found:
            rows, *columns = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("fp").take(pa.array(rows)), *map(pa.array, columns)], names=["fp", "kind", "form", "gender"])


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "gender", "last", "attempt")), strict=True)
            drawn = [full_name(key, f, g, last, n) if k == "name" else surrogate(key, k, f, n) for k, f, g, last, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=[*batch.schema.names, "drawn"])

    return run


def assign(entities: DataFrame, key: bytes, ws: Workspace) -> DataFrame:
    """(kind, form, told, drawn): distinct surrogates of ``entities(kind, form, gender, last)``, none of which is an entity itself.

    ``told`` says that the surrogate doesn't follow from key and form. At most ``TRIES`` rounds.
    """
    schema = "kind string, form string, gender string, last string, attempt int, drawn string"
    todo = entities.select("kind", "form", "gender", "last", F.lit(0).alias("attempt"))
    known = entities.select("kind", F.col("form").alias("drawn"))
    done = None
    for _ in range(TRIES):
        drawn = ws.table(todo.select("kind", "form", "gender", "last", "attempt").mapInArrow(_drawn(key), schema), "drawn")
        fresh = drawn.join(known, ["kind", "drawn"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        winners = fresh.groupBy("kind", "drawn").agg(F.min("form").alias("form"))
        told = (F.col("attempt") > 0) | (F.col("kind") == "name")
        won = ws.table(fresh.join(winners, ["kind", "drawn", "form"], "left_semi").select("kind", "form", told.alias("told"), "drawn"), "won")
        done = won if done is None else done.unionByName(won)
        todo = ws.table(drawn.join(won, ["kind", "form"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "again")
        if todo.isEmpty():
            return done
    return _exchanged(done, todo, ws)


def _exchanged(done: DataFrame, rest: DataFrame, ws: Workspace) -> DataFrame:
    """``done`` and ``rest``, whose format has no room left: each takes the form of the next of its format.

    No surrogate in ``done`` is an entity's form, so these stay distinct. One of ``done`` joins each
    format's rest, for where that is a single one. What is sorted is at most the rest of one format.
    """
    size = F.length("form").alias("size")
    shapes = rest.select("kind", size).distinct()
    helper = done.select("kind", size, "form").join(shapes, ["kind", "size"]).groupBy("kind", "size").agg(F.min("form").alias("form"))
    ring = ws.table(rest.select("kind", size, "form").unionByName(helper), "ring")
    order = Window.partitionBy("kind", "size").orderBy(F.xxhash64("form"), "form")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("form").over(order), F.first("form").over(around))
    swapped = ws.table(ring.select("kind", "form", F.lit(True).alias("told"), after.alias("drawn")), "swapped")
    return done.join(swapped, ["kind", "form"], "left_anti").unionByName(swapped)


def _replaced(key: bytes, told):
    def run(batches):
        shared = dict(told.value) if told is not None else {}
        for batch in batches:
            column = batch.column("text")
            own = batch.column("told").to_pylist() if told is None else None
            texts, counts = column.to_pylist(), [0] * batch.num_rows
            for i, likely in enumerate(_likely(column)):
                if likely:
                    known = shared if own is None else {(r["kind"], r["form"]): r["drawn"] for r in own[i] or ()}
                    texts[i], counts[i] = replace(texts[i], key, known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_entities"])

    return run


def surrogates(entities: DataFrame, key: bytes, ws: Workspace) -> DataFrame:
    """(kind, form, told, drawn) for all distinct entities of ``entities(kind, form, gender)``."""
    lean = F.count_if(F.col("gender") == "m") - F.count_if(F.col("gender") == "f")
    gender = F.when(lean > 0, "m").when(lean < 0, "f").otherwise("n")
    each = ws.table(entities.groupBy("kind", "form").agg(gender.alias("gender")), "entities")
    simple = assign(each.where("kind <> 'name'").withColumn("last", F.lit(None).cast("string")), key, ws)
    last = simple.where("kind = 'surname'").select(F.col("form").alias("_last"), F.col("drawn").alias("last"))
    names = each.where("kind = 'name'").withColumn("_last", F.element_at(F.split("form", "[ -]"), -1))
    return simple.unionByName(assign(ws.table(names.join(last, "_last").drop("_last"), "names"), key, ws))


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities): each row of ``docs`` with its entities replaced. Null texts stay null."""
    ws = Workspace(docs.sparkSession, "pii")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    found = ws.table(own.select("fp", "text").mapInArrow(_entities, "fp long, kind string, form string, gender string"), "found")
    told = ws.table(surrogates(found, key, ws).where("told").select("kind", "form", "drawn"), "told")
    schema = "doc_id long, text string, n_entities long"
    if told.count() <= BROADCAST_TOLD:
        shared = docs.sparkSession.sparkContext.broadcast([((r["kind"], r["form"]), r["drawn"]) for r in told.toLocalIterator()])
        return own.select("doc_id", "text").mapInArrow(_replaced(key, shared), schema)
    each = found.select("fp", "kind", "form").distinct().join(told, ["kind", "form"]).groupBy("fp").agg(F.collect_list(F.struct("kind", "form", "drawn")).alias("told"))
    return own.join(each, "fp", "left").select("doc_id", "text", "told").mapInArrow(_replaced(key, None), schema)
