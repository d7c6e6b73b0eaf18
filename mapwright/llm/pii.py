"""Surrogates for personal data.

Entities found in a text are replaced by made-up ones of the same type and format: digits by digits, letters by
letters of the same case, a given name by one of the same gender and script, a card number that passes the check-digit
test by one that passes it. A surrogate is a keyed hash of the entity's canonical form, so an entity has the same one
everywhere, however it is written. All distinct entities are checked together: two that would get the same surrogate,
or one that would get a real entity of the corpus, are hashed again until all differ. Only these few exceptions are
carried to the texts; everything else is computed where the text is.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.storage import discard, materialize

from .words import blocks, inner_id, mapped, outer_id

#: So many exceptions are broadcast; with more, they are joined to the documents that mention them.
BROADCAST_EXCEPTIONS = 100_000
#: After so many tries a surrogate may be longer than the entity (where its kind has no fixed length), after so many
#: it may be some real entity of the corpus (numbers of a fixed length), and after so many any number may be longer.
LONGER, REAL, LONGER_NUMBER = 8, 24, 64

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Alice", "Amelia", "Ana", "Andrea", "Anna", "Antonia", "Barbara", "Beatriz", "Carmen", "Caroline", "Catherine", "Charlotte", "Claire", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Florence",
        "Greta", "Hannah", "Helena", "Ingrid", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lucia", "Margaret", "Maria", "Monika", "Nadia", "Nancy", "Olivia", "Patricia",
        "Petra", "Rebecca", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Victoria", "Yvonne",
    ),
    ("latin", "m"): (
        "Adrian", "Alexander", "Andreas", "Anthony", "Antonio", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Diego", "Edward", "Emilio", "Felix", "Fernando", "Francisco", "Georg",
        "George", "Henri", "Henry", "Jakob", "James", "Javier", "John", "Jonas", "Joseph", "Karl", "Kenneth", "Klaus", "Louis", "Lukas", "Manuel", "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Oliver",
        "Pablo", "Patrick", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William", "Wolfgang",
    ),
    ("cyrillic", "f"): ("Александра", "Анастасия", "Анна", "Вера", "Дарья", "Екатерина", "Елена", "Ирина", "Ксения", "Мария", "Наталья", "Ольга", "Полина", "Светлана", "Татьяна", "Юлия"),
    ("cyrillic", "m"): ("Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Константин", "Максим", "Михаил", "Николай", "Олег", "Павел", "Сергей", "Юрий"),
    ("greek", "f"): ("Αικατερίνη", "Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Αντώνιος", "Βασίλειος", "Γεώργιος", "Δημήτριος", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος", "Παναγιώτης"),
}
CLASS_OF = {name: kind for kind, names in GIVEN.items() for name in names}

#: What a key or token starts with; a surrogate keeps it.
_PREFIX = r"AKIA|ASIA|gh[pousr]_|github_pat_|sk-(?:proj-|live-|ant-)?|xox[abprs]-|glpat-|AIza"
#: By kind, in order of precedence where finds overlap.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("token", rf"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|(?:{_PREFIX})[0-9A-Za-z_-]{{16,255}}|eyJ[\w-]{{6,}}\.eyJ[\w-]{{6,}}\.[\w-]{{6,}})(?![0-9A-Za-z])"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    ("token", r"(?<![0-9A-Za-z+/=_-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?:[0-9A-Fa-f]{32,128}|[0-9A-Za-z+/]{40,512}={0,2})(?![0-9A-Za-z+/=_-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.+-])(?:1[ .-])?\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4}(?![\w-]|\.\d)"),
    ("card", r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])|(?<![\d.])\d{13,19}(?!\d)"),
)
_KINDS = [kind for kind, _ in PATTERNS]
_FIND = re.compile("|".join(f"(?P<k{n}>{pattern})" for n, (_, pattern) in enumerate(PATTERNS)))
#: Account numbers are known by their check digits, values by the word before them; both go before the patterns.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PAIR = re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?=[^\s\"',;]*\d)((?:[!#$%&*+./=@^_~-]*[A-Za-z0-9]){8,128}[!#$%&*+/=@^_~-]{0,8})")
#: Only lines with one of these can hold an entity of the patterns.
_SIGN = re.compile(rf"[0-9@]|{_PREFIX}|eyJ")
_UPPER = {name.upper(): name for name in CLASS_OF}
_CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÞА-ЯΆ-Ϋ][^\W\d_]+(?!\w)")
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]{2,})*"
_FAMILY = re.compile(rf" (?:[^\W\d_]\. )?({_NAME})(?!\w)")
_TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? (?:[^\W\d_]\. )?({_NAME})(?!\w)")


class Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: str, *parts: object) -> None:
        self.seed, self.n, self.left = repr((key, *parts)).encode(), 0, b""

    def below(self, most: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.blake2b(self.seed + str(self.n).encode(), digest_size=64).digest()
            self.n += 1
        out, self.left = int.from_bytes(self.left[:8], "big") % most, self.left[8:]
        return out


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def canonical(kind: str, value: str) -> str:
    """The form that all spellings of an entity share."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    return value.lower() if kind in ("email", "secret", "family") else value


# Consonants and vowels by script.
_SOUNDS = (("Ѐ", "ӿ", ("бвгдклмнпрст", "аеиоу")), ("Ͱ", "Ͽ", ("βγδκλμνπρτφχ", "αεηιου")), ("\0", "\U0010ffff", ("bcdfghklmnprstvw", "aeiou")))


def _letters(r: Stream, like: str) -> str:
    """Letters for letters of the script, digits for digits, the rest as it is; vowels and consonants take turns."""
    out = []
    for k, c in enumerate(like):
        if c.isdigit():
            out.append(str(r.below(10)))
        elif c.isalpha():
            pool = next((p for low, high, p in _SOUNDS if low <= c <= high), _SOUNDS[-1][2])[k % 2]
            out.append(pool[r.below(len(pool))])
        else:
            out.append(c)
    return "".join(out)


def _like(r: Stream, c: str) -> str:
    """A digit for a digit, a letter for a letter of its case, the rest as it is."""
    for kind in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in kind:
            return kind[r.below(len(kind))]
    return c


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(kind: str, canon: str, key: str, attempt: int = 0) -> str:
    """The canonical form of the entity that stands for ``canon``; of an e-mail address, the part before the @."""
    r = Stream(key, kind, canon, attempt)
    more = "ae" * (attempt // LONGER)  # should a length be used up, longer ones follow
    digits = "0" * max(0, attempt - LONGER_NUMBER)
    if kind == "email":
        return _letters(r, canon.split("@", 1)[0] + more)
    if kind == "domain":
        names = canon.split(".")
        return ".".join([*(_letters(r, n) for n in names[:-2]), _letters(r, names[-2] + more), names[-1]])
    if kind == "secret":
        return "".join("0123456789abcdef"[r.below(16)] for _ in canon)
    if kind == "token":
        start = re.match(_PREFIX + "|eyJ", canon)
        keep = start.end() if start else 0
        return canon[:keep] + "".join(_like(r, c) for c in canon[keep:] + more)
    if kind == "ssn":
        return "".join(str(r.below(10)) for _ in canon + digits)
    if kind == "iban":
        body = "".join(_like(r, c) for c in canon[4:] + digits)
        return canon[:2] + f"{98 - _mod97(canon[:2] + '00' + body):02d}" + body
    if kind == "ipv6":
        return ":".join(f"{r.below(1 << 16):04x}" for _ in range(8))
    if kind == "ip":
        return ".".join(str(1 + r.below(254 if not digits else 10 ** len(digits) * 1000)) for _ in range(4))
    if kind == "phone":
        keep = max(0, len(canon) - 10)  # the country's code
        return canon[:keep] + "".join(str(r.below(10)) for _ in canon[keep:] + digits)
    if kind == "card":
        body = "".join(str(r.below(10)) for _ in digits + canon[:-1])
        right = [d for d in "0123456789" if luhn(body + d) == luhn(canon)]
        return body + right[r.below(len(right))]
    if kind == "family":
        return _letters(r, canon + more)
    raise ValueError(kind)


def given_name(name: str, key: str) -> str:
    """A name of the same script and gender: the next one in a keyed order, so different names stay different."""
    if name in _UPPER and name not in CLASS_OF:
        return given_name(_UPPER[name], key).upper()
    names = sorted(GIVEN[CLASS_OF[name]], key=lambda x: Stream(key, "given", x).below(1 << 62))
    return names[(names.index(name) + 1) % len(names)]


def _as_written(kind: str, canon: str, found: str) -> str:
    """The surrogate in the format of what it replaces."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(canon)
        return "".join(next(digits) if c.isdigit() else c for c in found) + "".join(digits)
    if kind == "iban":
        signs = iter(canon)
        return "".join(c if c == " " else next(signs) for c in found) + "".join(signs)
    if kind == "secret":
        return canon.upper() if found.upper() == found and found.lower() != found else canon
    if kind == "family":
        if found.isupper() and len(found) > 1:
            return canon.upper()
        return "".join(c.upper() if found[k : k + 1].isupper() else c for k, c in enumerate(canon))
    return canon


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text in order; a person's given and family name are one each.

    A family name is one after a given name or a title; where it stands elsewhere in the text it is found as well.
    """
    text, out, at = text or "", [], 0
    first = [(m.start(), m.end(), "iban", m.group()) for m in _IBAN.finditer(text) if _mod97(m.group().replace(" ", "")) == 1]
    for m in _PAIR.finditer(text):
        known = re.match(_FIND, m.group(1))
        if not (known and known.end() == len(m.group(1))):
            first.append((m.start(1), m.end(1), "token", m.group(1)))
    while m := _SIGN.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        at = text.find("\n", m.start())
        at = len(text) if at < 0 else at
        for f in _FIND.finditer(text, start, at):
            kind = next(k for n, k in enumerate(_KINDS) if f.group(f"k{n}") is not None)
            if kind == "ipv6" and not _is_ipv6(f.group()):
                continue
            out.append((f.start(), f.end(), kind, f.group()))
    if first:
        alone: list = []
        for x in sorted(first):
            if not alone or alone[-1][1] <= x[0]:
                alone.append(x)
        out = sorted([x for x in out if not any(s < x[1] and x[0] < e for s, e, _, _ in alone)] + alone)
    free = bytearray(b"\1") * len(text)
    for s, e, _, _ in out:
        free[s:e] = bytes(e - s)
    people: dict[int, tuple[int, int, str, str]] = {}
    for m in _CAPITAL.finditer(text):
        if (m.group() in CLASS_OF or m.group() in _UPPER) and free.find(0, m.start(), m.end()) < 0:
            people[m.start()] = (m.start(), m.end(), "given", m.group())
    # a given name that could be taken for a family name, as in "Anna Maria", stays a given name
    spots = [f for m in list(people.values()) if (f := _FAMILY.match(text, m[1]))] + list(_TITLED.finditer(text))
    for f in spots:
        name = f.group(1)
        if name[0].isupper() and len(name) > 1 and f.start(1) not in people and free.find(0, f.start(1), f.end(1)) < 0:
            people[f.start(1)] = (f.start(1), f.end(1), "family", name)
    names = {x[3] for x in people.values() if x[2] == "family" and len(x[3]) > 2}
    if names:
        for s, e, _, _ in people.values():
            free[s:e] = bytes(e - s)
        names |= {n.upper() for n in names} | {n.title() for n in names if n.isupper()}
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=lambda n: (-len(n), n))) + r")(?!\w)", text):
            if free.find(0, m.start(), m.end()) < 0:
                people[m.start()] = (m.start(), m.end(), "family", m.group())
    return sorted([*out, *people.values()]) if people else out


def _is_ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
        return True
    except ValueError:
        return False


def replace(text: str | None, exceptions: dict, key: str, known: dict | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and the number of entities; exceptions: attempt by (kind, canonical form)."""
    known = {} if known is None else known
    out, at, n = [], 0, 0

    def made(kind: str, canon: str) -> str:
        return surrogate(kind, canon, key, exceptions.get((kind, canon), 0))

    for start, end, kind, value in entities(text):
        canon = canonical(kind, value)
        got = known.get((kind, canon))
        if got is None:
            if len(known) >= 50_000:
                known.clear()
            if kind == "given":
                got = given_name(value, key)
            else:
                got = made(kind, canon) + ("@" + made("domain", canon.split("@", 1)[1]) if kind == "email" else "")
            known[kind, canon] = got
        out += [text[at:start], _as_written(kind, got, value)]
        at, n = end, n + 1
    return ("".join([*out, text[at:]]) if n else text), n


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in blocks(batches):
        found = {(one, kind, canonical(kind, value)) for one, text in zip(rows["id"], rows["text"], strict=True) for _, _, kind, value in entities(text) if kind != "given"}
        found |= {(one, "domain", canon.split("@", 1)[1]) for one, kind, canon in found if kind == "email"}
        cols = list(zip(*sorted(found), strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "kind", "canon"])


def _tried(key: str):
    """(kind, canon, attempt, made); made is what has to differ: of an e-mail address, its new local part at the old domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, canons, attempts = (b.column(n).to_pylist() for n in range(3))
            made = [surrogate(k, c, key, a) + ("@" + c.split("@", 1)[1] if k == "email" else "") for k, c, a in zip(kinds, canons, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], names=["kind", "canon", "attempt", "made"])

    return run


def _exceptions(distinct: DataFrame, key: str) -> DataFrame:
    """``kind, canon, attempt`` of the entities whose first surrogate is another's, or a real entity of the corpus.

    Of the entities that meet in a surrogate the one with the most attempts keeps it, then the first by canonical form;
    the others, and those that meet a real entity, try again, until none is left. New domains are never real ones, so
    no new address is.
    """
    shape, columns = "kind string, canon string, attempt int, made string", ["kind", "canon", "attempt", "made"]
    real = distinct.where("kind <> 'email'").select("kind", F.col("canon").alias("made"))
    tried = materialize(mapped(distinct.select("kind", "canon", F.lit(0).alias("attempt")), _tried(key), shape), "pii-tried")
    while True:
        met = tried.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("attempt")).alias("a"), "canon"))["canon"].alias("keeps")).where("n > 1")
        later = tried.join(met, ["kind", "made"]).where(F.col("canon") != F.col("keeps")).select(columns)
        taken = tried.where(F.col("attempt") < REAL).join(real, ["kind", "made"], "left_semi").select(columns)
        bad = materialize(later.unionByName(taken).select("kind", "canon", "attempt").distinct(), "pii-bad")
        if bad.isEmpty():
            return tried.where("attempt > 0").select("kind", "canon", "attempt")
        again = mapped(bad.select("kind", "canon", (F.col("attempt") + 1).cast("int").alias("attempt")), _tried(key), shape)
        before, tried = tried, materialize(tried.join(bad, ["kind", "canon"], "left_anti").select(columns).unionByName(again), "pii-tried")
        discard(before, bad)


def _replaced(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for rows in blocks(batches):
            if shared is not None:
                out = [replace(t, shared.value, key, known) for t in rows["text"]]
            else:
                out = [replace(t, {(x["kind"], x["canon"]): x["attempt"] for x in own or ()}, key) for t, own in zip(rows["text"], rows["own"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["id", "text", "n_entities"])

    return run


def surrogates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str, broadcast_exceptions: int = BROADCAST_EXCEPTIONS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text`` with surrogates, ``n_entities`` replaced.

    ``key`` is the caller's secret: equal keys give equal surrogates, and without it they cannot be told.

    A null text stays null, an empty one empty, both with no entity. Equal rows give equal results; a null ``doc_id``
    stays null. Different entities of one kind never get the same surrogate, and no surrogate is a real entity of the
    corpus (given names, which are exchanged among a fixed list, aside; and numbers so many that REAL tries all met a
    real one). Long texts are read whole, a block of their own each. An empty table gives no row. Other columns are
    not looked at.
    """
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mentions = materialize(mapped(d, _mentions, "id long, kind string, canon string"), "pii-mentions")
    odd = materialize(_exceptions(mentions.select("kind", "canon").distinct(), key), "pii-exceptions")
    few = odd.limit(broadcast_exceptions + 1).collect() if broadcast_exceptions > 0 else None
    shape = "id long, text string, n_entities long"
    if few is not None and len(few) <= broadcast_exceptions:
        shared = d.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in few})
        out = mapped(d, _replaced(key, shared), shape)
    else:
        own = mentions.join(odd, ["kind", "canon"]).groupBy("id").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("own"))
        out = mapped(d.join(own, "id", "left"), _replaced(key, None), shape)
    return out.select(outer_id("id").alias("doc_id"), "text", "n_entities")
