"""Surrogates for personal data: keyed, type-consistent replacements.

Detected are e-mail addresses, IPv4 addresses, payment card numbers, phone numbers, national identifiers
(SSN, IBAN), secrets (quoted values of token-like keys, long hexadecimal strings) and names of persons after
forms of address ("Herr Dr. Weber", "Mr. John F. Kennedy", "Frau von der Leyen"). Names so found are also found
wherever else the same text has them as words of their own. A mention's canonical form (letter case and
punctuation removed) is replaced by one of the same type: letters by letters of the same script, digits by
digits, octets by octets, a card number keeps its issuer digit and its Luhn check, a phone number its country
code, a given name its gender. A name is one entity under any form of address: its role (given or last name)
and gender are those of most of its mentions in the corpus. The canonical surrogate is written back in the
mention's own format, so that all mentions of one entity, however written, have the same surrogate.

Surrogates come from a keyed hash of type, canonical form and attempt. All distinct entities of the corpus
are checked together: if two have the same surrogate, or a surrogate is itself an entity of the corpus, all
but one of them try again. What differs stays different, and nothing is replaced by somebody's real data;
if attempts run out, which needs more entities than their format has values, an error is raised. Single
initials are replaced by letters, for which neither can hold.

Texts are searched once; mentions are kept with their places, and what is known of names and of entities with
further attempts is joined to the rows that hold them. Defined results: null text stays null with no entities;
rows are numbered, so null and repeated doc_ids and repeated rows are rewritten like any others; a very long text
is rewritten whole by one task; an empty table gives no rows. Text without entities is returned unchanged. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

ATTEMPTS = 500

# Forms of address by the gender they tell, and names by script and gender.
ADDRESS = {
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Sr.", "Señor", "господин", "г-н", "κύριος"],
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Madame", "Mme", "Sra.", "Señora", "госпожа", "г-жа", "κυρία"],
    "n": ["Dr.", "Dr", "Prof.", "Prof", "Professor"],
}
PARTICLES = ["von", "van", "der", "den", "dem", "de", "la", "le", "du", "di", "da", "del", "dos", "ter", "zu", "bin", "ibn", "al", "el"]
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Bianca", "Clara", "Dora", "Elisa", "Frida", "Greta", "Helena", "Irene", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Ксения", "Лидия", "Марина", "Нина"],
    ("greek", "m"): ["Αλέξης", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gar", "hol", "kin", "lo", "mar", "nes", "pol", "ri", "san", "tor", "ul", "ven", "win"],
    "cyrillic": ["ба", "вер", "гор", "да", "ки", "лан", "ми", "нов", "по", "рин", "со", "тер"],
    "greek": ["βα", "γε", "δη", "κα", "λο", "μα", "νι", "πα", "ρο", "στα"],
}
ENDINGS = {
    ("latin", "m"): ["an", "ert", "ik", "o", "or", "us"], ("latin", "f"): ["a", "ea", "elle", "ia", "ina", "ine"],
    ("cyrillic", "m"): ["ан", "ей", "ий", "ор"], ("cyrillic", "f"): ["а", "ия", "ина", "ья"],
    ("greek", "m"): ["ας", "ης", "ος"], ("greek", "f"): ["α", "η", "ία"],
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_FORMS = "|".join(re.escape(x) for x in sorted((x for forms in ADDRESS.values() for x in forms), key=len, reverse=True))
_GENDER = {x: g for g, forms in ADDRESS.items() for x in forms}
_GAP = r"[ \t ]+"
_NAME = r"[^\W\d_][\w'’-]+"
_PART = rf"(?:{'|'.join(PARTICLES)})(?=[ \t ])"
_TITLES = rf"(?:{_FORMS})(?:{_GAP}(?:{_FORMS})(?!\w))*"
PATTERNS = [
    ("secret", r"(?i:\b(?:api[_-]?key|token|secret|passw(?:or)?d|pwd)\b\s*[=:]\s*[\"'])(?P<secret>[^\"'\s]{8,})[\"']"),
    ("email", r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"),
    ("iban", r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    ("hex", r"\b(?P<hex>(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,})\b"),
    ("ip", r"(?<![\d.])(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"),
    ("card", r"(?<![\w-])(?P<card>\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\w-])"),
    ("phone", r"(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-]|\.\d)"),
    ("person", rf"(?P<person>(?<!\w){_TITLES}(?:{_GAP}{_PART})*{_GAP}{_NAME}(?:{_GAP}(?:[^\W\d_]\.|{_PART}|{_NAME})){{0,3}})"),
]
_ANY = re.compile("|".join(p for _, p in PATTERNS))
_HINT = re.compile(rf"[0-9@]|[=:]\s*[\"']|(?<!\w)(?:{_FORMS}){_GAP}")
_IN_NAME = re.compile(rf"(?P<initial>[^\W\d_])\.|(?P<part>{_PART})|(?P<name>{_NAME})")
_WORD = re.compile(_NAME)


def script_of(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _bare(word: str) -> str:
    """A name without the ending of its genitive."""
    return re.sub(r"['’]s?$|-+$", "", word)


def _person(text: str, a: int, b: int) -> list[tuple[str, int, int, str]]:
    """Words of a name after its forms of address: name (form m, f, n for a given one, s for a last one), initial."""
    titles = re.match(_TITLES, text[a:b]).group(0)
    genders = {_GENDER[x] for x in re.findall(rf"(?:{_FORMS})(?!\w)", titles)} - {"n"}
    gender = genders.pop() if len(genders) == 1 else "n"
    words = []
    for w in _IN_NAME.finditer(text, a + len(titles), b):
        kind = w.lastgroup
        if kind != "part":
            if not text[w.start()].isupper():
                break
            end = w.end(kind) if kind == "initial" else w.start() + len(_bare(w.group()))
            words.append((kind, w.start(), end))
            if end < w.end(kind):
                break
    last = max((i for i, x in enumerate(words) if x[0] == "name"), default=-1)
    return [(kind, x, y, "" if kind == "initial" else "s" if i == last else gender) for i, (kind, x, y) in enumerate(words)]


def detect(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, form) of all mentions in order; names are split in words, whose form is m, f or n for
    given names, s for last names, and empty where the text has them without a form of address."""
    out: list[tuple[str, int, int, str]] = []
    if not _HINT.search(text):
        return out
    for m in _ANY.finditer(text):
        kind = m.lastgroup
        a, b = m.span(kind)
        out += _person(text, a, b) if kind == "person" else [("secret" if kind == "hex" else kind, a, b, "")]
    names = {canonical(kind, text[a:b]) for kind, a, b, _ in out if kind == "name"}
    if names:
        taken, at = sorted((a, b) for _, a, b, _ in out), 0
        for w in _WORD.finditer(text):
            word, a = _bare(w.group()), w.start()
            if word.lower() in names and word[0].isupper():
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if at == len(taken) or taken[at][0] >= a + len(word):
                    out.append(("name", a, a + len(word), ""))
        out.sort(key=lambda x: x[1])
    return out


def canonical(kind: str, mention: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    return mention if kind == "secret" else mention.lower()


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts):
        self.key, self.parts, self.at, self.pool = key, "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        from hashlib import blake2b

        if len(self.pool) < 4:
            self.pool = blake2b(self.parts + b"\x00%d" % self.at, key=self.key, digest_size=64).digest()
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


@lru_cache(4096)
def _letters_like(c: str) -> str:
    """The letters near a letter of any script that are of its kind: its alphabet, or those of its block."""
    from unicodedata import category

    known = ALPHABETS.get(script_of(c)) if "a" <= c.lower() <= "z" or script_of(c) != "latin" else None
    if known and c.lower() in known:
        return known.upper() if c.isupper() else known
    block = ord(c) & ~0x3F
    return "".join(x for x in map(chr, range(block, block + 0x40)) if category(x) == category(c))


def _like(c: str, draw: _Stream, hexadecimal: bool = False) -> str:
    if c.isdecimal():
        return chr(ord(c) - int(c) + draw.below(10))  # the ten digits of a script stand together
    if hexadecimal:
        return "abcdef"[draw.below(6)]
    if c.isalpha():
        letters = _letters_like(c)
        return letters[draw.below(len(letters))]
    return c


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0, form: str = "") -> str:
    """The canonical surrogate of a canonical form; form: of names, as detect has it."""
    draw = _Stream(key, kind, value, attempt)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        good = luhn_digit(value[:-1]) == value[-1]
        return body + (luhn_digit(body) if good else str((int(luhn_digit(body)) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        code = 1 if len(value) > 10 else 0
        return value[:code] + "".join(str(draw.below(10)) for _ in value[code:])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        within = _Stream(key, "domain", domain, attempt)
        labels[:-1] = ["".join(_like(c, within) for c in x) for x in labels[:-1]]
        return "".join(_like(c, draw) for c in local) + "@" + ".".join(labels)
    if kind == "name":
        script = script_of(value)
        parts = SYLLABLES[script]

        def some(n: int) -> str:
            return "".join(parts[draw.below(len(parts))] for _ in range(n))

        if form == "s":
            return some(4 + attempt // 4)
        gender = form if form in ("m", "f") else "mf"[draw.below(2)]
        listed, ends = GIVEN[script, gender], ENDINGS[script, gender]
        return (listed[draw.below(len(listed))] if not attempt else some(2 + attempt // 3) + ends[draw.below(len(ends))]).lower()
    if kind == "iban":
        return value[:2] + "".join(_like(c, draw) for c in value[2:])
    return "".join(_like(c, draw, re.fullmatch("[0-9a-f]+", value) is not None) for c in value)


def written(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate in the mention's format: its punctuation, its letter case."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind in ("name", "initial"):
        return new.upper() if mention.isupper() else new[:1].upper() + new[1:]
    if kind == "secret" or not mention.isascii() or len(new) != len(mention):
        return new
    return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new))


def rewrite(text: str, key: bytes, mentions: list[tuple[str, int, int]], known: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, list[dict]]:
    """mentions: (kind, start, end) in order; known: form and attempt of entities that aren't plain."""
    out, at, entities = [], 0, []
    for kind, a, b in mentions:
        value = canonical(kind, text[a:b])
        form, attempt = known.get((kind, value), ("", 0))
        new = written(kind, text[a:b], surrogate(kind, value, key, attempt, form))
        out += [text[at:a], new]
        entities.append({"kind": kind, "start": a, "length": b - a, "surrogate": new})
        at = b
    return ("".join([*out, text[at:]]) if out else text), entities


def settle(entities: DataFrame, key: bytes, scratch: Scratch, attempts: int = ATTEMPTS) -> DataFrame:
    """entities: distinct kind, value, with their form. Returns kind, value, form, attempt."""

    def propose(batches):
        import pyarrow as pa

        for batch in batches:
            new = [surrogate(k, v, key, n, f) for k, v, f, n in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            yield pa.record_batch([*batch.columns[:4], pa.array(new, pa.string())], names=["kind", "value", "form", "attempt", "new"])

    schema = "kind string, value string, form string, attempt int, new string"
    entities = scratch.cut(entities.select("kind", "value", "form"), "entities")
    tried = scratch.cut(entities.withColumn("attempt", F.lit(0)).mapInArrow(propose, schema), "tried0")
    taken = entities.select("kind", F.col("value").alias("new"))
    for n in range(1, attempts + 1):
        # among equals the one with the fewest attempts stays, then the smallest; nobody's own data is used
        best = tried.groupBy("kind", "new").agg(F.min(F.struct(F.col("attempt"), F.col("value"))).alias("best"), F.count("*").alias("m"))
        clash = tried.join(best.where("m > 1"), ["kind", "new"]).where("value != best.value").select("kind", "value", "form", "attempt")
        real = tried.join(taken, ["kind", "new"], "left_semi").select("kind", "value", "form", "attempt")
        again = scratch.cut(clash.unionByName(real).distinct(), f"again{n}")
        if not again.limit(1).count():
            return tried.drop("new")
        redone = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(propose, schema)
        tried = scratch.cut(tried.join(again.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(redone), f"tried{n}")
        scratch.drop(f"tried{n - 1}", f"again{n}")
    raise RuntimeError(f"some entities have no surrogate of their own after {attempts} attempts: there are more of them than their format has values")


TAGGED = "rid long, doc_id long, text string, mentions array<struct<kind:string,start:int,length:int,value:string,form:string>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of docs: doc_id, text, n_entities, entities (kind, start, length, surrogate; start and
    length of the mention in the given text, in characters)."""
    if not key:
        raise ValueError("surrogates need a secret key")
    scratch = Scratch(docs.sparkSession, "surrogates")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def tag(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("value", pa.string()), ("form", pa.string())]))
        for batch in batches:
            found = [[(kind, a, b - a, canonical(kind, text[a:b]), form) for kind, a, b, form in detect(text or "")] for text in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([[dict(zip(("kind", "start", "length", "value", "form"), x)) for x in m] for m in found], kinds)], names=["rid", "doc_id", "text", "mentions"])

    tagged = scratch.cut(rows.mapInArrow(tag, TAGGED), "tagged")
    some = tagged.where(F.size("mentions") > 0)
    mentions = some.select("rid", F.explode("mentions").alias("m")).select("rid", "m.kind", "m.value", "m.form").where("kind != 'initial'")

    def times(form: str):
        return F.count(F.when(F.col("form") == form, 1))

    entities = mentions.groupBy("kind", "value").agg(*(times(x).alias(name) for x, name in zip("mfns", ("m", "f", "n", "last"))))
    form = F.when(F.col("kind") != "name", "").when(F.col("last") > F.col("m") + F.col("f") + F.col("n"), "s").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    known = scratch.cut(settle(entities.withColumn("form", form), key, scratch).where("attempt > 0 OR form != ''"), "known")
    special = mentions.select("rid", "kind", "value").distinct().join(known, ["kind", "value"]).groupBy("rid").agg(F.collect_list(F.struct("kind", "value", "form", "attempt")).alias("known"))

    def replace(batches):
        import pyarrow as pa

        entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, entities = [], []
            for text, found, extra in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                new, has = rewrite(text, key, [(x["kind"], x["start"], x["start"] + x["length"]) for x in found], {(x["kind"], x["value"]): (x["form"], x["attempt"]) for x in extra or ()})
                texts.append(new), entities.append(has)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, entities), pa.int64()), pa.array(entities, entity)], names=["doc_id", "text", "n_entities", "entities"])

    schema = "doc_id long, text string, n_entities long, entities array<struct<kind:string,start:int,length:int,surrogate:string>>"
    changed = some.join(special.hint("merge"), "rid", "left").select("doc_id", "text", "mentions", "known").mapInArrow(replace, schema)
    same = tagged.where(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<struct<kind:string,start:int,length:int,surrogate:string>>").alias("entities"))
    return same.unionByName(changed)
