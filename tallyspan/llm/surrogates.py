"""Surrogates for personal data: keyed, type-consistent, distinct, the same for each mention.

Entities are found by kind: e-mail addresses, telephone numbers, IPv4 addresses, payment card
numbers, social security numbers, IBANs, secrets (access keys, password and token values) and
names of persons after a form of address or a known given name of five letters or more
(shorter ones are words of many languages); a name found so is also found wherever it stands
alone in the same text, capitalised (initials excepted). Every entity has a canonical
form (lower case, digits alone, ...). Its surrogate is drawn from HMAC(key, kind, canonical,
attempt) and put into the mention's own format: separators, letter case, country code, card
brand and check digits, label counts and lengths; names keep script and gender, and given and
family names are mapped apart, so "Ms Hale" and "Ruth Hale" stay one family. Family names that
have a form for each gender (Иванов, Иванова) are one entity, whose surrogate has both forms.
An address's domain is an entity of its own, so one domain becomes one domain (under a reserved
ending) and two become two.

Distinctness is checked, not hoped for: all distinct entities of the corpus are assigned
surrogates at once, and of those that share one, or whose surrogate is another entity's own
canonical form, all but the first draw again until none do; from attempt GROWS on surrogates
become longer, so that the rounds end even where a shape has fewer values than entities. Only
those few (attempt > 0) have to be known when texts are rewritten; everything else follows from
the key, which is the caller's. They are broadcast while there are at most BROADCAST_REDRAWN of
them, else joined to their documents.

Defined results: a null text stays null, texts without entities come back unchanged, long
texts are searched whole, repeated rows give equal results, an empty table gives no rows,
and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, read

#: The setting that holds a run's key. Without it the query below uses a published key, which
#: hides nothing from who reads this; a run on real data has to set its own.
KEY_SETTING = "spark.tallyspan.surrogates.key"
PUBLISHED_KEY = "published: set your own"
#: From this attempt on, each attempt makes a surrogate one character longer.
GROWS = 6
#: An address's attempt is its own and that of its domain, in bits above these.
DOMAIN_BITS = 16
#: About 200 bytes each.
BROADCAST_REDRAWN = 50_000

GIVEN = {
    ("f", "latin"): "Ada Anna Alice Clara Diana Elena Emma Eva Grace Helen Ines Irene Julia Karin Laura Lena Lucy Maria Marta Nina Nora Olga Petra Rosa Ruth Sara Silvia Sofia Vera Wanda".split(),
    ("m", "latin"): "Adam Alan Bruno Carl Daniel David Emil Erik Felix Frank Georg Hans Hugo Ivan James Jan John Jorge Karl Leo Louis Marco Martin Otto Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Григорий Дмитрий Иван Максим Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Family names are spelled from syllables, so that there are always more of them.
SYLLABLES = {
    "latin": "bar ber cal dor el far gar hal kel lan mar nor pel ran sel tor var wen".split(),
    "cyrillic": "бар вер гор дол кал лен мар нор пел рен сол тур".split(),
    "greek": "βαρ γερ δορ κελ λαν μαρ νορ περ σελ τορ".split(),
}
ENDINGS = {"latin": "by den ford ham ley man son ton".split(), "cyrillic": "енко чук ян".split(), "greek": "ακης ιδης πουλος".split()}
#: Endings of family names that have a form for each gender: of men, of women.
GENDERED = {"cyrillic": (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ин", "ина"))}
WOMEN = {"greek": "ακη ιδη πουλου".split()}
ADDRESS = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "г-н": "m", "господин": "m", "κ": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "г-жа": "f", "госпожа": "f", "κα": "f",
}
_GENDER = {name.casefold(): gender for (gender, _), names in GIVEN.items() for name in names}
_WORD = r"[^\W\d_]"
_NAME = rf"(?=[A-ZÀ-ÞΆ-ΫА-ЯЁ]){_WORD}+(?:[-']{_WORD}+)*"

PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.+-])[\w][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{12,}(?![A-Za-z0-9])",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[=:]\s*)(?P<value>\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[A-Za-z0-9_+/=-]{6,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    "address_name": rf"(?<!\w)(?P<title>{'|'.join(sorted(ADDRESS, key=len, reverse=True))})\.?[ ](?P<person>{_NAME}(?:[ ]{_NAME})?)",
    "given_name": rf"(?<!\w)(?P<given>{'|'.join(name for names in GIVEN.values() for name in names if len(name) > 4)})[ ](?P<family>{_NAME})",
}
_BARE = re.compile(rf"(?<!\w){_WORD}+(?:[-']{_WORD}+)*(?!\w)")
_FIND = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: Texts in which none of this occurs hold no entity; RE2 passes over them at memory speed.
#: Each pattern needs one of them: a digit of any script, @, the prefix of an access key, the
#: sign before a secret's value, a form of address or a given name.
_HINT = r"\p{Nd}|@|AKIA|ASIA|[=:]|" + "|".join([*map(re.escape, ADDRESS), *(name for names in GIVEN.values() for name in names if len(name) > 4)])


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def script(word: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", word) else "greek" if re.search(r"[Ͱ-Ͽἀ-῿]", word) else "latin"


def family(name: str) -> str:
    """The canonical form of a family name: a man's, where women's differ."""
    said = name.casefold()
    return next((said[: -len(f)] + m for m, f in GENDERED.get(script(name), ()) if said.endswith(f)), said)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) in order, not overlapping; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def add(start: int, end: int, kind: str, canonical: str) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, canonical))

    for kind, pattern in _FIND.items():
        for m in pattern.finditer(text):
            if kind == "secret":
                start, end = m.span("value")
                quoted = text[start] in "\"'"
                add(start + quoted, end - quoted, kind, text[start + quoted : end - quoted])
            elif kind == "card":
                digits = re.sub(r"\D", "", m[0])
                if luhn(digits):
                    add(*m.span(), kind, digits)
            elif kind in ("phone", "ssn"):
                if len(re.sub(r"\D", "", m[0])) >= 7:
                    add(*m.span(), kind, re.sub(r"\D", "", m[0]))
            elif kind == "iban":
                add(*m.span(), kind, m[0].replace(" ", ""))
            elif kind == "address_name":
                parts, at = m["person"].split(" "), m.start("person")
                if len(parts) == 2:
                    add(at, at + len(parts[0]), f"given:{ADDRESS[m['title']]}:{script(parts[0])}", parts[0].casefold())
                    at += len(parts[0]) + 1
                add(at, at + len(parts[-1]), f"family:{script(parts[-1])}", family(parts[-1]))
            elif kind == "given_name":
                add(*m.span("given"), f"given:{_GENDER[m['given'].casefold()]}:{script(m['given'])}", m["given"].casefold())
                add(*m.span("family"), f"family:{script(m['family'])}", family(m["family"]))
            else:
                add(*m.span(), kind, m[0].lower() if kind == "email" else m[0])
    names = {text[start:end].casefold(): kind for start, end, kind, _ in sorted(found, reverse=True) if end - start > 1 and kind.startswith(("given:", "family:"))}
    for m in _BARE.finditer(text) if names else ():
        whole = m[0].casefold() in names
        for part in [m] if whole else re.compile(rf"{_WORD}+").finditer(text, *m.span()):
            if part[0][0].isupper() and (kind := names.get(part[0].casefold())):
                add(*part.span(), kind, family(part[0]) if kind.startswith("family:") else part[0].casefold())
    return sorted(found)


class Draw:
    """A stream of choices from HMAC-SHA256 of the key and what is named."""

    def __init__(self, key: bytes, *named: str):
        self.value = int.from_bytes(b"".join(hmac.new(key, "\0".join([*named, str(i)]).encode(), hashlib.sha256).digest() for i in range(8)), "big")

    def below(self, n: int) -> int:
        self.value, out = divmod(self.value, n)
        return out

    def pick(self, options):
        return options[self.below(len(options))]

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, hexadecimal for hexadecimal."""
        hexa = bool(re.fullmatch(r"[0-9a-f]+", text)) and bool(re.search(r"\d", text)) and len(text) >= 6
        vowels, rest, out = "aeiou", "bdfgklmnprstvz", []
        for i, c in enumerate(text):
            if hexa:
                out.append(self.pick("0123456789abcdef"))
            elif c.isdigit():
                out.append(self.pick("0123456789"))
            elif c.isalpha():
                letter = self.pick(vowels if i % 2 else rest)
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the entity that stands for this one."""
    own = attempt & (1 << DOMAIN_BITS) - 1 if kind == "email" else attempt
    draw = Draw(key, kind, canonical, str(own))
    digits = lambda n: "".join(draw.pick("0123456789") for _ in range(n))
    letters = lambda n: "".join(draw.pick("bdfgklmnprstvz") for _ in range(n))
    more = max(0, own - GROWS + 1)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        return f"{draw.like(local)}{letters(more)}@{surrogate(key, 'domain', domain, attempt >> DOMAIN_BITS)}"
    if kind == "domain":
        labels = canonical.split(".")
        return ".".join([*map(draw.like, labels[:-2]), draw.like(labels[-2]) + letters(more), draw.pick(["example", "invalid", "test"])])
    if kind == "ip":
        body = ".".join(str(draw.below(n) + low) for n, low in ((222, 1), (256, 0), (256, 0), (254, 1)))
        return body + "".join(f".{draw.below(256)}" for _ in range(more))
    if kind == "card":
        body = canonical[0] + digits(len(canonical) - 2 + more)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ssn":
        return "9" + digits(len(canonical) - 1 + more)
    if kind == "phone":
        n = max(7, min(10, len(canonical) - 1))
        return (canonical[:-n] + draw.pick("23456789") + digits(n - 1) if len(canonical) > 7 else "".join(draw.pick("23456789") for _ in canonical)) + digits(more)
    if kind == "iban":
        return canonical[:2] + "".join(draw.pick("0123456789") if c.isdigit() else draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canonical[2:]) + digits(more)
    if kind == "access_key":
        return canonical[:4] + "".join(draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in canonical[4:]) + digits(more)
    if kind.startswith("given:"):
        _, gender, of = kind.split(":")
        # a name of the list first, then double names, of which there are ever more
        return "-".join(draw.pick(GIVEN[gender, of]) for _ in range(1 + own)).casefold()
    if kind.startswith("family:"):
        of = kind.split(":")[1]
        forms = GENDERED.get(of, ())
        if any(canonical.endswith(m) for m, _ in forms):
            endings = [m for m, _ in forms]
        else:
            endings = WOMEN[of] if of in WOMEN and canonical.endswith(("η", "α", "ου", "ή", "ά", "ού")) else ENDINGS[of]
        return "".join(draw.pick(SYLLABLES[of]) for _ in range(2 + own)) + draw.pick(endings)
    return draw.like(canonical) + letters(more)


def in_format(mention: str, kind: str, value: str) -> str:
    """A surrogate's canonical form as this mention would have written it."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in mention) + "".join(letters)
    if kind.startswith(("given:", "family:")):
        if kind.startswith("family:"):
            forms = GENDERED.get(kind.split(":")[1], ())
            if any(mention.casefold().endswith(f) for _, f in forms):
                value = next((value[: -len(m)] + f for m, f in forms if value.endswith(m)), value)
        return value.upper() if mention.isupper() and len(mention) > 1 else "-".join(p.capitalize() for p in value.split("-"))
    return value.upper() if kind == "email" and mention.isupper() else value


def _hinted(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_pylist()


def assign(docs: DataFrame, key: bytes, text: str = "text", draw: Callable = surrogate) -> DataFrame:
    """kind, canonical, surrogate, attempt of every distinct entity in docs, and of the domains
    of addresses. Within a kind no surrogate is shared, and none is the canonical form of an
    entity in docs. Domains are settled first, as addresses are made of theirs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hinted = batch.column(0).filter(pa.array(_hinted(batch.column(0)), pa.bool_()))
            found = {(kind, canonical) for t in hinted for _, _, kind, canonical in entities(t.as_py())}
            found |= {("domain", canonical.partition("@")[2]) for kind, canonical in found if kind == "email"}
            kinds, names = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["kind", "canonical"])

    every = keep(docs.select(F.col(text).cast("string")).mapInArrow(find, "kind string, canonical string").distinct(), "entities")
    plain = _distinct_surrogates(every.where("kind <> 'email'").withColumn("attempt", F.lit(0)), key, draw)
    of_domain = plain.where("kind = 'domain'").select(F.col("canonical").alias("domain"), (F.col("attempt") * (1 << DOMAIN_BITS)).alias("attempt"))
    mails = every.where("kind = 'email'").withColumn("domain", F.substring_index("canonical", "@", -1)).join(of_domain, "domain").drop("domain")
    return plain.unionByName(_distinct_surrogates(mails, key, draw))


def _distinct_surrogates(entities_: DataFrame, key: bytes, draw: Callable) -> DataFrame:
    """kind, canonical, attempt and surrogate, drawn until no two of a kind are equal."""

    def drawn(rows: DataFrame) -> DataFrame:
        def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names, attempts = (batch.column(c).to_pylist() for c in range(3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([draw(key, *x) for x in zip(kinds, names, attempts, strict=True)], pa.string())], ["kind", "canonical", "attempt", "surrogate"])

        return rows.select("kind", "canonical", "attempt").mapInArrow(value, "kind string, canonical string, attempt int, surrogate string")

    now = keep(drawn(entities_), "surrogates")
    while True:
        # an entity that drew first keeps its surrogate; later attempts and later names give way
        turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical"))
        own = now.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
        checked = now.withColumn("turn", turn).join(own, ["kind", "surrogate"], "left")
        clash = (F.col("turn") > 1) | F.col("taken").isNotNull()
        checked = keep(checked.select("kind", "canonical", "attempt", "surrogate", clash.alias("clash")), "checked")
        if not checked.where("clash").limit(1).count():
            return checked.drop("clash")
        again = drawn(checked.where("clash").withColumn("attempt", F.col("attempt") + 1))
        now = keep(checked.where("NOT clash").drop("clash").select("kind", "canonical", "attempt", "surrogate").unionByName(again), "surrogates")


def replace(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text", draw: Callable = surrogate) -> DataFrame:
    """doc_id, text with surrogates for all entities, n_entities and kinds (sorted, distinct)."""
    redrawn = keep(assign(docs, key, text, draw).where("attempt > 0").select("kind", "canonical", "attempt"), "redrawn")
    spark, rows = docs.sparkSession, docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if redrawn.count() <= BROADCAST_REDRAWN:
        known = spark.sparkContext.broadcast({(r.kind, r.canonical): r.attempt for r in redrawn.collect()})
        rows = rows.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        known = spark.sparkContext.broadcast({})
        rows = _with_redrawn(rows, redrawn)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for t, hinted, own in zip(batch.column(1).to_pylist(), _hinted(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = entities(t) if hinted else []
                attempts = {(r["kind"], r["canonical"]): r["attempt"] for r in own} if own else known.value
                parts, at = [], 0
                for start, end, kind, canonical in found:
                    value = draw(key, kind, canonical, attempts.get((kind, canonical), 0))
                    parts += [t[at:start], in_format(t[start:end], kind, value)]
                    at = end
                texts.append("".join([*parts, t[at:]]) if parts else t)
                counts.append(len(found))
                kinds.append(sorted({kind for _, _, kind, _ in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "kinds"])

    return rows.mapInArrow(rewrite, "doc_id long, text string, n_entities long, kinds array<string>")


def _with_redrawn(rows: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Each text with the redrawn entities that it holds, by a join on the texts' hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(h, kind, canonical) for h, t, hinted in zip(batch.column(0).to_pylist(), batch.column(1), _hinted(batch.column(1)), strict=True) if hinted for kind, canonical in {(k, c) for _, _, k, c in entities(t.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["of", "kind", "canonical"])

    held = rows.select(F.xxhash64("text"), "text").mapInArrow(find, "of long, kind string, canonical string").distinct()
    lists = held.join(redrawn, ["kind", "canonical"]).groupBy("of").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("redrawn"))
    return rows.join(lists, F.xxhash64("text") == F.col("of"), "left").select("doc_id", "text", "redrawn")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(read(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, PUBLISHED_KEY).encode())


QUERIES = {"op1_surrogates": op1_surrogates}
ORACLE_SQL: dict[str, str] = {}
