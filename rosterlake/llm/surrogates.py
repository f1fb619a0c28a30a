"""Replacing personal data by surrogates of the same kind and form.

Detected entities are emails, phone numbers, IPv4 addresses, payment cards (with a
valid check digit), IBANs (likewise), social security numbers, credentials, and names
of persons (a title or a known given name before one to five capitalised names, and
those names wherever they stand alone in the same text; Latin and Cyrillic script).
Persons with neither title nor known given name are not found. A surrogate is derived from a secret key and the entity's canonical
form: the same entity gets the same surrogate in all documents and in every
spelling of it. It keeps length, separators, case and check digits; given names keep
gender and script, family names their script and gender ending.

Distinct entities get distinct surrogates, none of which is an entity of the
corpus: surrogates are grouped and joined with the entities, and those that clash are
derived anew until none does; where no surrogate of that form is free, a longer
one is taken, and for secrets letters in place of other characters. Tables of entities stay distributed.

* Null texts stay null; texts without entities stay as they are, also empty ones.
* Repeated rows are treated alike and all kept. An empty table stays empty.
* Very long texts are scanned whole. Extra columns pass through.
* Digits that only look like numbers of cards or accounts (wrong check digits) stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import unused
from rosterlake.session import StepTables

# fixed values: given names by script and gender, titles, gender endings, and parts of family names
GIVEN = {
    "latin male": "James John Robert Michael William David Thomas Daniel Peter Hans Klaus Stefan Jean Pierre Luc Carlos Luis Miguel Javier Pablo".split(),
    "latin female": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Emma Anna Ursula Sabine Claire Sophie Isabelle Carmen Lucia Maria Elena Teresa".split(),
    "cyrillic male": "Иван Сергей Дмитрий Алексей Николай Михаил Павел Андрей".split(),
    "cyrillic female": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra г-н г-жа".split()
ENDINGS = {"latin": (), "cyrillic": ("ова", "ева", "ина", "ов", "ев", "ин", "ская", "ский")}
SYLLABLES = {
    "latin": "bal cor den fal gar hol kel lin mar nor pel ros sal tor val win".split(),
    "cyrillic": "бал вор гал дон зар кол лин мар нор пал рос сав тор фал чер шум".split(),
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
NUMBERS = re.compile(
    rf"(?<![\w.])(?P<ip>(?:{OCTET}\.){{3}}{OCTET})(?!\.?\d|\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w|[-.]\d)"
    r"|(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
)
SECRETS = re.compile(
    r"(?<!\w)(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{10,})(?!\w)"
    r"|(?<!\w)(?:password|passwd|pwd|token|secret|api_?key)\"?\s*[=:]\s*[\"']?(?P<value>[^\s\"',;]{6,})",
    re.IGNORECASE,
)
_ALL = [n for names in GIVEN.values() for n in names]
_ALL += [n.upper() for n in _ALL]
_TITLES = [*TITLES, "MR", "MRS", "PROF", "HERR", "FRAU"]
_PART = (
    r"(?:(?:(?:Mc|Mac|[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]{2,})(?:-[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+))?"
    r"|[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+)(?:-[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+))?)(?!\w)"
)
NAMES = re.compile(
    rf"(?<!\w)(?:(?:(?P<title>{'|'.join(_TITLES)})\.? (?:(?P<given>{'|'.join(_ALL)}) )?|(?P<first>{'|'.join(_ALL)}) )"
    rf"(?P<middle>(?:(?:{_PART}|van|von|der|den|zu|de|del|della|di|da|dos|la|le|ter|bin|al) ){{0,4}}))?(?P<family>{_PART})"
)
PART = re.compile(rf"(?<!\w){_PART}")
STARTS = re.compile(rf"(?<!\w)(?:{'|'.join(sorted({re.escape(t) for t in [*_TITLES, *_ALL]}))})\.? [A-ZÀ-ÖØ-ÞА-ЯЁ]")

MENTION = "kind string, canonical string, start int, end int"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def script_of(word: str) -> str:
    return "cyrillic" if re.match("[А-яЁё]", word) else "latin"


def _stem(family: str) -> tuple[str, str]:
    """A family name in lower case without its gender ending, and that."""
    low = family.lower()
    for ending in ENDINGS[script_of(family)]:
        if low.endswith(ending) and len(low) > len(ending) + 1:
            return low[: -len(ending)], ending
    return low, ""


def mentions(text: str | None) -> list[tuple[str, str, int, int]]:
    """kind, canonical form, start and end of each entity, in order, not overlapping."""
    if not text:
        return []
    found: list[tuple[str, str, int, int]] = []
    if "@" in text:
        found += [("email", m[0].lower(), m.start(), m.end()) for m in EMAIL.finditer(text)]
    if any(d in text for d in "0123456789"):
        for m in NUMBERS.finditer(text):
            kind = m.lastgroup
            plain = re.sub(r"[^0-9A-Za-z]", "", m[0])
            if (kind == "card" and not luhn(plain)) or (kind == "iban" and mod97(plain) != 1):
                continue
            found.append((kind, m[0] if kind == "ip" else plain, m.start(), m.end()))
    if "=" in text or ":" in text or "_" in text or "A" in text:
        for m in SECRETS.finditer(text):
            group = "key" if m["key"] else "value"
            found.append(("secret", m[group], m.start(group), m.end(group)))
    if STARTS.search(text):
        for m in NAMES.finditer(text):
            own = "given" if m["given"] else "first"
            if not (m["title"] or m[own]):
                continue
            parts = [(m["family"], m.start("family"))]
            parts += [(p[0], m.start("middle") + p.start()) for p in PART.finditer(m["middle"])]
            if m[own]:
                given = m[own].capitalize()
                found.append((f"given {_group(given)}", given.lower(), m.start(own), m.end(own)))
            found += [(f"family {script_of(p)}", _stem(p)[0], at, at + len(p)) for p, at in parts]
        # the same names where they stand alone in this text
        known = {canonical: kind for kind, canonical, *_ in found if kind.startswith(("family", "given"))}
        if known:
            for m in PART.finditer(text):
                for canonical in (m[0].lower(), _stem(m[0])[0]):
                    if canonical in known:
                        found.append((known[canonical], canonical, m.start(), m.end()))
                        break
    found.sort(key=lambda x: (x[2], -x[3]))
    out: list[tuple[str, str, int, int]] = []
    for one in found:
        if not out or one[2] >= out[-1][3]:
            out.append(one)
    return out


def _group(given: str) -> str:
    return next(g for g, names in GIVEN.items() if given in names)


class Stream:
    """Numbers derived from key, kind, canonical form and attempt."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self._seed = hashlib.blake2b("\0".join(parts).encode(), key=key[:64], digest_size=32).digest()
        self._block, self._bits, self._left = 0, 0, 1

    def below(self, n: int) -> int:
        if self._left < n << 32:
            more = hashlib.blake2b(self._seed + self._block.to_bytes(8, "little"), digest_size=64).digest()
            self._block += 1
            self._bits, self._left = int.from_bytes(more, "little"), 1 << 512
        self._bits, out = divmod(self._bits, n)
        self._left //= n
        return out


def _same_shape(text: str, numbers: Stream) -> str:
    """Letters for letters of the same case, digits for digits, the rest as is;
    hexadecimal digits for those of a long number in them."""
    if re.fullmatch("[0-9a-f]{12,}", text) and not text.isdigit():
        return "".join("0123456789abcdef"[numbers.below(16)] for _ in text)
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(chr(48 + numbers.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + numbers.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _secret(text: str, numbers: Stream, more: int) -> str:
    """The same shape with ASCII letters for other letters and digits; letters only
    where there is nothing to change, or no surrogate of that shape was free."""
    if more or not any(c.isalnum() for c in text):
        return "".join(chr(97 + numbers.below(26)) for _ in range(len(text) + more))
    return _same_shape("".join("a" if c.isalnum() and not c.isascii() else c for c in text), numbers)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the replacement of an entity; longer after each eight attempts."""
    numbers = Stream(key, kind, canonical, str(attempt))
    more = attempt // 8
    if kind.startswith("given"):
        # a secret rotation of the names of that script and gender: no two become one
        names = GIVEN[kind.removeprefix("given ")]
        shift = 1 + Stream(key, kind).below(len(names) - 1)
        at = next(i for i, n in enumerate(names) if n.lower() == canonical)
        return names[(at + shift) % len(names)].lower()
    if kind.startswith("family"):
        parts = SYLLABLES[kind.removeprefix("family ")]
        return "".join(parts[numbers.below(len(parts))] for _ in range(3 + numbers.below(2) + more))
    if kind == "ip":
        return ".".join(str(1 + numbers.below(254)) for _ in range(4 + more))
    if kind == "email":
        local, domain = canonical.split("@")
        body, _, top = domain.rpartition(".")
        return f"{_same_shape(local + "a" * more, numbers)}@{_same_shape(body, numbers)}.{top}"
    if kind == "card":
        body = canonical[0] + _same_shape(canonical[1:-1] + "0" * more, numbers)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        country, body = canonical[:2], _same_shape(canonical[4:] + "0" * more, numbers)
        return f"{country}{98 - mod97(country + '00' + body):02d}{body}"
    if kind == "phone":
        keep = max(0, len(canonical) - 10)  # a country code
        return canonical[:keep] + _same_shape(canonical[keep:] + "0" * more, numbers)
    if kind == "secret":
        fixed = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_)?", canonical)[0]
        return fixed + _secret(canonical[len(fixed) :], numbers, more)
    return _same_shape(canonical + "0" * more, numbers)


def fitted(kind: str, mention: str, replacement: str) -> str:
    """A canonical replacement in the form of a mention: separators, case, ending."""
    if kind.startswith("given"):
        return replacement.upper() if mention.isupper() else replacement.capitalize()
    if kind.startswith("family"):
        name = replacement + _stem(mention)[1]
        return name.upper() if mention.isupper() else name.capitalize()
    if kind in ("ip", "secret"):
        return replacement
    if kind == "email":
        if len(replacement) != len(mention):
            return replacement
        return "".join(r.upper() if c.isupper() else r for c, r in zip(mention, replacement, strict=True))
    letters = iter(replacement)
    return "".join([*(next(letters) if c.isalnum() else c for c in mention), *letters])


def _finder():
    @F.pandas_udf(f"array<struct<{MENTION.replace(' string', ':string').replace(' int', ':int')}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [c.split()[0] for c in MENTION.split(", ")]
        for batch in batches:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in mentions(t)] for t in batch], dtype=object)

    return find


def distinct_surrogates(entities: DataFrame, key: bytes, steps: StepTables) -> DataFrame:
    """kind, canonical and replacement of each entity; no replacement twice or real."""

    @F.pandas_udf("string")
    def derive(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canonical, attempt, strict=True)], dtype=object)

    entities = steps.write("entities", entities.select("kind", "canonical").distinct())
    now = entities.withColumn("attempt", F.lit(0))
    while True:
        now = steps.write("surrogates", now.withColumn("replacement", derive("kind", "canonical", "attempt")))
        taken = now.groupBy("kind", "replacement").agg(F.min("canonical").alias("first"), F.count("*").alias("n"))
        real = entities.select("kind", F.col("canonical").alias("replacement"), F.lit(True).alias("real"))
        taken = taken.join(real, ["kind", "replacement"], "left").where("n > 1 or real")
        # a name stands among those of its gender by a rotation, which can't clash
        taken = steps.write("clashes", taken.where("not startswith(kind, 'given')"))
        if not taken.limit(1).count():
            return now.select("kind", "canonical", "replacement")
        again = F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("canonical") != F.col("first")))
        now = now.join(taken, ["kind", "replacement"], "left").select(
            "kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt")
        )


def replace_entities(docs: DataFrame, key: bytes, text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of them as ``count`` (in
    place of a column of that name).

    Texts without entities are only scanned; the others, with their entities, are
    written once, and their entities replaced by joins.
    """
    if not key:
        raise ValueError("a key is needed")
    steps = StepTables(docs.sparkSession)
    found, row, cuts = (unused(docs, c) for c in ("_found", "_row", "_cuts"))
    marked = docs.withColumn(found, _finder()(F.col(text)))
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    held = steps.write("held", marked.where(some).withColumn(row, F.monotonically_increasing_id()))
    each = held.select(F.col(row).alias("row"), F.explode(found).alias("m")).select("row", "m.*")
    chosen = distinct_surrogates(each, key, steps)
    per_row = each.join(chosen, ["kind", "canonical"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "replacement"))).alias("cuts")
    )

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for own, changes in zip(texts, cuts, strict=True):
            at, parts = 0, []
            for c in changes:
                parts += [own[at : c["start"]], fitted(c["kind"], own[c["start"] : c["end"]], c["replacement"])]
                at = c["end"]
            out.append("".join([*parts, own[at:]]))
        return pd.Series(out, dtype=object)

    joined = held.join(per_row.select(F.col("row").alias(row), F.col("cuts").alias(cuts)), row)
    others = [c for c in docs.columns if c.lower() != count.lower()]
    columns = [rewritten(F.col(text), F.col(cuts)).alias(text) if c == text else F.col(c) for c in others]
    changed = joined.select(*columns, F.size(cuts).alias(count))
    same = marked.where(~some).select(*others, F.lit(0).alias(count))
    return changed.unionByName(same)
