import re

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import surrogates
from rosterlake.llm.surrogates import fitted, luhn, mentions, mod97, surrogate
from rosterlake.session import StepTables

from .rows import awkward, clashing, empty

KEY = b"test key"


def kinds(text):
    return [(m[0], text[m[2] : m[3]]) for m in mentions(text)]


def test_entities_are_found():
    assert kinds("mail jo.e+x@mail.example.com, or +1 (988) 555-2485.") == [("email", "jo.e+x@mail.example.com"), ("phone", "+1 (988) 555-2485")]
    assert kinds("at 42.144.35.254. And 4111 1111 1111 1111!") == [("ip", "42.144.35.254"), ("card", "4111 1111 1111 1111")]
    assert kinds("DE89 3704 0044 0532 0130 00 and 123-45-6789") == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    assert kinds('password=abc12345 token = "0123456789abcdef"') == [("secret", "abc12345"), ("secret", "0123456789abcdef")]
    assert kinds("Yesterday Mary Jones met Dr. Smith.") == [("given latin female", "Mary"), ("family latin", "Jones"), ("family latin", "Smith")]
    assert kinds("Это Анна Иванова.") == [("given cyrillic female", "Анна"), ("family cyrillic", "Иванова")]


@pytest.mark.parametrize(
    "text, names",
    [
        ("John Smith came. Smith said that John left; SMITH's car.", ["John", "Smith", "Smith", "John", "SMITH"]),
        ("Mr. Xavier Young and Prof. Ute van Dyck", ["Xavier", "Young", "Ute", "Dyck"]),
        ("Mary Ann Smith wrote.", ["Mary", "Ann", "Smith"]),
        ("John McDonald, Mary O'Brien, Dr. Wu and JOHN BAKER", ["John", "McDonald", "Mary", "O'Brien", "Wu", "JOHN", "BAKER"]),
        ("Анна Иванова и Иванов", ["Анна", "Иванова", "Иванов"]),
        ("Yesterday Paris was wet, said Mr. Lee. Paris dried.", ["Lee"]),
    ],
)
def test_names_of_all_forms_and_alone(text, names):
    found = mentions(text)
    assert [text[m[2] : m[3]] for m in found] == names
    assert {fitted(m[0], text[m[2] : m[3]], "xy").isupper() for m in found if text[m[2] : m[3]].isupper()} <= {True}


@pytest.mark.parametrize("text", ["4111111111111112", "1.2.3", "1.2.3.4.5", "300.1.1.1", "2024-01-02", "v10.2.3.4a", "Mary had a lamb", "a@b", "12345", "", None])
def test_look_alikes_stay(text):
    assert mentions(text) == []


def test_forms_are_kept():
    for kind, plain, own in (
        ("card", "4111111111111111", "4111-1111-1111-1111"),
        ("phone", "19885552485", "+1 (988) 555-2485"),
        ("iban", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"),
        ("email", "jo.e99@mail.example.com", "Jo.E99@mail.example.com"),
    ):
        new = fitted(kind, own, surrogate(KEY, kind, plain, 0))
        assert new != own and re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(
            r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", own))
        )
    assert luhn(surrogate(KEY, "card", "4111111111111111", 3)) and mod97(surrogate(KEY, "iban", "DE89370400440532013000", 1)) == 1
    assert surrogate(KEY, "ip", "1.2.3.4", 0) != surrogate(b"other", "ip", "1.2.3.4", 0)
    for group, names in surrogates.GIVEN.items():
        new = {surrogate(KEY, f"given {group}", n.lower(), 0) for n in names}
        assert new == {n.lower() for n in names}
    assert fitted("family cyrillic", "Иванова", "балвор") == "Балворова" and fitted("family cyrillic", "Иванов", "балвор") == "Балворов"


def test_coreference_and_distinctness(spark):
    rows = [
        (1, "Write to Ann.Lee@example.com or call (988) 555-2485; Mr. Miller knows, John Miller does."),
        (2, "ann.lee@example.com and 988-555-2485, again ANN.LEE@EXAMPLE.COM"),
        (3, "nothing here"),
    ]
    out = {r["doc_id"]: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    mails = {m.lower() for i in (1, 2) for m in surrogates.EMAIL.findall(out[i]["text"])}
    phones = {re.sub(r"\D", "", m) for i in (1, 2) for m in re.findall(r"[(]?\d{3}[-)] ?\d{3}-\d{4}", out[i]["text"])}
    families = re.findall(r"(?:Mr\.|(?:James|[A-Z][a-z]+)) ([A-Z][a-z]+)(?= knows| does)", out[1]["text"])
    assert len(mails) == len(phones) == 1 and len(set(families)) == 1 and "Miller" not in out[1]["text"]
    assert mails != {"ann.lee@example.com"} and out[3]["text"] == "nothing here" and out[3]["n_entities"] == 0
    assert [out[i]["n_entities"] for i in (1, 2)] == [5, 3]


def test_clashes_are_resolved(spark):
    # all 90 numbers of one shape: nearly every first choice clashes
    rows = [("secret", f"{a}{b}xxxxxx"[:2] + "-" * 6) for a in range(9) for b in range(10)]
    entities = spark.createDataFrame(rows, "kind string, canonical string").limit(40)
    out = surrogates.distinct_surrogates(entities, KEY, StepTables(spark)).collect()
    new, old = {r["replacement"] for r in out}, {r["canonical"] for r in out}
    assert len(new) == 40 and not new & old


@pytest.mark.parametrize("text", ["********", "парольпароль", "пароль12", "------"])
def test_masked_and_foreign_secrets_get_other_letters(text):
    new = surrogate(KEY, "secret", text, 0)
    assert new != text and not any(c.isalpha() and not c.isascii() for c in new) and any(c.isalnum() for c in new)


@pytest.mark.parametrize("kind, plain", [("email", "a@b.com"), ("phone", "12345"), ("ssn", "123456789"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("secret", "a-----")])
def test_forms_are_left_after_some_attempts(kind, plain):
    new = surrogate(KEY, kind, plain, 16)
    assert len(new) == len(plain) + 2 and re.sub(r"\W", "", fitted(kind, plain, new)) == re.sub(r"\W", "", new)


def test_masked_secret_and_exhausted_emails_end(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("secret", "********"), ("secret", "парольпароль")] + [("email", f"{a}@{b}.com") for a in letters for b in letters]
    entities = spark.createDataFrame(rows, "kind string, canonical string")
    out = surrogates.distinct_surrogates(entities, KEY, StepTables(spark)).collect()
    new, old = {r["replacement"] for r in out}, {r["canonical"] for r in out}
    assert len(new) == len(rows) and not new & old


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    out = surrogates.replace_entities(docs, KEY)
    assert out.columns == [*(c for c in docs.columns if c != "n_entities"), "n_entities"]
    same = out.select(docs.columns).exceptAll(docs).count() + docs.exceptAll(out.select(docs.columns)).count()
    assert same == 0 and out.agg(F.sum("n_entities")).first()[0] == 0
    assert surrogates.replace_entities(empty(spark), KEY).count() == 0
    long = docs.where("doc_id = 6").withColumn("text", F.concat("text", F.lit(" end 42.144.35.254")))
    (row,) = surrogates.replace_entities(long.union(long), KEY).distinct().collect()
    assert row["n_entities"] == 1 and "42.144.35.254" not in row["text"]
