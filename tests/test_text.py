import pytest

from rosterlake.functions import text as X
from rosterlake.functions import urls as U
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("raw", "want"),
    [("\ta\n", "a"), ("  a b　", "a b"), ("", ""), ("   ", ""), (None, None)],
)
def test_strip_takes_all_whitespace(value, raw, want):
    assert value(X.strip, raw) == want


@pytest.mark.parametrize("raw", ["", "  ", "None", " NULL ", "nan", "\tNaN\n", None])
def test_null_tokens(value, raw):
    assert value(X.null_if_token, raw) is None


def test_other_values_are_stripped_not_nulled(value):
    assert value(X.null_if_token, " Nanotech ") == "Nanotech"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://a.edu/x.", "https://a.edu/x"),
        ("(https://a.edu/staff).)", "https://a.edu/staff"),
        ("NONE", None),
        ("http://a.edu/a http://b.edu", "http://a.edu/a"),
    ],
)
def test_first_url_in_text(value, text, want):
    assert value(X.url_in, text) == want


def test_emails_are_distinct_in_order(value):
    assert value(X.emails_in, "b@x.edu a@x.edu b@x.edu nobody@x") == ["b@x.edu", "a@x.edu"]
    assert value(X.emails_in, "no address") == []


@pytest.mark.parametrize(
    "text", ["a [at] b.edu", "a[@]b.edu", "mailto:a@b.edu", "a [ AT ] b.edu", "MAILTO:a@b.edu"]
)
def test_obfuscated_emails(value, text):
    assert value(lambda c: X.emails_in(X.deobfuscate_emails(c)), text) == ["a@b.edu"]


@pytest.mark.parametrize(
    ("position", "kept"),
    [
        ("Associate Professor", True), ("Senior Lecturer", True), ("Deans", True),
        ("Postdoctoral Fellow", False), ("Professor's Research Assistant", False),
        ("Lab Technician", False), ("PhD students", False), ("International Director", True),
        ("Secretary", False), (None, False),
    ],
)
def test_roles_exclusion_wins(value, position, kept):
    assert value(X.has_included_role, position) is kept


def test_remarks_are_appended(value):
    first = value(lambda c: X.add_remark(F.lit(None).cast("string"), c), "first issue")
    assert first == "first issue"
    assert value(lambda c: X.add_remark(c, F.lit("second issue")), first) == (
        "first issue; second issue"
    )


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/people", "https://a.edu/people"),
        ("x.html", "https://a.edu/dir/x.html"),
        ("//b.edu/y", "https://b.edu/y"),
        ("http://c.edu", "http://c.edu"),
        ("?page=2", "https://a.edu/dir/page?page=2"),
        ("#top", None),
        ("mailto:a@b.edu", None),
        ("javascript:void(0)", None),
        ("", None),
    ],
)
def test_links_are_resolved(value, href, want):
    assert value(lambda c: U.resolve(F.lit("https://a.edu/dir/page?q=1#z"), c), href) == want


def test_blocked_hosts_match_hosts_not_text(value):
    from rosterlake.functions.fixed_values import BLOCKED_HOSTS

    on_host = lambda c: U.on_host(c, BLOCKED_HOSTS)
    anywhere = lambda c: U.on_host(c, BLOCKED_HOSTS, "substring")
    assert value(on_host, "https://uk.linkedin.com/in/a") is True
    assert value(on_host, "https://x.com/a") is True
    assert value(on_host, "https://phoenix.com/a") is False
    assert value(anywhere, "https://phoenix.com/a") is True
    assert value(on_host, None) is False
