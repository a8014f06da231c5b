"""Linked secret parts: against a plain pairwise join, and in time that grows with the text."""

import random
import re
import time

import pytest

from strideframe.llm import secrets

WEAK_ID = re.compile(r"""(?i)(client_?id|account_?id|key_?id|username|user|login)["']? *[:=] *["']?[A-Za-z0-9@._-]{3,}""", re.ASCII)
ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"


def endpoints(text):
    out = [m.span() for m in re.finditer(r"(?i)https?://[^\s\"'<>]+", text, re.ASCII)]
    out += [m.span() for m in re.finditer(rf"[{LOCAL}]+@[{DOMAIN}]+(\.[{DOMAIN}]+)+", text, re.ASCII)]
    return out + [m.span() for m in re.finditer(r"""(?i)(?<![a-z0-9])(host|server|endpoint)["']? *[:=] *["']?[a-z0-9.-]+""", text, re.ASCII)]


def brute_links(text, scope):
    """Every pair of intervals is looked at."""
    base = secrets.base_spans(text)
    ends = endpoints(text)
    weak_ids = [m.span() for m in WEAK_ID.finditer(text)]
    ids = weak_ids + [(s, e) for s, k, e in base if k == 1]
    taken = [(s, e) for s, _, e in base] + ends
    weak = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak += [m.span() for m in ASSIGN.finditer(text) if len(m[2]) < 8]
    weak = [(s, e) for s, e in weak if not any(s < b and a < e for a, b in taken)]
    hidden = weak + [(s, e) for s, k, e in base if k != 1]
    near = lambda found, s, e: any(a < e + scope and b > s - scope for a, b in found)
    return sorted([(s, 3, e) for s, e in weak if near(ids, s, e) and near(ends, s, e)] + [(s, 4, e) for s, e in weak_ids if near(hidden, s, e) and near(ends, s, e)])


PARTS = ["user=joe", "login: 'ab", "clientId=acme", "client_id = acme.77", "password=x1", "token: short", "secret=longenough1", "AKIA" + "Q7" * 8, "deadbeef" * 4, "aB3dE5gH7jK9mN1pQ3sT5", "ABCDEFGHIJ1234567890ABCD", "abcdefghijklmnopqrst1A", "https://x.example/a?b", "joe@mail.example", "a@b", "DB_HOST=10.0.0.5", "host: db1", "ghost=1.2", "SERVER='s'", "the", "and more", "\n\n", "é", "x " * 30, "a@b.c@d.e"]


def test_links_are_those_of_all_pairs():
    rng = random.Random(5)
    linked = 0
    for _ in range(1000):
        text = rng.choice([" ", "\n", ", ", ""]).join(rng.choices(PARTS, k=rng.randrange(1, 14)))
        for scope in (0, 20, 400):
            want = brute_links(text, scope)
            assert sorted(secrets.linked_spans(text, secrets.base_spans(text), scope)) == want, text
            linked += len(want)
    assert linked > 1000


@pytest.mark.parametrize("body", ["12 " * 350_000, "1" * 1_000_000, "a" * 1_000_000, "@" * 1_000_000, "a@" * 500_000, "a.b." * 250_000, "ABCDEFGHIJ1234567890 " * 50_000, "host" * 250_000, ("host" + " " * 30) * 30_000, "password=" * 110_000])
def test_time_grows_with_the_text(body):
    text = f"login=abcd http://x.org a@b.cd password=hunter2 {body}"
    began = time.process_time()
    secrets.scan_text(text)
    assert time.process_time() - began < 5


def test_capital_tokens_are_not_mixed():
    assert [k for _, k, _ in secrets.scan_text("login=abcd http://x.org ABCDEFGHIJ1234567890ABCD and more")] == []
