"""Base spans against the contract's patterns as they are written, and zones of any length."""

import random
import re

import pytest
from freightlens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    alphabets = ["a.@-1 ", "0123456789.", "0123456789 -", "+0123456789 ().-", "ab@c.d-e%_+1 \n"]
    hits = 0
    for i in range(20_000):
        text = "".join(r.choice(alphabets[i % 5]) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text
        hits += bool(plain(text))
    assert hits > 1000


@pytest.mark.parametrize("name", ["n" * 90, "first." + "l" * 200])
@pytest.mark.parametrize("form", ["{} (at) example (dot) com", "{} [at] example.com", "{} at example dot com"])
def test_long_names_are_whole(name, form):
    text = form.format(name)
    assert pii.find("see " + text + " now", pii.train())[1] == [("email", 4, 4 + len(text))]


def test_zones_take_linear_time():
    assert pii.zones("x" * 300_000 + " at y") == [] and len(pii.zones("w" * 200_000 + "(at)host.com")) == 1
