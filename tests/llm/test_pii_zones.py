"""Entities with few digits or with only their dots spelled out have zones, whatever else the text holds."""

import pytest
from freightlens.llm import pii


@pytest.mark.parametrize("text", ["192[.]0[.]2[.]1", "10[.]0[.]0[.]1", "8[.]8[.]8[.]8", "8 . 8 . 4 . 4"])
def test_ips_of_few_digits(text):
    _, spans = pii.find(f"see {text} now", pii.train())
    assert spans == [("ip", 4, 4 + len(text))]


@pytest.mark.parametrize("text", ["jane at example [dot] com", "jane at example (dot) com", "jane at example dot com", "jane (at) example.com"])
@pytest.mark.parametrize("after", ["", " and a dot here", " (at) last"])
def test_spelled_addresses(text, after):
    _, spans = pii.find(text + after, pii.train())
    assert spans == [("email", 0, len(text))]


@pytest.mark.parametrize("after", ["", " and a dot here", " (at) last"])
def test_prose_is_no_address(after):
    assert pii.zones("meet at noon. then go" + after) == []
