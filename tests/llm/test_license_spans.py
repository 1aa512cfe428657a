"""Spans stand where the words do, also where lower-casing changes a text's length; openings are named as such."""

import pytest
from freightlens.llm import licenses


@pytest.mark.parametrize("text", ["İstanbul. All rights reserved.", "İstanbul İzmir. All rights reserved. one two three four"])
def test_spans_after_letters_that_grow(text):
    ((name, coverage, _, start, end),) = licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert (name, coverage, text[start:end]) == ("all-rights-reserved", 1.0, "All rights reserved")


def test_a_shared_opening_names_no_license():
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice"
    assert [hit[0] for hit in licenses.Scanner(licenses.TEMPLATES).scan(text)] == ["bsd-opening"]
