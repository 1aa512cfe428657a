"""Removal of repeats where rows share an id, have none, or are equal."""

import hashlib
import random

from freightlens.llm import suffix_merge


def plain(rows):
    """Kept bytes of each distinct (id, text); ids in order, null last, then by MD5 of the text."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for doc, text in order:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for at in range(len(body) - 99):
            if body[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(body[at : at + 100])
        out[doc, text] = bytes(c for c, g in zip(body, gone, strict=True) if not g)
    return out


def test_rows_that_share_an_id(spark):
    r = random.Random(17)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = make(130)
    rows = [(None if i % 3 else 7, make(50) + (shared if i % 2 else "") + make(40)) for i in range(120)]
    rows += rows[:20] + [(5, shared), ((1 << 63) - 1, "end " + shared), ((1 << 63) - 1, None), (None, None), (None, "")]
    want = plain(rows)
    found = suffix_merge.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((str(x.doc_id), bytes(x.kept)) for x in found) == sorted((str(d), want[d, t]) for d, t in rows)
    assert sum(x.n_removed for x in found) > 50 * 100


def test_the_largest_id_stays(spark):
    docs = spark.createDataFrame([((1 << 63) - 1, "x"), (1, "y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in suffix_merge.remove_repeats(docs).collect()) == [1, (1 << 63) - 1]


def test_the_texts_are_shuffled_once(spark, capsys):
    shared = "the same passage in all of them " * 5
    rows = [(None if i == 3 else i, f"{i} {shared}") for i in range(8)]
    found = suffix_merge.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    want = plain(rows)
    assert sorted((str(x.doc_id), bytes(x.kept)) for x in found.collect()) == sorted((str(d), want[d, t]) for d, t in rows)
    capsys.readouterr()
    found.explain("simple")
    assert any("ReusedExchange" in line and "body#" in line for line in capsys.readouterr().out.splitlines())
