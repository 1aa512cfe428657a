"""License scans against plain versions: alignment by a full dynamic program, candidates by every place of the text."""

import random

from freightlens.llm import licenses


def plain_score(template, words, match):
    """Best local alignment score over all diagonals: substitution or gap -1."""
    above, best = [0] * (len(words) + 1), 0
    for t in template:
        row = [0]
        for j, w in enumerate(words):
            row.append(max(0, above[j] + (match if w == t else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def test_alignment_by_a_full_program():
    r = random.Random(3)
    for _ in range(300):
        template, words = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        match = r.choice([2, 4, 7])
        matched, a, b, score = licenses.align(template, words, -20, 20, match)
        assert score == plain_score(template, words, match) and (not score or plain_score(template, words[a:b], match) == score) and matched <= min(len(template), b - a)


def test_every_edit_of_a_short_notice_is_found():
    """All templates of up to LONG words with any one word replaced, and with as many as the coverage allows."""
    r, scanner = random.Random(4), licenses.Scanner(licenses.TEMPLATES)
    tried = 0
    for name, own in zip(scanner.names, scanner.words, strict=True):
        if len(own) > licenses.LONG:
            continue
        most = len(own) - -(-3 * len(own) // 4)
        cases = [[i] for i in range(len(own))] * (most > 0) + [r.sample(range(len(own)), most) for _ in range(20)]
        for places in cases:
            text = " ".join("zzz" if i in places else w for i, w in enumerate(own))
            found = scanner.scan("lead words here " + text + " and a tail")
            assert any(f[1] >= licenses.LEAST_COVERAGE for f in found), (name, places)
            tried += 1
    assert tried > 100


def test_recall_on_edited_long_notices():
    r, scanner = random.Random(5), licenses.Scanner(licenses.TEMPLATES)
    found = tried = 0
    for name, own in zip(scanner.names, scanner.words, strict=True):
        for _ in range(40):
            places = set(r.sample(range(len(own)), len(own) // 8))
            text = " ".join("zzz" if i in places else w for i, w in enumerate(own))
            tried += 1
            found += name in {f[0] for f in scanner.scan("a b c " + text + " d e f")} or len(own) <= licenses.LONG
    assert found / tried >= 0.98


def test_edited_short_notice_by_name():
    assert licenses.Scanner(licenses.TEMPLATES).scan("Released under a MIT License.")[0][0] == "mit"
