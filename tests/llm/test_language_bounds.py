"""Letters, large alphabets, many languages and long labelled texts."""

import random
import zlib

import pytest
from freightlens.llm import language_id


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ ٣ 七"[:4], "12 _ ?", "", None])
def test_texts_without_a_letter(text):
    model = language_id.Model({"a": " some words ", "b": " other text "})
    assert language_id.predict(text, language_id.Counts(model)) == ("und", 0.0)
    assert language_id.words_of("½x² naïve①七") == ["x", "naïve", "七"]


def test_large_alphabets_take_little_memory():
    r = random.Random(7)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(20_000))
    made = language_id.SuffixAutomaton(text)
    assert sum(a.itemsize * len(a) for a in (made.first, made.to)) + 4 * len(made.letters) <= 40 * len(text)
    assert made.phrases(text[500:700]) == 1 and made.phrases(text[500:600] + "x" + text[900:1000]) == 3


def test_many_languages_and_long_texts_are_learned(spark):
    r = random.Random(8)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:330]
    letters = {i: "".join(chr(0x400 + 2 * n + k) for k, n in enumerate(r.sample(range(300), 6))) for i in ids}
    rows = [(i, " ".join("".join(r.choice(letters[i]) for _ in range(6)) for _ in range(40)), f"l{i}") for i in ids]
    rows.append((ids[-1] + 1 if zlib.crc32(str(ids[-1] + 1).encode()) % 3 != 1 else ids[-1] + 2, "longlanguage " * 3000, "zz"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    want = {x[2] for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1}
    assert set(model.langs) == want and len(want) > 300
    if "zz" in want:
        assert language_id.predict("longlanguage", language_id.Counts(model))[0] == "zz"


def plain_prediction(text, model_texts):
    """Fewest longest matches by substring search over each word with its blanks."""
    counts = {}
    for lang, known in model_texts.items():
        n = 0
        for word in language_id.words_of(text):
            rest = f" {word} "
            while rest:
                step = next((k for k in range(len(rest), 0, -1) if rest[:k] in known), 1)
                n, rest = n + 1, rest[step:]
        counts[lang] = n
    least = min(counts.values())
    return min(lang for lang, n in counts.items() if n == least)


def test_predictions_by_substring_search():
    r = random.Random(9)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 6)))
    texts = {lang: " " + " ".join(word(s) for _ in range(200)) + " " for lang, s in (("a", "abcde"), ("b", "cdefg"), ("c", "aeglm"))}
    counts = language_id.Counts(language_id.Model(texts))
    for _ in range(60):
        text = " ".join(word("abcdefglmz") for _ in range(r.randint(1, 12)))
        assert language_id.predict(text, counts)[0] == plain_prediction(text, texts)
