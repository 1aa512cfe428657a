"""Language identification by cross-parsing against suffix automata.

For each learned language, a suffix automaton over labelled text tells the
longest match at any place in time linear in the match. A document is parsed
greedily into longest matches; the language whose text needs the fewest phrases
for each character explains it best. Phrases stay within a word and its
two blanks, so a word's phrases are counted once for each language and
remembered while a worker lives.

The labelled text is a bounded sample: of each language ``DOCS_PER_LANG`` documents, of each the first
``LONGEST_DOC`` characters, of which ``CHARS_PER_LANG`` enter the automaton (fewer if there
are many languages: each gets an equal share of ``CHARS_IN_ALL``). An automaton of n characters has
less than 2n states and 3n edges, held in arrays of 4 bytes an edge or state and 4 more an
edge for its character, so all together take at most 40 bytes a character, 60 MB, whatever the alphabets. The words that a
worker remembers take another ``BYTES_KEPT``, fewer words the more languages there are.
``MOST_LANGS`` bounds the number of languages, the most frequent ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_crc32, table, worker_memory

DOCS_PER_LANG = 64
LONGEST_DOC = 20_000
CHARS_PER_LANG = 60_000
#: All automata together hold so many characters at most.
CHARS_IN_ALL = 1_500_000
#: Languages that are learned, the most frequent ones: each has a share of 150 characters at least.
MOST_LANGS = 10_000
UNKNOWN = "und"
#: Bytes of the words that a worker remembers, their counts for all languages included; longer words than LONGEST_KEPT are parsed each time.
BYTES_KEPT = 60_000_000
LONGEST_KEPT = 64
#: How fast the score falls with every phrase more.
SHARPNESS = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_FIELD = 48


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    text = text.lower()
    words = _WORD.findall(text)
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # signs of number that aren't decimal digits (as one half or Roman numerals) are word characters, but no letters
    return [own for word in words for own in ("".join(c if c.isalpha() else " " for c in word).split() if not word.isalpha() else (word,))]


class SuffixAutomaton:
    """All substrings of a text, as states whose edges (a letter and a state) stand together."""

    def __init__(self, text: str) -> None:
        link, length, ways = [-1], [0], [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            ways.append({})
            p = last
            while p >= 0 and c not in ways[p]:
                ways[p][c] = new
                p = link[p]
            if p >= 0:
                q = ways[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    ways.append(dict(ways[q]))
                    while p >= 0 and ways[p].get(c) == q:
                        ways[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        letters: list[str] = []
        self.first, self.to = array("i", [0]), array("i")
        for out in ways:  # a state's edges stand together
            letters.extend(out)
            self.to.extend(out.values())
            self.first.append(len(self.to))
        self.letters = "".join(letters)

    def plain(self) -> tuple:
        """The automaton in built-in types."""
        return self.first, self.letters, self.to

    @classmethod
    def of(cls, parts: tuple) -> SuffixAutomaton:
        """An automaton from its parts."""
        made = cls.__new__(cls)
        made.first, made.letters, made.to = parts
        return made

    def phrases(self, text: str) -> int:
        """Longest matches that a greedy parse of ``text`` takes; a character never seen is one."""
        first, find, ways = self.first, self.letters.find, self.to
        count, state, top = 0, 0, first[1]
        for c in text:
            at = find(c, first[state], first[state + 1])
            if at < 0:
                count += state > 0
                at = find(c, 0, top)  # every known character has an edge from the beginning
                if at < 0:
                    count += 1
                    state = 0
                    continue
            state = ways[at]
        return count + (state > 0)


class Model:
    """The automata of all learned languages, by name."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[name]) for name in self.langs]
        self.name = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()

    def plain(self) -> tuple:
        """The model in built-in types, for a broadcast."""
        return self.name, self.langs, [a.plain() for a in self.automata]

    @classmethod
    def of(cls, plain: tuple) -> Model:
        """A model from its parts."""
        made = cls.__new__(cls)
        made.name, made.langs = plain[0], plain[1]
        made.automata = [SuffixAutomaton.of(parts) for parts in plain[2]]
        return made

    def packed(self, word: str) -> int:
        """The word's phrases for every language, each in a field of its own of one number."""
        padded = f" {word} "
        return sum(a.phrases(padded) << (_FIELD * i) for i, a in enumerate(self.automata))


class Counts(dict):
    """Packed phrase counts by word, made when first asked for."""

    def __init__(self, model: Model, bytes_kept: int = BYTES_KEPT) -> None:
        self.model = model
        self.most = max(1, bytes_kept // (300 + len(model.langs) * _FIELD // 8))

    def __missing__(self, word: str) -> int:
        found = self.model.packed(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def predict(text: str | None, counts: Counts) -> tuple[str, float]:
    """The language with the fewest phrases and its share of exp(-sharpness * phrases); ties: the first name."""
    words = words_of(text) if text else []
    langs = counts.model.langs
    if not words or not langs:
        return UNKNOWN, 0.0
    total = sum(map(counts.__getitem__, words))
    field = (1 << _FIELD) - 1
    phrases = [total >> (_FIELD * i) & field for i in range(len(langs))]
    least = min(phrases)
    return langs[phrases.index(least)], 1 / sum(math.exp(-SHARPNESS * min(p - least, 1400)) for p in phrases)


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, longest: int = LONGEST_DOC, chars: int = CHARS_PER_LANG, most_langs: int = MOST_LANGS) -> Model:
    """Learn from rows with a text and a language whose crc32(doc_id as text) mod 3 isn't 1.

    For each language the documents with the smallest hash of their id are taken, ``per_lang`` at most and until
    twice the language's share of characters is there (what isn't a letter doesn't count in the end). Rows far beyond
    these are sifted out by the hash before any sort, so the sort handles a few times ``per_lang``
    rows, not the corpus. The driver gets 2 * CHARS_IN_ALL characters and one document a language at most.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & (F.coalesce(id_crc32() % 3, F.lit(0)) != 1) & (F.length("text") > 0)
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    found = counts.collect()  # at most ``most_langs`` rows
    share = min(chars, CHARS_IN_ALL // max(1, len(found)))
    names = docs.sparkSession.createDataFrame([tuple(r) for r in found], "lang string, n long")
    near = known.join(F.broadcast(names), "lang").where(place < F.lit(float(8 * per_lang * (1 << 31))) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    rows = (
        near.withColumn("text", F.substring("text", 1, min(longest, 2 * share))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < 2 * share).select("lang", "text", "rank").collect()
    )
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        texts.setdefault(row["lang"], []).extend(words_of(row["text"]))
    return Model({lang: f" {' '.join(words)} "[: share + 1] for lang, words in texts.items() if words})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (``doc_id``, ``text``).

    A null text or one without a letter is ``und`` with score 0, and so is every
    text if no language was learned. Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded by the number of languages and the sample

    name = model.name

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory()
        if memory.get("languages", ("",))[0] != name:
            memory["languages"] = (name, Counts(Model.of(held.value)))
        counts = memory["languages"][1]
        for batch in batches:
            found = [predict(t.as_py(), counts) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: language of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc32() % 3 == 1, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
