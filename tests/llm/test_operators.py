"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freightlens.llm import banding, components, decontaminate, edit_embedding, language_id, licenses, packing, pii, quality, queries, sharding, simhash_bk, suffix_merge


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 licenses


def test_license_alignment_survives_edits_and_finds_spans(spark):
    text = "word " * 30 + "Licensed UNDER the truly Apache license, version 2.0!" + " tail" * 10 + "\nAll rights reserved. All rights reserved."
    docs = spark.createDataFrame([(1, text), (2, "license and apache and version, in no order")], "doc_id long, text string")
    rows = licenses.scan_licenses(docs).orderBy("start").collect()
    assert [r.license for r in rows] == ["apache-2.0", "all-rights-reserved", "all-rights-reserved"]
    assert text[rows[0].start : rows[0].end].startswith("Licensed") and rows[0].coverage == 1.0


def test_license_lines_of_the_corpus(spark, sf_dir, corpus):
    want = sum(t.lower().count(line) for _, t in texts_of(corpus) for line in ("licensed under the apache license, version 2.0", "released under the mit license", "all rights reserved", "licensed under cc by-nc 4.0", "gnu general public license, version 3"))
    assert licenses.op1(spark, sf_dir).count() == want


def test_winnowing_covers_every_window():
    r = random.Random(1)
    hashes = np.array([r.randrange(50) for _ in range(200)], dtype=np.uint64)
    kept = licenses.winnow(hashes)
    assert all(any(s <= k < s + licenses.WINDOW for k in kept) for s in range(200 - licenses.WINDOW + 1))


# 2 fingerprints


def test_edited_texts_by_brute_force(spark, sf_dir, corpus):
    docs = sorted(texts_of(corpus), reverse=True)
    found = {r.doc_id: r for r in edit_embedding.op2(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for i, (doc, text) in enumerate(docs):
        after, third = docs[(i + 1) % len(docs)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = found[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == edit_embedding.fingerprint(text) and row.edited_fingerprint == edit_embedding.fingerprint(edited)
        assert row.near_edited == edit_embedding.likeness(row.fingerprint, row.edited_fingerprint) and row.near_next == edit_embedding.likeness(row.fingerprint, edit_embedding.fingerprint(after))
    assert np.mean([r.near_edited for r in found.values()]) > 0.5 > 0.1 > np.mean([r.near_next for r in found.values()])


def test_likeness_falls_with_edits():
    r = random.Random(5)
    base = [r.choice("abcdefgh ") for _ in range(3000)]
    means = []
    for edits in (0, 2, 20, 400):
        values = []
        for _ in range(12):
            text = list(base)
            for _ in range(edits):
                at = r.randrange(len(text))
                text[at : at + 1] = r.choice([[], ["x"], ["x", text[at]]])
            values.append(edit_embedding.likeness(edit_embedding.fingerprint("".join(base)), edit_embedding.fingerprint("".join(text))))
        means.append(np.mean(values))
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3] and means[3] < 0.3
    assert edit_embedding.likeness("0.", edit_embedding.fingerprint("a")) == 0 and edit_embedding.likeness("0.", "0.") == 1


def test_near_groups(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:-5] + "other") for i, t in enumerate(base)] + [(20, base[0]), (21, None), (22, "")]
    found = {x.doc_id: x.component_id for x in edit_embedding.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in range(6)}, **{10 + i: i for i in range(6)}, 20: 0, 21: 21, 22: 21}


@pytest.mark.parametrize("part", [1, 3, 2_000_000])
def test_crowded_bands_lose_no_link(spark, monkeypatch, part):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh ") for _ in range(1500)) for _ in range(4)]
    texts = [t[:at] + "xyz" + t[at:] for t in base for at in r.sample(range(1500), 12)]
    marks = [edit_embedding.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:i]):
            if set(edit_embedding.bands(a)) & set(edit_embedding.bands(b)) and edit_embedding.likeness(a, b) >= edit_embedding.LIKENESS:
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if x == old else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(banding, "PART_SIZE", part)
    found = {x.doc_id: x.component_id for x in edit_embedding.near_groups(docs).collect()}
    assert found == dict(enumerate(root))
    assert 4 <= len(set(root)) < len(texts) / 2


def plain_written(text):
    """What the walk writes, step by step: the place of the text that is read at each step."""
    coins = np.random.default_rng(edit_embedding.SEED).random((edit_embedding.CLASSES, edit_embedding.PHASES)) < 0.5
    coins[:, -1] |= ~coins.any(axis=1)
    out, at, step = [], 0, 0
    while at < len(text):
        out.append(at)
        at += int(coins[ord(text[at]) % edit_embedding.CLASSES, step % edit_embedding.PHASES])
        step += 1
    return out


def test_walk_step_by_step():
    r = random.Random(10)
    for n in (1, 2, 30, 700):
        text = "".join(r.choice("abcdé 漢\n") for _ in range(n))
        written = plain_written(text)
        length, samples = edit_embedding.fingerprint(text).split(".")
        assert int(length, 16) == len(written)
        codes = [ord(c) for c in text]
        for i, spot in enumerate(edit_embedding.places(len(written))[0].tolist()):
            mixed = 0
            for step in range(edit_embedding.GRAM):
                mixed = (mixed ^ codes[min(written[spot] + step, n - 1)]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                mixed ^= mixed >> 29
            assert samples[4 * i : 4 * i + 4] == f"{mixed >> 48:04x}"


def edit_distance_at_most(a, b, most):
    """Edit distance by a band of diagonals, or most + 1 if it's more."""
    row = {j: j for j in range(most + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j - 1, most + 1) + (a[i - 1] != b[j - 1]), row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1)
        row = new
    return min(row.get(len(b), most + 1), most + 1)


def test_recall_against_edit_distance(spark):
    """Texts within 1 edit in 400 characters are grouped in at least 0.9 of cases, unrelated texts never."""
    r = random.Random(12)
    rows, pairs = [], []
    for i in range(80):
        text = "".join(r.choice("abcdefghij ") for _ in range(r.randint(400, 2400)))
        other = list(text)
        for _ in range(r.randint(1, len(text) // 400)):
            at = r.randrange(len(other))
            other[at : at + 1] = r.choice([[], ["x"], [other[at], "x"]])
        rows += [(2 * i, text), (2 * i + 1, "".join(other))]
        if edit_distance_at_most(text, "".join(other), len(text) // 400) <= len(text) // 400:
            pairs.append((2 * i, 2 * i + 1))
    found = {x.doc_id: x.component_id for x in edit_embedding.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(found[a] == found[b] for a, b in pairs) / len(pairs)
    assert len(pairs) > 60 and recall >= 0.9, recall
    assert all(found[d] in (d, d - d % 2) for d in found)


def test_components_reach_rows_that_share_an_id(spark):
    a, b = "some text " * 40, "quite another one " * 40
    docs = spark.createDataFrame([(3, a), (3, b), (9, b), (None, a), (1, a + "x"), (None, None), (4, "")], "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_chars, str(r.component_id)) for r in edit_embedding.compare_edited(docs).collect())
    assert found == sorted([("3", 400, "1"), ("3", 720, "3"), ("9", 720, "3"), ("None", 400, "1"), ("1", 401, "1"), ("None", 0, "4"), ("4", 0, "4")])


# 3 quality


def test_marginals_by_enumeration():
    r = np.random.default_rng(2)
    sizes = np.array([1, 4, 3])
    good, moves = r.normal(size=8), r.normal(size=(2, 2))
    p, pairs, log_z = quality.marginals(good, moves, sizes)
    at, want, want_pairs, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        weights = {}
        for labels in np.ndindex(*[2] * n):
            weights[labels] = np.exp(sum(good[at + i] for i in range(n) if labels[i]) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        want_z += np.log(z)
        at += n
    assert p == pytest.approx(want) and pairs == pytest.approx(want_pairs) and log_z == pytest.approx(want_z)


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.op3(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_line_features_do_not_depend_on_company():
    texts = ["one two\nthree", "", "x!! y!!\n\nz", "the the the the", "é ü"]
    alone = [quality.line_features([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), quality.line_features(texts)[0])


# 4 decontamination


def plain_distances(pattern, text):
    row, out = list(range(len(pattern) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (p != c)))
        row = new
        out.append(row[-1])
    return out


def test_bit_parallel_distance():
    r = random.Random(4)
    for _ in range(200):
        pattern, text = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 80))) for _ in range(2))
        assert decontaminate.distances(pattern, text) == plain_distances(pattern, text)


def test_passages_within_the_budget_are_found_and_others_not(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 40)))) for i in range(20)]
    docs, want = [], {}
    for i, text in items:
        for more in (0, 1):
            edited = list(text)
            for at in r.sample(range(len(text)), decontaminate.budget(len(text)) if more == 0 else len(text) // 3):
                edited[at] = "z"
            doc = len(docs)
            docs.append((doc, " ".join(word() for _ in range(50)) + " " + "".join(edited).upper() + "! " + " ".join(word() for _ in range(50))))
            if not more:
                want[doc] = i
    found = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in found} == want
    for row in found:
        own = decontaminate.fold(docs[row.doc_id][1][row.start : row.end])
        assert plain_distances(decontaminate.fold(items[row.item_id][1]), own)[-1] <= decontaminate.budget(len(decontaminate.fold(items[row.item_id][1]))) + 2


def test_blocks_of_items_change_nothing(spark, sf_dir, corpus):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {tuple(r) for r in decontaminate.find_passages(corpus, bench).collect()}
    assert whole and whole == {tuple(r) for r in decontaminate.find_passages(corpus, bench, block_bytes=2000).collect()}
    left = {r.doc_id for r in decontaminate.drop_contaminated(corpus, bench, block_bytes=2000).collect()}
    assert left == {d for d, _ in texts_of(corpus)} - {r[0] for r in whole}
    exact = {d for d, t in texts_of(corpus) for b in bench.collect() if decontaminate.fold(b.text) in decontaminate.fold(t)}
    assert exact <= {r[0] for r in whole}


# 5 packing


def test_ids_equal_the_tokenizers():
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    encode, r = packing.id_bytes(packing.TOKENIZER, 50), random.Random(9)
    letters = "aAbZ'sßÉéÀİǰΣσ̌́   　\t\r\x1c\x1f\x85 \n.,!?0123٣漢字🙂ﬁŸJ<|endoftext|>"
    for _ in range(2000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(spark, sf_dir, corpus):
    rows = packing.op5(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    for doc, text in texts_of(corpus):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for row in sorted(by_doc[doc], key=lambda x: x.start):
            assert (row.start, row.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + row.length].tobytes()) == row.ids_crc32
            at += row.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for row in sorted(own, key=lambda x: x.offset):
            assert row.offset == at
            at += row.length
        assert at <= 2048
    tokens = sum(r.length for r in rows)
    assert 1 - tokens / (2048 * len(by_sequence)) < 0.02


def test_pieces_and_their_ids(spark):
    docs = spark.createDataFrame([(1, "hello world " * 30), (2, None), (3, "x")], "doc_id long, text string")
    rows = packing.pack(docs, capacity=16, buckets=4, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 16 for r in rows)
    assert [r.length for r in rows if r.doc_id == 2] == [1]


def test_cut_points_fill_places():
    for n in range(1, 9000, 7):
        cut = packing.cut_points(n, 2048)
        assert sum(cut) == n and all(0 < c <= 2048 for c in cut)


# 6 SimHash


def plain_simhash(text):
    tokens = text.encode().lower().split() if text else []
    grams = [b" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] if len(tokens) > 2 else [b" ".join(tokens)] if tokens else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = simhash_bk.op6(spark, sf_dir).collect()
    texts = dict(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert all(int(r.fingerprint, 16) == plain_simhash(texts[r.doc_id]) for r in rows[:200])
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    group = {d: d for d in prints}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    order = sorted(prints)
    values = np.array([prints[d] for d in order], dtype=np.uint64)
    for i in range(len(order)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = root(order[i]), root(order[i + 1 + int(j)])
            group[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in rows} == {d: root(d) for d in order}


def test_simhash_agrees_with_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(simhash_bk.simhash("A  b\tc")).astype(np.int64)


def test_shards_link_all_near_values(spark):
    r = random.Random(11)
    values = {r.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:
        values.add(v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    pairs = simhash_bk.links(spark.createDataFrame(signed, "fp long"))
    label = {r.node: r.label for r in components.components(pairs).collect()}
    for (a,), (b,) in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            assert label[a] == label[b]


def test_bk_tree_search():
    r = random.Random(12)
    tree, values = simhash_bk.BKTree(), list({r.getrandbits(12) for _ in range(300)})
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.values[i] for i in tree.within(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)]
    label = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert label == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, "quite another text here"), (2, "quite another text here"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash_bk.drop_near_duplicates(docs).collect()) == ["1", "2", "None"]


# 7 repeats


def plain_repeats(docs):
    first, out = {}, {}
    for doc, text in sorted(docs):
        body = text.encode()
        for at in range(len(body) - 99):
            first.setdefault(body[at : at + 100], (doc, at))
    for doc, text in docs:
        body = text.encode()
        gone = np.zeros(len(body) + 1, bool)
        for at in range(len(body) - 99):
            if first[body[at : at + 100]] < (doc, at):
                gone[at : at + 100] = True
        kept = np.frombuffer(body, np.uint8)[~gone[:-1]].tobytes()
        out[doc] = (len(body), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeats_by_brute_force(spark, monkeypatch, crowd):
    r = random.Random(13)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    passages = [make(r.randint(90, 400), "abcdé \n") for _ in range(12)]
    docs = [(i, "".join(r.choice([make(r.randint(1, 200), "abcd é"), r.choice(passages), r.choice(passages)[:120], "ab" * 90]) for _ in range(r.randint(0, 8)))) for i in range(80)]
    docs += [(100 + i, t) for i, t in docs[:15]] + [(200 + i, t[:50] + "Q" + t[51:]) for i, t in docs[:15]]
    monkeypatch.setattr(suffix_merge, "GROUP_SEGMENTS", crowd)
    monkeypatch.setattr(suffix_merge, "BATCH_BYTES", 3000)
    rows = suffix_merge.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain_repeats(docs)
    texts = dict(docs)
    for row in rows:
        body = texts[row.doc_id].encode()
        assert sum(b - a for a, b in row.spans) == row.n_removed and len(row.kept) == len(body) - row.n_removed


def test_long_texts_are_cut_into_pieces(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 101, 3000).astype(np.uint8)
    monkeypatch.setattr(suffix_merge, "PIECE", 700)
    _, _, first, counts = suffix_merge.segments(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + counts[:-1]).all() and first[-1] + counts[-1] == len(data) - 99


def test_merged_transforms_equal_sorted_suffixes():
    r = random.Random(14)
    strings = list({bytes(r.choice(b"ab") for _ in range(r.randint(100, 140))) for _ in range(40)})
    counts = [len(s) - 99 for s in strings]
    ranks = np.arange(len(strings), dtype=np.int64) * 1000
    first, want = {}, []
    for i, s in enumerate(strings):
        for j in range(counts[i]):
            first.setdefault(s[j : j + 100], (i, j))
    for i, s in enumerate(strings):
        want.append([first[s[j : j + 100]] < (i, j) for j in range(counts[i])])
    assert [x.tolist() for x in suffix_merge.repeated_windows(strings, counts, ranks)] == want


# 8 personal data


def test_base_patterns(spark):
    text = "a.b@c.d.e, 300.1.1.1; 1.2.3.4; 4111 1111-1111 1111, 4111111111111112, +1 (555) 123-4567; +12 x@y 1.2.3.4.5"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [
        ("email", "a.b@c.d.e"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 123-4567"),
    ]
    rows = pii.detect(spark.createDataFrame([(1, "mail ann@b.co"), (2, None), (3, "host 10.0.0.256 or 10.0.0.255")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.base) for r in rows] == [(1, 0, "email:5:13"), (0, 0, ""), (0, 1, "ip:19:29")]


def test_ip_parts_with_very_many_zeros():
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}7.1.2.3 and 1.2.3.{zeros}256") == [("ip", 0, 6007)]


def test_field_on_fresh_examples():
    weights = pii.train()
    right = total = 0
    for text, spans in pii.examples(300, seed=99):
        got = [x for s, e in pii.zones(text) for x in pii.decode(weights, text, s, e)]
        right, total = right + (sorted(got) == sorted(spans)), total + 1
    assert right / total > 0.94


def test_base_spans_stay_and_added_ones_do_not_overlap(corpus):
    weights = pii.train()
    for _, text in texts_of(corpus):
        base, spans = pii.find(text, weights)
        assert set(base) <= set(spans)
        for kind, s, e in set(spans) - set(base):
            assert all(e <= a or b <= s for _, a, b in base), kind


def test_decoding_is_the_best_segmentation():
    weights = pii.train()
    text = "+1 (555) 123-4567 10.0.0.1"
    edges, found = pii.segments(text, 0, len(text))
    score = {}
    for i, j, names in found:
        score[i, j] = max(sum(weights.get(n, [0] * 4)[k] for n in names) for k in range(4))

    def best(at):
        if at == len(edges) - 1:
            return 0.0
        return max([best(at + 1)] + [v + best(j) for (i, j), v in score.items() if i == at])

    where = {e: n for n, e in enumerate(edges)}
    got = sum(score[where[s], where[e]] for _, s, e in pii.decode(weights, text, 0, len(text)))
    assert got == pytest.approx(best(0))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to ann@b.co now", 15), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "to [EMAIL] now", 14), (2, None, None)]


# 9 language


def test_automaton_finds_longest_matches():
    r = random.Random(15)
    for _ in range(50):
        text, other = ("".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(2))
        count = at = 0
        while at < len(other):
            step = next((k for k in range(len(other) - at, 0, -1) if other[at : at + k] in text), 1)
            at, count = at + step, count + 1
        assert language_id.SuffixAutomaton(text).phrases(other) == count


def test_language_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in language_id.op9(spark, sf_dir).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97


# 10 shards


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_by_brute_force(spark, sf_dir, corpus):
    texts, slots = dict(texts_of(corpus)), {}
    for r in sharding.op10(spark, sf_dir).collect():
        key, body = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), texts[r.doc_id].encode()
        assert (r.shard, r.grown_shard) == (plain_jump(key, 24), plain_jump(key, 25)) and r.grown_shard in (r.shard, 24)
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_sharding_runs_no_python(spark, sf_dir):
    plan = sharding.op10(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
