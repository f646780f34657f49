"""Operators whose results a brute-force version can give, on small tables and on odd rows."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from terrane.llm import audio_media, chat_tree, decontaminate, license_scan, simhash, suffix_dedup
from tests.llm.conftest import DATA, documents


def test_license_scan(spark, small_rows, odd_rows):
    rows = small_rows + [(1000 + i, t) for i, t in odd_rows]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    want = {(d, n, b, f, last, x, y) for d, n, b, f, last, x, y in license_scan.brute_force(rows)}
    seen = set()
    for r in got:
        starts = [x.start for x in r.base]
        labels = {x.label for x in r.base}
        every = labels | {x.label for x in r.matches}
        seen.add((r.doc_id, r.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every))))
    assert seen == want and len(got) == len(rows)
    assert license_scan.scan_licenses(documents(spark, rows).limit(0)).count() == 0


def test_template_markup():
    scan = license_scan.Scanner({"t": 'a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> e <<var;name="x";words="1..2">> f'}, {})
    accepted = ["a b e x f", "a b c e x f", "a b c d e x y f", "q a b e f f"]
    refused = ["a b d e x f", "a b e f", "a b e x y z f", "a e x f", "b e x f"]
    for text in accepted:
        assert scan.scan(text.encode())[2], text
    for text in refused:
        assert not scan.scan(text.encode())[2], text
    for bad in ("<<beginOptional>>a", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", '<<var;name="x";words="1..2">> a'):
        with pytest.raises(ValueError):
            license_scan.Scanner({"t": bad}, {})


#: What each template must accept and refuse, written out by hand.
WORDINGS = {
    "apache-2.0-notice": (
        ["Licensed under the Apache License, Version 2.0 (the License)", "licensed under Apache License 2.0", "licensed under the apache license 2.0 today"],
        ["licensed under the apache license version 1.1", "under the apache license version 2.0", "licensed under the apache version 2.0"],
    ),
    "cc-by-notice": (
        ["This work is licensed under a CC BY 4.0 International License", "licensed under cc by license", "this fine work is licensed under CC-BY 3.0 license"],
        ["licensed under cc by one two three four five license", "licensed under cc nd license", "licensed by cc by license"],
    ),
    "cc-by-nc-4.0-notice": (["licensed under CC BY-NC 4.0", "Licensed under a cc-by-nc-sa 4.0 deed"], ["licensed under cc by 4.0", "licensed under a cc by nc nd 4.0", "licensed under cc by nc 3.0"]),
    "gpl-3.0-notice": (
        [
            "licensed under the GNU General Public License, version 3", "This program is licensed under the gnu general public license version 3 or any later version",
            "licensed under the gnu general public license version 3 or at your option any later version",
        ],
        ["licensed under the gnu general public license version 2", "under the gnu general public license version 3", "licensed under the gnu public license version 3"],
    ),
    "mit-notice": (["released under the MIT License", "under the terms of the MIT license.", "Released under the terms of the mit license"], ["the mit license", "under the terms of mit license", "under the terms the mit license"]),
    "mit-text": (
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."
        ],
        ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted"],
    ),
    "isc-text": (
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."
        ],
        ["Permission to use, copy, modify, and distribute this software for any purpose with fee is hereby granted"],
    ),
    "bsd-clause": (
        [
            f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:{one} Redistributions of source "
            "code must retain the above copyright notice, this list of conditions and the following disclaimer."
            for one in ("", " 1.")
        ],
        ["Redistribution and use in source forms, with or without modification, are permitted provided that the following conditions are met"],
    ),
}


def test_wordings_of_every_template(spark):
    assert set(WORDINGS) == set(license_scan.TEMPLATES)
    rows = [(label, good, text) for label, (yes, no) in WORDINGS.items() for good, texts in ((True, yes), (False, no)) for text in texts]
    docs = documents(spark, [(i, f"before it: {text} and after") for i, (_, _, text) in enumerate(rows)])
    found = {r.doc_id: {m.label for m in r.matches} for r in license_scan.scan_licenses(docs).collect()}
    for i, (label, good, text) in enumerate(rows):
        assert (label in found[i]) == good, (label, text)


def _groups(rows, fps):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash(spark, small_rows, odd_rows):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    near = []
    for i in range(40):  # a dense group: many fingerprints within a few bits of each other
        words = list(base)
        words[rng.randrange(400)] = f"w{i}"
        near.append((5000 + i, " ".join(words)))
    rows = small_rows + [(1000 + i, t) for i, t in odd_rows] + near + [(None, "one two three"), (None, None)]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    got = simhash.near_groups(documents(spark, rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in got) == _groups(rows, fps)
    assert simhash.near_groups(documents(spark, rows).limit(0)).count() == 0


def test_simhash_bits(spark):
    """The fingerprint by definition, with Spark's own hash; cutting long texts in pieces changes nothing."""
    text = "The quick brown Fox jumps over the lazy dog the quick brown fox"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s)").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    old = simhash.PIECE
    pieces = [w for p in simhash.word_pieces(text.encode(), 7) for w in p]
    assert pieces == [w.encode() for w in words] and old == simhash.PIECE


def test_star_links_are_exact(spark):
    """Distances of 0 to 4 around one value: links hold exactly up to 2, directly or through others."""
    centre = 0x0123456789ABCDEF
    values = [centre, centre ^ 0b11, centre ^ (0b111 << 60), centre ^ (1 << 63) ^ 1, centre ^ 0b1111000, 5, 7, 2**63]
    values += [centre ^ (1 << i) for i in range(10, 20)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    for a, b in edges:
        assert ((a ^ b) % 2**64).bit_count() <= 2
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert find(a) == find(b)


def test_near_copies_keep_the_unlike(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base.upper()), (3, base + " end"), (4, "other " + " ".join(f"x{i}" for i in range(50))), (5, ""), (6, ""), (None, base), (9, None)]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.without_near_copies(documents(spark, rows)).collect())
    assert kept == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert simhash.without_near_copies(documents(spark, rows).limit(0)).count() == 0


def test_near_copies_of_repeated_ids(spark):
    """Rows of one id are one document: they stay or go together, whatever else they hold."""
    base, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(2, base), (2, base), (3, base), (3, base), (1, other), (5, other + " end"), (5, other + " end"), (None, other)]
    kept = sorted((r.doc_id or 0) for r in simhash.without_near_copies(documents(spark, rows)).collect())
    assert kept == [0, 1, 2, 2]
    two = [(4, base), (4, other), (7, base), (8, other)]  # the id's text is one of the two
    kept = sorted(r.doc_id for r in simhash.without_near_copies(documents(spark, two)).collect())
    assert kept in ([4, 4, 7], [4, 4, 8])


def _first_of_groups(rows, least=0.8):
    """Least ids of the groups that likeness of all pairs connects."""
    parent = {d: d for d, _ in rows}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if simhash.jaccard((t or "").encode(), (u or "").encode(), 5) >= least:
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return {d for d in parent if find(d) == d}


@pytest.mark.parametrize("hot", [1, 16])
def test_near_copies_against_all_pairs(spark, small_rows, hot):
    """Pairs barely alike, and a large group of copies of one text: each like the original, or hardly, or not."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    rows = [r for r in small_rows]
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 300))]
        rows += [(10_000 + 10 * k + rng.choice([0, 5]), " ".join(base)), (10_000 + 10 * k + 2, " ".join(changed(base, max(1, len(base) // 80))))]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows += [(20_000 + i, " ".join(changed(base, i % 5))) for i in range(150)] + [(21_000, " ".join(base))]
    old, simhash.HOT = simhash.HOT, hot
    try:
        got = {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).select("doc_id").collect()}
    finally:
        simhash.HOT = old
    assert got == _first_of_groups(rows)


def test_near_copies_that_repeat_a_line(spark):
    """Likeness is over distinct shingles: how often a line is repeated decides the bits of SimHashes, not the likeness."""
    rng = random.Random(1)
    rows, apart = [], []
    for k, n in enumerate([10, 20, 40, 100] * 5):
        words, line = [[f"w{rng.randrange(10**6)}" for _ in range(m)] for m in (300, 7)]
        pair = [" ".join(words + line), " ".join(words + line * n)]
        apart.append(int.bit_count(simhash.fingerprint(pair[0].encode(), 5) ^ simhash.fingerprint(pair[1].encode(), 5)))
        rows += [(10 * k, pair[0]), (10 * k + 1, pair[1])]
    assert max(apart) > 24
    assert {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()} == _first_of_groups(rows) == set(range(0, 200, 10))


def test_near_copies_in_crowds(spark):
    """Links between two texts that are both unlike the head of a large group: a drifting chain, and pairs under one boilerplate."""
    rng = random.Random(3)

    def new(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows, words = [], new(200)
    for k in range(120):
        rows.append((1000 + rng.randrange(10**6) * 1000 + k, " ".join(words)))
        at = 5 * k % 200
        words = words[:at] + new(5) + words[at + 5 :]
    boilerplate = new(160)
    for k in range(100):
        own = new(40)
        rows += [(10**10 + 10 * k, " ".join(boilerplate + own)), (10**10 + 10 * k + 1, " ".join(boilerplate + own[:-8] + new(8)))]
    want = _first_of_groups(rows)
    assert len(want) == 101
    old, simhash.HOT = simhash.HOT, 1  # every shingle that is shared is hot
    try:
        one = {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).select("doc_id").collect()}
    finally:
        simhash.HOT = old
    assert one == want
    assert {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).select("doc_id").collect()} == want


def test_near_copies_from_one_pool(spark, monkeypatch):
    """Texts that share all their sentences with most others: what is compared grows with the texts, not with their square."""
    compared = []

    def counting(pairs, texts, shingle, least, real=simhash._compared):
        compared.append(pairs.count())
        return real(pairs, texts, shingle, least)

    monkeypatch.setattr(simhash, "_compared", counting)
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 14))) for _ in range(120)]
    rows = [(i, " ".join(s for s in pool if rng.random() < 0.7)) for i in range(800)]
    n = {}
    for size in (200, 400, 800):
        compared.clear()
        kept = {r.doc_id for r in simhash.without_near_copies(documents(spark, rows[:size])).select("doc_id").collect()}
        assert kept == set(range(size))
        n[size] = sum(compared)
    assert n[800] < 3 * n[400] < 9 * n[200] and n[800] < 800 * 799 / 2 / 20, n


def test_bands_miss_no_pair():
    """Bands that two sets share: as many as the chances say, in pairs as alike as the bound, and hardly any in unlike ones."""
    import numpy as np

    rng, bands = np.random.default_rng(4), simhash.band_count(0.8)
    assert (1 - 0.8**simhash.BAND_ROWS) ** bands <= simhash.MISS
    for likeness, low, high in ((0.8, 8, 60), (0.4, 0, 2)):
        shared = []
        for _ in range(40):
            both, size = round(500 * likeness), 500 - round(500 * likeness)
            tokens = rng.integers(0, 2**63, 500, dtype=np.uint64)
            one, other = tokens[: both + size // 2], np.append(tokens[:both], tokens[both + size // 2 :])
            shared.append(int((simhash.band_keys(one, bands) == simhash.band_keys(other, bands)).sum()))
        assert low <= min(shared) and np.mean(shared) <= high, (likeness, shared)


def test_parities_rule_out_no_alike_sets():
    """Sets differ in as many tokens as bits of their parities, or more."""
    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(300):
        tokens = np.unique(rng.integers(0, 2**64, rng.integers(1, 3000), dtype=np.uint64))
        one, other = (tokens[rng.random(len(tokens)) < 0.9] for _ in range(2))
        bits = np.bitwise_xor(simhash.parity_bits(one), simhash.parity_bits(other))
        assert sum(int(b).bit_count() if b >= 0 else (int(b) + 2**64).bit_count() for b in bits) <= len(np.setxor1d(one, other))


def test_decontamination(spark, small_rows, odd_rows):
    items = [tuple(r.values()) for r in pq.read_table(f"{DATA}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()]
    items += [(900, "one two"), (901, None), (902, "..."), (903, "One TWO"), (None, "a b c d e f g h i j"), (904, "word " * 30), (9, "a b c d e f g h i j k")]
    rows = small_rows + [(1000 + i, t) for i, t in odd_rows] + [(None, "one, two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(rows, items), key=str)
    for size in (decontaminate.BLOCK_BYTES, 2000):  # one block of the test side, and several
        found = decontaminate.find_matches(documents(spark, rows), bench, block_bytes=size).collect()
        got = []
        for r in found:
            hit = sum(r.ends) - sum(r.starts)
            got.append((r.doc_id, r.n_words, hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hit > 0))
            assert (r.longest > 0) == (hit > 0)
        assert sorted(got, key=str) == want
        clean = decontaminate.remove_contaminated(documents(spark, rows), bench, block_bytes=size)
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])
    clean = decontaminate.remove_contaminated(documents(spark, rows), bench)
    assert decontaminate.remove_contaminated(documents(spark, rows).limit(0), bench).count() == 0
    assert clean.columns == documents(spark, rows).columns
    assert decontaminate.find_matches(documents(spark, rows), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.find_matches(documents(spark, rows).limit(0), bench).count() == 0


def test_memory_of_a_test_block():
    """What is broadcast is a few times the block's text, also where items are many, short, or alike."""
    import pickle

    import pyarrow as pa

    rng = random.Random(2)
    prose = [" ".join(rng.choice(["the", "of", "window", "decontamination"]) + str(rng.randrange(10**4)) for _ in range(300)) for _ in range(400)]
    for texts in (prose, prose[:1] * 400, [t[:60] for t in prose * 5]):
        block = decontaminate.test_suffixes([f"item-{i}" for i in range(len(texts))], pa.array(texts), 10)
        assert len(pickle.dumps(block)) <= 5 * sum(map(len, texts)) + 64 * len(texts)


def test_longest_match(spark):
    """Also where windows of several items overlap, and the longer match does not begin the run."""
    item = " ".join(f"w{i}" for i in range(40))
    text = "before " + " ".join(f"w{i}" for i in range(5, 30)) + " after"
    other = "a0 a1 w5 w6 w7 w8 w9 w10 w11 w12"
    rows = [(1, text), (2, "x a0 a1 " + " ".join(f"w{i}" for i in range(5, 30)) + " a0"), (3, "w1 w2")]
    bench = spark.createDataFrame([(1, item), (2, other), (3, "w1")], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 100):
        found = {r.doc_id: r for r in decontaminate.find_matches(documents(spark, rows), bench, block_bytes=size).collect()}
        assert [(found[d].longest, found[d].starts, found[d].ends) for d in (1, 2, 3)] == [(25, [1], [26]), (25, [1], [28]), (1, [0], [1])]


def test_training_suffixes_are_in_order():
    import numpy as np

    rng = random.Random(8)
    codes = np.array([rng.choice([0, 5, 7, 9, 2**63 + 1]) for _ in range(400)] + [0], np.uint64)
    order = decontaminate.suffix_array(codes, 10)
    assert sorted(order) == list(range(len(codes)))

    def words(p):  # to the end of the text, ten at most
        out = []
        while codes[p] and len(out) < 10:
            out.append(int(codes[p]))
            p += 1
        return out

    rows = [words(p) for p in order]
    assert rows == sorted(rows)


def test_suffix_dedup(spark, small_rows, odd_rows):
    rows = small_rows + [(10_000 + i, t) for i, t in odd_rows if len(t or "") < 10_000]
    got = suffix_dedup.dedup_spans(documents(spark, rows)).collect()
    kept = sorted((r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert kept == sorted(suffix_dedup.brute_force(rows))
    assert suffix_dedup.dedup_spans(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 2, 2000])
def test_suffix_dedup_of_repetitive_texts(spark, hot):
    """Small alphabets, many overlaps, blocks of few documents, each way of meeting across blocks."""
    rng = random.Random(11)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 400))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 50) : rng.randint(50, 300)] for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(1000, "x" * 500), (1001, "x" * 300), (1002, "é" * 120), (1003, "aé" * 100), (1004, None)]
    got = suffix_dedup.dedup_spans(documents(spark, rows), width=40, gram=16, hot=hot, block_bytes=500).collect()
    kept = sorted((r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert kept == sorted(suffix_dedup.brute_force(rows, 40))


def test_suffix_dedup_of_rows(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(1, "first " + passage), (2, passage + " second"), (None, "third " + passage), (4, None)]
    docs = documents(spark, rows)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: "first " + passage, 2: " second", None: "third", 4: None}


def test_suffix_dedup_keeps_whole_characters(spark):
    """A cut within characters takes these as a whole and never makes new ones of what is left."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    # the bytes of the characters around the passage agree in part
    rows = [(1, "\u00e9" + passage + "\u00e9"), (2, "z\u0129" + passage + "\u00e8q"), (3, "\u0169" + passage + "\u4e2d"), (4, "\u6f22" + passage + "\u6f22!")]
    removed = {d: None for d, _ in rows}
    for r in suffix_dedup.dedup_spans(documents(spark, rows)).collect():
        removed[r.doc_id] = {i for a, b in zip(r.starts, r.ends, strict=True) for i in range(a, b)}
    want = {}
    for d, text in rows:
        at, kept = 0, ""
        for c in text:
            n = len(c.encode())
            kept += "" if removed[d] & set(range(at, at + n)) else c
            at += n
        want[d] = kept
    assert {r.doc_id: r.text for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()} == want
    assert want[2] == "zq"


def test_suffix_dedup_without_ids(spark):
    """Rows without an id are documents of their own, the last, in order of a hash; they are dealt to many blocks."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(None, f"{i} " * 30 + passage) for i in range(40)] + [(None, "same " * 30)] * 3 + [(None, None)] * 2 + [(5, "five " + passage)]
    got = suffix_dedup.dedup_spans(documents(spark, rows), block_bytes=500).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == len(rows) - 1
    kept = [bytes(r.kept).decode() for r in got]
    assert sum(passage in k for k in kept) == 1 and "five " + passage in kept
    order = spark.createDataFrame([(t or "",) for d, t in rows if d is None], "t string").selectExpr("t", "pmod(xxhash64(t), 4611686018427387904) as h").collect()
    numbered = [(0, "five " + passage)] + [(1 + r.h, r.t) for r in order]
    want = sorted(x[4] for x in suffix_dedup.brute_force(numbered))
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in got) == want


def test_deep_shallow_orders_suffixes():
    import numpy as np

    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(50)) + "abcabcabc" * 30
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(data))
    lengths = np.minimum(len(data) - starts, 90)
    tails = np.zeros((len(data), 2), np.uint8)
    tails[:, 0] = lengths
    order, named = suffix_dedup.deep_shallow(data, starts, lengths, tails)
    strings = [text[s : s + n] for s, n in zip(starts, lengths, strict=True)]
    assert [strings[i] for i in order] == sorted(strings)
    assert all((strings[i] == strings[j]) == (named[i] == named[j]) for i in range(0, len(data), 7) for j in range(len(data)))


def test_chat_trees(spark):
    rows = [(i, k, "user" if k % 2 == 0 else "assistant", f"t{k}-{(i >> max(0, 3 - k)) if k else 0}") for i in range(8) for k in range(1 + i % 4)]
    odd = "a\\b<|end|>\\N <<SYS>>[/INST]\n\\"
    rows += [(100, None, None, None), (101, 0, "assistant", odd), (101, 0, "assistant", odd), (102, 0, "us\ner<|turn|>", "x"), (None, 1, "user", ""), (None, 1, "assistant", "y"), (0, 1, "user", "")]
    rows += [(103, k, "assistant", f"turn {k}") for k in range(150)] + chat_tree.PLANTED
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rank", "2 as node", "3 as path")
    ranked = chat_tree.chained_turns(df)
    for vocabulary in (chat_tree.VOCABULARY, None):
        trees = chat_tree.prefix_trees(ranked, vocabulary)
        got = sorted((tuple(r)[:5] for r in chat_tree.read_back(ranked, trees, vocabulary).collect()), key=str)
        assert got == sorted(chat_tree.brute_force(rows), key=str)
    nodes = {bytes(r.node): r for r in trees.collect()}
    assert len(nodes) < sum(1 for _ in rows)  # shared turns are there once
    by_tree = {}
    for r in nodes.values():
        by_tree.setdefault(r.tree, []).append(r)
    for tree in by_tree.values():
        at, stack = 0, []
        for r in sorted(tree, key=lambda r: r.start):
            assert r.start == at
            at += len(r.tokens)
            while stack and (r.parent is None or stack[-1] != bytes(r.parent)):
                stack.pop()
            assert (r.parent is None) == (not stack)
            assert r.position == sum(len(nodes[s].tokens) for s in stack)
            seen = {p for i in r.attention for p in range(i.start, i.end)}
            assert seen == {p for s in stack for p in range(nodes[s].start, nodes[s].start + len(nodes[s].tokens))}
            stack.append(bytes(r.node))
    empty = chat_tree.chained_turns(df.limit(0))
    assert chat_tree.read_back(empty, chat_tree.prefix_trees(empty)).count() == 0


def test_long_texts_become_tokens():
    """Runs that the tokenizer's pattern could not take whole; each is decoded as it was."""
    ranks = chat_tree.read_vocabulary(chat_tree.VOCABULARY)
    assert chat_tree.read_vocabulary("/nowhere/at/all") is None and chat_tree.read_vocabulary(None) is None
    for tokenizer in (chat_tree.Tokenizer(ranks), chat_tree.Tokenizer(None)):
        for text in (" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "\u00e9" * 300_000, "a b  \n" * 300_000, "x" * 4096 + " y", ""):
            assert tokenizer.decode(tokenizer.encode(text)) == text
    whole = chat_tree.Tokenizer(ranks)
    assert whole.encode("some words " * 50) == whole.encoding.encode_ordinary("some words " * 50)


def test_chat_with_odd_tables(spark):
    """A conversation of very many turns, very long texts, and rows without ids: conversations of one turn each."""
    rows = [(1, k, "user", f"t{k % 7}") for k in range(3000)] + [(2, k, "user", f"t{k % 7}") for k in range(2000)]
    rows += [(None, 0, "user", "same")] * 50 + [(3, 0, None, " " * 1_500_000), (4, 0, "assistant", "\n" * 1_500_000)]
    turns = chat_tree.chained_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    trees = chat_tree.prefix_trees(turns)
    assert trees.count() == 3000 + 3
    got = sorted((tuple(r)[:5] for r in chat_tree.read_back(turns, trees).collect()), key=str)
    assert got == sorted(chat_tree.brute_force(rows), key=str)


@pytest.mark.parametrize("text", ["", "\\", "\\\\N", "<|turn|>user\nx<|end|>\n", "</s>[INST] ok [/INST]", "<\\s>", "a\nb", "<<SYS>>" * 3])
def test_escapes_are_reversible(text):
    assert chat_tree.unescape(chat_tree.escape(text)) == text
    assert not any(c in chat_tree.escape(text) for c in chat_tree.CONTROL)
    assert chat_tree.parse(chat_tree.format_turn(text, text) * 2) == [(text, text)] * 2


def test_media(spark, small_rows, odd_rows):
    rows = [r for r in small_rows if r[0] != 7] + odd_rows
    media = audio_media.to_media(documents(spark, rows))
    out = audio_media.analyse_media(media).collect()
    got = []
    for r in out:
        assert audio_media.from_wav(bytes(r.media)) == bytes(r.payload)
        got.append((r.doc_id, r.n_bytes, len(r.payload), hashlib.sha256(r.payload).hexdigest(), zlib.crc32(bytes(r.payload)[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest()))
        times = [x >> 32 for x in r.fingerprints]
        assert times == sorted(times)
    assert sorted(got) == sorted(audio_media.brute_force(rows))
    twins = [tuple(r)[1:] for r in out if r.doc_id == 7]
    assert len(twins) >= 2 and twins[-1] == twins[-2]
    assert media.limit(0).count() == 0


def test_fingerprints_in_stretches():
    payload = bytes((i * i * 31 + i // 7) % 251 for i in range(96 * 300))
    whole = audio_media.fingerprints(payload)
    old, audio_media.STRETCH = audio_media.STRETCH, 7
    try:
        assert (audio_media.fingerprints(payload) == whole).all() and len(whole)
    finally:
        audio_media.STRETCH = old


def _peak_pairs(payload):
    """Fingerprints by definition, frame by frame."""
    import numpy as np

    samples, frame, hop = np.frombuffer(payload, np.uint8), audio_media.FRAME, audio_media.HOP
    peaks = []
    for at in range(0, len(samples) - frame + 1, hop):
        power = np.abs(np.fft.rfft((samples[at : at + frame].astype(float) - 128) * np.hanning(frame))).round(3)
        power[:2] = 0
        tops = [k for k in range(1, len(power) - 1) if power[k] > 0 and power[k - 1] <= power[k] > power[k + 1]]
        peaks.append(sorted(tops, key=lambda k: (-power[k], k))[: audio_media.PEAKS])
    out = []
    for t, anchors in enumerate(peaks):
        for d in range(1, audio_media.AHEAD + 1):
            for a in anchors:
                out += [(t << 32) | (a << 20) | (b << 8) | d for b in (peaks[t + d] if t + d < len(peaks) else [])]
    return out


def test_peak_pairs_by_definition(small_rows):
    for _, text in small_rows[:60]:
        payload = audio_media.payload_of((text or "").encode())
        assert list(audio_media.fingerprints(payload)) == _peak_pairs(payload)


def test_columns_of_the_queries(spark, small_rows):
    """What the thin queries make of the operators' results: hex, digests, checksums, sums."""
    fps = [simhash.fingerprint((t or "").encode()) for _, t in small_rows]
    want = sorted((d, f"{fp:016x}", least) for d, fp, least in _groups(small_rows, fps))
    assert sorted(map(tuple, simhash.op2_simhash_near_dedup(spark, DATA).collect())) == want
    assert sorted(map(tuple, suffix_dedup.op7_suffix_dedup(spark, DATA).collect())) == sorted(suffix_dedup.brute_force(small_rows))
    got = audio_media.op9_media_columns(spark, DATA).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(audio_media.brute_force(small_rows))
    found = {r.doc_id: r.feature for r in got}
    rows = [(d, [int(x) for x in _peak_pairs(audio_media.payload_of((t or "").encode()))]) for d, t in small_rows[:60]]
    hashed = spark.createDataFrame(rows, "doc_id long, codes array<long>").selectExpr("doc_id", "size(codes) as n", "md5(array_join(cast(codes as array<string>), ',')) as h").collect()
    assert all(found[r.doc_id].split(":")[:2] == [str(r.n), r.h] for r in hashed)
    from terrane.llm import mixing

    mixed = mixing.op4_source_mixing(spark, DATA).collect()
    assert {(r.doc_id, r.size) for r in mixed} == {(d, len((t or "").split())) for d, t in small_rows}
