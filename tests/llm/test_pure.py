"""Operators' parts that need no session."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrel.llm import jaccard_join, language_id, license_scan, line_dedup, packing, progressive_jpeg, sentencepiece_lattice, topk, toxicity, url_filter


@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience_of_equal_sequences_is_whole():
    assert line_dedup.patience([1, 2, 2, 3], [1, 2, 2, 3]) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def _naive_kernel(s, t, n, lam):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@settings(deadline=None, max_examples=30)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_subsequence_kernel_matches_enumeration(s, t):
    assert toxicity.kernel([s], [t])[0, 0] == pytest.approx(_naive_kernel(s, t, toxicity.ORDER, toxicity.LAMBDA), rel=1e-4, abs=1e-6)
    assert toxicity._self_fast([s])[0] == pytest.approx(_naive_kernel(s, s, toxicity.ORDER, toxicity.LAMBDA), rel=1e-4, abs=1e-6)


def test_units_join_gapped_words_and_cut_long_ones():
    assert toxicity.units("You i d i o t and i.d-i*ot !!") == ["\x02you\x03", "\x02idiot\x03", "\x02and\x03", "\x02idiot\x03"]
    assert all(len(u) <= toxicity.WIDTH for u in toxicity.units("x" * 500))
    assert toxicity.text_units(None) == [] and toxicity.text_units("") == []


def _labelled():
    rng = np.random.default_rng(3)
    syl = ["th", "er", "on", "an", "re", "ed", "nd", "ha", "ing"]
    rows = []
    for i in range(240):
        words = ["".join(rng.choice(syl, rng.integers(1, 4))) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(40))] = ["idiot", "moron", "scumbag"][i // 4 % 3]
        rows.append((" ".join(words) + ".", int(bad)))
    return rows


def test_toxicity_on_held_out_rows_and_spoilt_insults():
    rows = _labelled()
    m = toxicity.fit_rows(rows[:160])
    s = toxicity.Scorer(m)
    said = toxicity.judge(s, [t for t, _ in rows[160:]])[2]
    truth = [bool(y) for _, y in rows[160:]]
    assert np.mean([a == b for a, b in zip(said, truth)]) > 0.95
    assert toxicity.judge(s, ["thon idioot anre", "thon i d i o t anre", "thon i-d-i-o-t anre"])[2] == [True] * 3
    assert toxicity.judge(s, [None, "", "?!", "thon anre"])[2] == [False] * 4
    assert toxicity.judge(toxicity.Scorer(toxicity.fit_rows([])), ["idiot"])[2] == [False]


def test_license_prefilter_never_hides_a_match_and_containment():
    s = license_scan.Scanner(license_scan.RULES)
    texts = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General\n * Public License, version 3.", "SPDX-License-Identifier: MIT", "see http://www.apache.org/licenses/LICENSE-2.0", "All rights reserved. Copyright 2020 Some One", "", "no law here", "Released under the MIT License. Distributed under the Boost Software License, Version 1.0"]
    for t in texts:
        every = license_scan.suppress([(m.start(), m.end(), r.priority, i) for i, r in enumerate(license_scan.RULES) for m in s.regex[i].finditer(t)])
        assert s(t) == every
    names = lambda t: [license_scan.RULES[x[3]].license for x in s(t)]
    assert names(texts[0]) == ["CC-BY-NC-4.0"] and names(texts[1]) == ["GPL-3.0"] and names(texts[2]) == ["MIT"] and names(texts[3]) == ["Apache-2.0"]
    assert s(None) == [] and len(license_scan.RULES) > 300
    assert license_scan.suppress([(0, 9, 5, 0), (2, 5, 9, 1), (8, 12, 5, 2)]) == [(2, 5, 9, 1), (8, 12, 5, 2)]


def _sample(tree, rng):
    """A text that a parsed pattern may match (look-arounds apart), with the longest gaps at random."""
    out = []
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out.append(chr(arg))
            case "ANY" | "NOT_LITERAL":
                out.append("x")
            case "IN":
                out.append(rng.choice([x for o, a in arg for x in ([chr(a)] if str(o) == "LITERAL" else [chr(a[0]), chr(a[1])] if str(o) == "RANGE" else [{"CATEGORY_SPACE": "\n", "CATEGORY_DIGIT": "7", "CATEGORY_WORD": "x"}.get(str(a), "x")] if str(o) == "CATEGORY" else ["x"])]))
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += [_sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2)))]
            case "SUBPATTERN":
                out.append(_sample(arg[3], rng))
            case "BRANCH":
                out.append(_sample(rng.choice(arg[1]), rng))
    return "".join(out)


def test_license_prefilter_passes_every_rule_on_wrapped_commented_texts():
    import random
    import re

    rng = random.Random(4)
    s = license_scan.Scanner(license_scan.RULES)
    gate = license_scan.roots(license_scan.RULES)
    for i, rule in enumerate(license_scan.RULES):
        tree, seen = re._parser.parse(rule.pattern, re.IGNORECASE), 0
        for _ in range(12):
            t = "\n" + _sample(tree, rng) + "\n"
            if not s.regex[i].search(t):
                continue
            seen += 1
            words = {k for _, k in s.auto.iter(t.lower())}
            assert any(k <= words for k in s.needs[i]) and any(k in t.lower() for k in gate), (rule.name, t)
        assert seen, rule.name
    for t, name in (("/* Permission is\n * hereby granted, free of charge, to any person\n * obtaining a copy.\n * THE SOFTWARE  IS\n * PROVIDED \"AS IS\" */", "MIT/text"), ("All rights\nreserved", "Proprietary/all-rights"), ("placed in the public\n# domain", "PublicDomain/dedication")):
        assert [license_scan.RULES[x[3]].name for x in s(t)] == [name]


@settings(deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_packing_keeps_every_piece_within_capacity(sizes):
    bins = packing.best_fit(sizes, 20)
    after = packing.local_search(sizes, [list(b) for b in bins], 20)
    assert sorted(i for b in after for i in b) == list(range(len(sizes)))
    fill = lambda bs: [sum(sizes[i] for i in b) for b in bs]
    assert all(f <= 20 for f in fill(after)) and len(after) <= len(bins)
    assert sum(f * f for f in fill(after)) >= sum(f * f for f in fill(bins))


def test_packing_search_empties_a_bin_that_best_fit_keeps():
    sizes = [6, 4, 4, 3, 3]  # capacity 10: two bins hold them all
    bins = [[0, 3], [1, 2], [4]]
    assert len(packing.local_search(sizes, bins, 10)) == 2


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 5))
def test_cascade_is_exact_on_its_universe(n_in, n_out, seed):
    rng = np.random.default_rng(seed)
    h1, h2 = rng.integers(-(2**63), 2**63 - 1, n_in + n_out), rng.integers(-(2**63), 2**63 - 1, n_in + n_out)
    listed = np.arange(n_in + n_out) < n_in
    levels = url_filter.build_levels(h1, h2, listed)
    assert (url_filter.probe(levels, h1, h2) == listed).all()


@pytest.mark.parametrize("h,w,sub", [(16, 16, True), (37, 51, True), (37, 51, False), (1, 1, True), (9, 8, False)])
def test_jpeg_round_trip(h, w, sub):
    y, x = np.mgrid[0:h, 0:w]
    img = np.stack([(x * 3) % 200 + 20, (y * 2) % 150 + 50, np.full_like(x, 90)], 2).astype(np.uint8)
    out = progressive_jpeg.decode(progressive_jpeg.encode(img, 1, sub))
    assert out.shape == img.shape and np.abs(out.astype(int) - img).mean() < (12 if sub else 2)


def test_jpeg_picture_of_a_vector_holds_all_values_in_several_mcus():
    v = np.linspace(-1, 1, 64)
    whole = progressive_jpeg.picture(v)
    assert whole.shape == (37, 45, 3) and progressive_jpeg.picture(v[:40]).shape == (16, 16, 3)
    for k in range(1, 63):
        w = v.copy()
        w[k] = -v[k]
        assert (progressive_jpeg.picture(w) != whole).any()
    out = progressive_jpeg.decode(progressive_jpeg.encode(whole))
    assert out.shape == whole.shape and np.abs(out.astype(int) - whole).mean() < 25


def test_jpeg_header_of_too_many_pixels_is_reported():
    data = bytearray(progressive_jpeg.encode(np.full((20, 20, 3), 100, np.uint8)))
    at = data.index(b"\xff\xc2") + 5
    data[at : at + 4] = b"\xff" * 4
    with pytest.raises(progressive_jpeg.Broken, match="too many pixels"):
        progressive_jpeg.decode(bytes(data))


def test_jpeg_damage_is_reported():
    data = progressive_jpeg.encode(np.full((20, 20, 3), 100, np.uint8))
    for bad in (b"", b"xx", data[:60], data[:-2], data[: len(data) // 2]):
        with pytest.raises((progressive_jpeg.Broken, IndexError)):
            progressive_jpeg.decode(bad)


TEXTS = ["The quick brown fox.", "", " ", "  two  spaces\n\ttab ", "Ω 漢字 😀 naïve", "x" * 300, "the▁bar", "anea onerthnd, Thandthe " * 30]


def test_bpe_units_and_merges_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    m = sentencepiece_lattice.load()
    sp = spm.SentencePieceProcessor(model_file=sentencepiece_lattice.DEFAULT_MODEL)
    for t in TEXTS:
        got = np.frombuffer(b"".join(m.merge(u) for u in m.units(t)), m.kind).tolist()
        assert got == sp.encode(t)
        assert "".join(m.units(t)) == ("▁" + t.replace(" ", "▁") if t else "")


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 12), max_size=20), max_size=8), st.lists(st.integers(0, 12), min_size=1, max_size=5), st.integers(1, 4))
def test_score_at_a_time_equals_full_scoring(docs, query, k):
    from collections import Counter

    counts = [Counter(d) for d in docs]
    starts = np.cumsum([0] + [len(c) for c in counts])
    terms = np.array([t for c in counts for t in c], int)
    weight = np.array([n * 2.2 / (n + 1.2) for c in counts for n in c.values()], float)
    idf = np.linspace(0.5, 3, 13)
    q = Counter(query)
    got = sorted(topk.Shard(np.arange(len(docs)), weight, starts, terms, idf).search(dict(q), k), key=lambda x: (-x[1], x[0]))[:k]
    full = [(i, round(sum(q[t] * idf[t] * n * 2.2 / (n + 1.2) for t, n in c.items() if t in q), 6)) for i, c in enumerate(counts)]
    assert got == sorted([x for x in full if x[1] > 0], key=lambda x: (-x[1], x[0]))[:k]


def test_topk_blocks_equal_single_queries():
    rng = np.random.default_rng(7)
    counts = [rng.choice(300, rng.integers(1, 120), replace=False) for _ in range(200)]
    counts[50] = counts[51]
    starts, terms = np.r_[0, np.cumsum([len(c) for c in counts])], np.concatenate([np.sort(c) for c in counts])
    weight, idf = rng.integers(1, 4, len(terms)) * 0.7, rng.random(300) + 0.01
    shard = topk.Shard(np.arange(200), weight, starts, terms, idf)
    ask = [np.unique(rng.integers(0, 300, n)) for n in (1, 40, 90, 200)]
    for k in (1, 10, 500):
        for t, got in zip(ask, shard.search_block([(t, idf[t]) for t in ask], k)):
            order = lambda x: sorted(x, key=lambda y: (-y[1], y[0]))
            assert order(got) == order(shard.search(dict.fromkeys(t.tolist(), 1), k))


def test_bpe_texts_cut_together_equal_texts_cut_alone():
    m = sentencepiece_lattice.load()
    for texts in (TEXTS, [], [""], ["", ""], ["a\uffffb", "c"], ["a\ufffeb", "", "c"], ["\n", "x\n\ny"], ["a b" * 40_000, "z", "b c" * 40_000, ""]):
        assert m.splits(texts) == [m.units(t) for t in texts]


def test_topk_short_query_scores_few_documents_exactly(monkeypatch):
    rng = np.random.default_rng(8)
    counts = [rng.choice(60, rng.integers(10, 50), replace=False) for _ in range(3000)]
    starts, terms = np.r_[0, np.cumsum([len(c) for c in counts])], np.concatenate([np.sort(c) for c in counts])
    weight, idf = rng.random(len(terms)) + 0.5, rng.random(60) + 0.5
    shard = topk.Shard(np.arange(3000), weight, starts, terms, idf)
    asked, exact = [], shard.exact
    monkeypatch.setattr(shard, "exact", lambda some, *rest: asked.append(len(some)) or exact(some, *rest))
    t = np.arange(20)
    got = sorted(shard.search(dict.fromkeys(t.tolist(), 2), 10), key=lambda x: (-x[1], x[0]))[:10]
    full = [(i, round(float(weight[a:e][on] @ (2 * idf[terms[a:e][on]])), 6)) for i, (a, e) in enumerate(zip(starts, starts[1:])) if (on := terms[a:e] < 20).any()]
    want = sorted(full, key=lambda x: (-x[1], x[0]))[:10]
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-6)
    assert asked[0] < 100


def test_topk_best_keeps_ties_and_rounding_errors():
    s = np.zeros((2, 2 * topk.GROUPS), np.float32)
    s[0, :40] = 5
    s[1, [3, 300, 301]] = 7, np.float32(7) * (1 - 2.0**-22), 6
    got = topk._best(s, np.array([8, 8]), 2)
    assert got[0].tolist() == list(range(40)) and got[1].tolist() == [3, 300]


def test_language_vectors_of_nothing():
    x, n = language_id.counts([None, "", "123 !!", "ab"])
    assert n.tolist() == [0, 0, 0, 2] and x[:3].sum() == 0


def test_grams_equal_plain_word_grams():
    import re

    texts = ["A b c d e", "", None, "one", "É ß x1 y_z  w", "a b c a b c a b c"]
    g, count = jaccard_join._sets(texts, 3)
    for t, n in zip(texts, count):
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        assert n == (len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0)


@given(st.sets(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.integers(0, 100))
def test_bitmaps_bound_the_overlap_from_above(a, b, common):
    both = set(range(common))
    x, y = (np.array(sorted(s | both), np.uint32) for s in (a, b))
    sx, sy = jaccard_join.signature(x), jaccard_join.signature(y)
    words = min(len(sx), len(sy))
    bound = (len(x) + len(y) - int(np.bitwise_count(jaccard_join._fold(sx, words) ^ jaccard_join._fold(sy, words)).sum())) // 2
    assert bound >= len(set(x.tolist()) & set(y.tolist())) == jaccard_join.overlap(x, y)


def test_jaccard_order_keeps_chance_ngrams_out_of_prefixes():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") if rng.random() < 0.6 else f"w{rng.randrange(10**9)}" for _ in range(120)) for _ in range(300)]
    bits = 14  # far fewer buckets than different n-grams: the sketch of n-grams tells none of them apart
    w, each = jaccard_join.words(texts)
    sketch = np.bincount((w >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    g, count, info = jaccard_join.grams(w, each, 3, jaccard_join.surprise(sketch)[(w >> np.uint64(64 - bits)).astype(np.int64)])
    g, size = jaccard_join._distinct(g, count, jaccard_join.rarity(info, sketch.sum()).astype(np.uint64))
    at = np.r_[0, np.cumsum(size)]
    ahead = jaccard_join.prefix_length(size, 0.6)
    shared = lambda key: sum(n > 1 for n in Counter(x for k in range(len(texts)) for x in key(g[at[k] : at[k + 1]])[: ahead[k]].tolist()).values())
    assert shared(lambda x: np.sort(x & jaccard_join.MASK40)) > 20 and shared(lambda x: x) == 0


def test_sentencepiece_units_and_codes_of_single_characters():
    m = sentencepiece_lattice.load()
    for text in ("The quick  brown\n fox", "x", " ", "Ω 漢字 😀\ud800", "anea" * 30, "\n\n"):
        s = ("▁" if m.dummy_prefix else "") + text.replace(" ", "▁")
        cut = [0] + [i for i in range(1, len(s)) if not any(s[i - 1 : i + 1] in p for p in m.usable)] + [len(s)]
        assert m.units(text) == [s[a:b] for a, b in zip(cut, cut[1:])]
    codes = sentencepiece_lattice.Codes(m)
    assert all(codes[c] == m.char(c) for c in "a▁Ω😀\n")
    with pytest.raises(KeyError):
        codes["unknown unit"]


def test_few_long_sets_among_many_short_ones_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    sets = [np.arange(5 * k, 5 * k + 3, dtype=np.uint32) for k in range(3000)] + [np.arange(20_000, dtype=np.uint32) * 3, np.arange(20_000, dtype=np.uint32) * 3 + 3]
    n = len(sets)
    zero = pa.array(np.zeros(n, np.int64))
    cols = {"u": pa.array(np.arange(n)), "w": pa.array(np.ones(n, np.int64)), "own": zero, "x": zero, "y": zero, "sig": pa.array([jaccard_join.signature(s).tobytes() for s in sets], pa.binary())}
    t = pa.table(cols | {"lo": pa.array([s.tobytes() for s in sets], pa.binary()), "hi": pa.array([bytes(2 * len(s)) for s in sets], pa.binary())})
    tracemalloc.start()
    got = jaccard_join._within(t, 0.6).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{"a": 3000, "b": None, "n": 1}, {"a": 3001, "b": None, "n": 1}, {"a": 3000, "b": 3001, "n": None}]
    assert peak < 15e6  # a bitmap of 8 kB for each short set would be 25 MB
