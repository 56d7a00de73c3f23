"""Operators on small tables: nulls, empty and long texts, repeated rows, empty tables, clashing names; brute force where SQL has no say."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.llm import jaccard_join, language_id, license_scan, line_dedup, packing, progressive_jpeg, sentencepiece_lattice, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _i long, H string, bucket string, c string, t string"


def _line(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = [_line(rng, 30) for _ in range(6)]
    shared = _line(rng, 60)
    rows = [(i, "\n".join([base[i % 6], _line(rng, 25), shared if i % 3 == 0 else _line(rng, 20)])) for i in range(24)]
    rows += [(40, rows[0][1]), (41, rows[0][1]), (41, rows[0][1]), (42, None), (43, ""), (None, rows[1][1]), (None, None), (44, "word " * 30_000), (45, "\n\n \n"), (46, "z" * 5000), (2, rows[2][1])]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, "s", len(t or ""), n, "h", "b", "c", "t") for n, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, _rows())


@pytest.fixture(scope="module")
def empty(spark):
    return _frame(spark, [])


def _aligned(a, b):
    """Patience diff, written plainly: (positions in a, positions in b) of aligned lines."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in _aligned(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return _aligned(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 == b.count(x)]
    best = []
    for k, (_, j) in enumerate(once):
        best.append(max((best[m] for m in reversed(range(k)) if once[m][1] < j), key=len, default=[]) + [once[k]])  # of equally long chains the latest
    chain = max(reversed(best), key=len, default=[])
    out, at = list(chain), (-1, -1)
    for p in [*chain, (len(a), len(b))] if chain else []:
        out += [(i + at[0] + 1, j + at[1] + 1) for i, j in _aligned(a[at[0] + 1 : p[0]], b[at[1] + 1 : p[1]])]
        at = p
    return sorted(out)


def _dedup_by_hand(rows, anchor=8, block=20, rare=100):
    """Texts left: every line of every run that an earlier document holds, and long runs of lines aligned with the first holder of a rare key."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in rows if i is not None and t}
    words = lambda xs: sum(len(x.split()) for x in xs)
    spans = {}  # every document's least stretches of block words, on from a line and back from it
    for i, b in lines.items():
        on = [x for x in b if x]
        spans[i] = set()
        for p in range(len(on)):
            for cut in ([on[p:q] for q in range(p + 1, len(on) + 1)], [on[q : p + 1] for q in range(p, -1, -1)]):
                if least := next((c for c in cut if words(c) >= block), None):
                    spans[i].add((p if least[0] is on[p] and cut[0] == on[p : p + 1] and on[p : p + len(least)] == least else p + 1 - len(least), tuple(least)))
    out = []
    for i, t in rows:
        if i not in lines:
            out.append(t)
            continue
        b, gone = lines[i], set()
        on = [q for q, x in enumerate(b) if x]
        earlier = [m for m in lines if m < i]
        for m in earlier:
            a = [x for x in lines[m] if x]
            for p in range(len(a)):
                for q in range(len(on)):
                    k = 0
                    while p + k < len(a) and q + k < len(on) and a[p + k] == b[on[q + k]]:
                        k += 1
                    if words(a[p : p + k]) >= block:
                        gone |= set(range(on[q], on[q + k - 1] + 1))
        keys = {(x,) for x in b if len(x.split()) >= anchor} | {s for _, s in spans[i]}
        partners = set()
        for key in keys:
            have = {m: max(1 if len(key) == 1 and key[0] in lines[m] else 0, sum(s == key for _, s in spans[m])) for m in lines}
            if sum(have.values()) <= rare and (f := min(m for m in have if have[m])) != i:
                partners.add(f)
        for m in partners:
            hit = {q for _, q in _aligned(lines[m], b) if b[q]}
            run = []
            for q in range(len(b) + 1):
                if q < len(b) and (q in hit or (run and not b[q])):
                    run.append(q)
                    continue
                while run and run[-1] not in hit:
                    run.pop()
                if words(b[q] for q in run) >= block:
                    gone |= set(run)
                run = []
        out.append("\n".join(x for q, x in enumerate(t.split("\n")) if q not in gone))
    return out


def test_line_dedup_equals_brute_force(docs, empty):
    rows = [r for r in _rows() if not (r[0] in (2, 41))]  # distinct ids
    got = line_dedup.dedup_lines(docs.where("doc_id is null or doc_id not in (2, 41)"))
    assert got.columns == [*docs.columns, "lines_removed"]
    want = sorted((-1 if i is None else i, t or "") for (i, _), t in zip(rows, _dedup_by_hand(rows)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got.collect()) == want
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("rare", [3, 100])
def test_line_dedup_of_mixed_lines_equals_brute_force(spark, rare):
    rng = random.Random(21)
    pool = [_line(rng, n) + f" {k}" for k, n in enumerate([2, 3, 5, 7, 8, 9, 12, 18, 25] * 4)]
    rows = []
    for i in range(40):
        at = rng.randrange(len(pool))
        part = pool[at : at + rng.randint(2, 9)]
        if rng.random() < 0.4:
            part.insert(rng.randrange(len(part)), rng.choice(["", "new " + str(i)]))
        rows.append((i, "\n".join([f"head {i}", *part, f"tail {i}", *rng.sample(pool, 2)])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_frame(spark, rows), rare=rare).collect()}
    assert got == {i: t for (i, _), t in zip(rows, _dedup_by_hand(rows, rare=rare))}


def test_line_dedup_judges_each_pair_by_itself_and_keeps_odd_columns(spark):
    rng = random.Random(4)
    a, b = [_line(rng, 6) + f" a{k}" for k in range(2)], [_line(rng, 6) + f" b{k}" for k in range(2)]
    rows = [(1, "\n".join(["one", *a, "first"]), 1, "x"), (2, "\n".join(["two", *b, "second"]), 2, "y"), (3, "\n".join([*a, *b]), 3, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, lines_removed string")
    got = line_dedup.dedup_lines(d)
    assert got.columns == [*d.columns, "lines_removed_"]
    assert sorted((r[0], r[1], r[4]) for r in got.collect()) == [(i, t, 0) for i, t, _, _ in rows]


def test_line_dedup_finds_blocks_of_short_lines_and_behind_a_first_holder(spark):
    rng = random.Random(8)
    verse = [_line(rng, 6) + f" v{k}" for k in range(10)]
    a, b = [_line(rng, 12) + f" p{k}" for k in range(2)]
    rows = [
        (1, "\n".join(["one", *verse, "first"])), (2, "\n".join(["two", *verse[:5], "", *verse[5:], "second"])),
        (3, f"{b}\nother\n{a}"), (4, f"left\n{a}\n{b}\nright"), (5, f"far\n{a}\n{b}\nnear"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_frame(spark, rows)).collect()}
    assert got == dict(rows) | {2: "two\nsecond", 5: "far\nnear"}
    assert _dedup_by_hand(rows) == [got[i] for i, _ in rows]


def test_line_dedup_takes_copies_alike_and_leaves_the_first(docs):
    got = {(r["doc_id"], r["lines_removed"]) for r in line_dedup.dedup_lines(docs).where("doc_id in (0, 40, 41)").collect()}
    assert got == {(0, 0), (40, 3), (41, 3)}


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    syl = {"aa": ["ba", "be", "bi"], "bb": ["ko", "ku", "kay"]}
    text = lambda g, n: " ".join("".join(rng.choice(syl[g]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(g := ("aa", "bb")[i % 2], 80), g) for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(train)
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame([(i, text(("aa", "bb")[i % 2], 80), None) for i in range(40)], "doc_id long, text string, lang string"), m).collect()}
    assert all(got[i]["lang_id"] == ("aa", "bb")[i % 2] and not got[i]["rejected"] for i in range(40))
    odd = language_id.classify(m, ["zwxq vwzx qzzx " * 80, None, "", "123"])
    assert odd[2].tolist() == [True] * 4 and odd[0][1:] == [None] * 3
    assert language_id.identify(docs, m).count() == docs.count()
    none = language_id.fit(empty)
    assert language_id.identify(docs, none).where("not rejected").count() == 0
    kept = language_id.keep_identified(train, m)
    assert kept.columns == train.columns and kept.count() >= 118
    assert language_id.identify(empty, m).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels)
    assert toxicity.score(docs, m).where("toxic").count() == 0
    assert toxicity.score(docs, m).count() == docs.count()
    assert toxicity.drop_toxic(docs, m).columns == docs.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_license_scan(spark, docs, empty):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0\ny"), (1, "x\nLicensed under the Apache License, Version 2.0\ny"), (None, "Released under the MIT License."), (2, None), (3, "")]
    got = license_scan.scan(_frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["matched"]) for r in got) == [(0, "MIT", "Released under the MIT License")] + [(1, "Apache-2.0", "Licensed under the Apache License, Version 2.0")] * 2
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0


def test_jaccard_components_equal_brute_force(spark, docs, empty):
    rng = random.Random(9)
    rows = _rows()
    for g in range(12):
        base = _line(rng, 80).split()
        for k in range(rng.randint(2, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
            rows.append((1000 + g * 20 + k, " ".join(w)))
    # rows of the same id and text are one document
    pairs, want = jaccard_join.brute_force(sorted({(i, t) for i, t in rows if i is not None and t}), 3, 0.6)
    links = {i: sum(i in p for p in pairs) for i in want}
    for cut in ({}, {"block_docs": 3, "block_grams": 150, "tile_docs": 20}):  # blocks change nothing
        got = {r["doc_id"]: (r["group_id"], r["links"]) for r in jaccard_join.groups(_frame(spark, rows), **cut).collect()}
        assert got == {i: (want[i], links[i]) for i in want}
    assert jaccard_join.groups(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and ids.count(2) == 1 and not {40, 41} & set(ids) and {42, 43, 45} <= set(ids)


def test_jaccard_same_id_and_odd_columns(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    odd = spark.createDataFrame([(7, a, 1, "x"), (7, b, 2, "y"), (9, b, 3, "z"), (7, a, 4, "w"), (8, "...", 5, "v"), (8, "...", 6, "u")], "doc_id long, text string, `a.b` int, _th string")
    assert {(r["doc_id"], r["group_id"], r["links"]) for r in jaccard_join.groups(odd).collect()} == {(7, 7, 1), (9, 7, 1)}
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got) == sorted([(7, a), (7, b), (8, "..."), (8, "...")])


def test_jaccard_tries_every_member_of_a_drifted_component(spark):
    rng = random.Random(3)
    rows = []
    for g in range(24):
        word = lambda: f"w{rng.randrange(10**9)}"
        base = [word() for _ in range(100)]
        for k, n in [(k, 4) for k in range(40)] + [(900, 6)]:
            w = list(base)
            for j in rng.sample(range(100), n):
                w[j] = word()
            rows.append((g * 1000 + k, " ".join(w)))
    want = {}
    for g in range(24):
        want |= jaccard_join.brute_force([r for r in rows if r[0] // 1000 == g], 3, 0.6)[1]
    member = jaccard_join.groups(_frame(spark, rows))
    assert {r["doc_id"]: r["group_id"] for r in member.collect()} == want


def test_topk_equals_brute_force(spark, docs, empty):
    q = spark.createDataFrame([(1, "thon ered anre thon"), (2, None), (3, ""), (4, "zzz nothing"), (1, "word")], "item_id long, text string")
    got = topk.search(docs, q, k=5).collect()
    from collections import Counter

    texts = [(r["doc_id"], topk.tokens(r["text"])) for r in docs.collect()]
    n, avg = len(texts), sum(len(w) for _, w in texts) / len(texts)
    df = Counter(t for _, w in texts for t in set(w))
    want = []
    for i, t in q.collect():
        c = Counter(topk.tokens(t))
        s = []
        for d, w in texts:
            tf = Counter(w)
            x = sum(m * np.log(1 + (n - df[k] + 0.5) / (df[k] + 0.5)) * tf[k] * 2.2 / (tf[k] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for k, m in c.items() if tf[k])
            if x > 0:
                s.append((-round(x, 6), d is None, d or 0))
        want += [(i, k + 1, None if z[1] else z[2], -z[0]) for k, z in enumerate(sorted(s)[:5])]
    key = lambda r: (r[0], r[1], r[2] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert topk.search(empty, q).count() == 0


def test_topk_keeps_large_and_null_ids_and_bounds_the_queries(spark):
    d = spark.createDataFrame([(2**60 + 1, "word one"), (2**60 + 2, "word two"), (None, "word")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert {r["doc_id"] for r in topk.search(d, q).collect()} == {2**60 + 1, 2**60 + 2, None}
    with pytest.raises(ValueError):
        topk.search(d, q, max_queries=0)


def test_topk_query_asks_with_every_twentieth_document(spark, tmp_path):
    from quadrel.llm import queries

    rng = random.Random(12)
    pool = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(400)]
    texts = [" ".join(pool[int(rng.random() ** 2 * 400)] for _ in range(rng.choice([0, 3, 60, 200]))) for _ in range(125)]
    texts[20], texts[40], texts[77] = texts[60], "abc", texts[60]
    texts[60] = " ".join(pool[:90])
    spark.createDataFrame([*enumerate(texts), (None, texts[60]), (-20, texts[60]), (126, None)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_topk_search(spark, str(tmp_path)).collect()
    docs = [*enumerate(texts), (None, texts[60]), (-20, texts[60]), (126, "")]
    from collections import Counter

    tfs = [Counter(topk.tokens(t)) for _, t in docs]
    avg = sum(c.total() for c in tfs) / len(tfs)
    df = Counter(t for c in tfs for t in c)
    want = []
    for q, c in zip([d for d, _ in docs], tfs):
        if q is not None and q % 20 == 0:
            s = [(-round(sum(m * np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * tf.total() / avg)) for t, m in c.items() if tf[t]), 6), d is None, d or 0) for (d, _), tf in zip(docs, tfs)]
            want += [(q, k + 1, None if z[1] else z[2], -z[0]) for k, z in enumerate(sorted(x for x in s if x[0] < 0)[:10])]
    key = lambda r: r[:2]
    assert [tuple(r) for r in sorted(got, key=key)] == [pytest.approx(w, abs=2e-6) for w in sorted(want, key=key)]


@pytest.mark.parametrize("mb", [64, 0])
def test_url_filter(spark, mb):
    urls = ["http://spam-farm.example.org/a?utm_source=x#f", "https://www.Spam-Farm.example.org:443/a/", "http://ok.example.org/a", None, "", "no url", "http://u@sub.cheap-pills.example.com:8080/x?b=1&ref=2"]
    pages = spark.createDataFrame([(n if n != 2 else None, u, "k", 1) for n, u in enumerate(urls * 2)], "page_id long, url string, key string, bucket int")
    cascade, n = url_filter.build(pages, bucket_keys=3)
    got = url_filter.apply_filter(pages, cascade, n, broadcast_mb=mb).collect()
    assert len(got) == 14
    by = {r["page_id"]: (r["url_key"], r["listed"]) for r in got if r["page_id"] is not None}
    assert by[0] == ("spam-farm.example.org/a", True) == by[1] and by[3] == by[4] == by[5] == (None, None)
    assert by[6] == ("sub.cheap-pills.example.com:8080/x?b=1", True) and by[9] == ("ok.example.org/a", False)
    none = pages.limit(0)
    cascade, n = url_filter.build(none)
    assert url_filter.apply_filter(none, cascade, n, broadcast_mb=mb).count() == 0


@pytest.mark.parametrize("mb", [64, 0])
def test_url_filter_keeps_large_and_null_ids(spark, mb):
    ids = [2**60 + 1, 2**60 + 3, None, 2**60 + 5]
    pages = spark.createDataFrame([(i, f"http://spam-farm.example.org/{n % 2}") for n, i in enumerate(ids)], "page_id long, url string")
    cascade, n = url_filter.build(pages, bucket_keys=1)
    got = url_filter.apply_filter(pages, cascade, n, broadcast_mb=mb, group_rows=1).collect()
    assert sorted((r["page_id"] or 0, r["listed"]) for r in got) == [(i, True) for i in (0, 2**60 + 1, 2**60 + 3, 2**60 + 5)]


def test_packing_keeps_large_and_null_ids_and_odd_columns(spark):
    d = spark.createDataFrame([(2**60 + 1, "a b", 1), (2**60 + 2, "c", 2), (None, "d e", 3), (5, "f", 4), (5, "f", 4)], "doc_id long, text string, `a.b` int")
    bins = packing.pack(d, capacity=4).collect()
    assert sorted(i or 0 for r in bins for i in r["doc_ids"]) == [0, 5, 5, 2**60 + 1, 2**60 + 2] and sum(r["fill"] for r in bins) == 7


def test_packing(spark, docs, empty):
    bins = packing.pack(docs, capacity=100).collect()
    total = sum(len((t or "").split()) for _, t in _rows())
    assert sum(r["fill"] for r in bins) == total and all(sum(r["sizes"]) == r["fill"] <= 100 for r in bins)
    parts = [(d, p) for r in bins for d, p in zip(r["doc_ids"], r["parts"]) if d == 44]
    assert sorted(p for _, p in parts) == list(range(300))
    assert packing.pack(empty).count() == 0


def test_sentencepiece_equals_the_library(spark, docs, empty):
    spm = pytest.importorskip("sentencepiece")
    sp = spm.SentencePieceProcessor(model_file=sentencepiece_lattice.DEFAULT_MODEL)
    rows = [(1, "The quick  brown\n fox, anea."), (None, "Ω 漢字 😀"), (3, None), (4, ""), (4, ""), (5, "the" * 300), (6, " ")]
    got = sentencepiece_lattice.encode(_frame(spark, rows), decoded=True).collect()
    want = {t: (None if t is None else sp.encode(t)) for _, t in rows}
    assert sorted(str((r["ids"], r["decoded"])) for r in got) == sorted(str((want[t], t)) for _, t in rows)
    assert sentencepiece_lattice.encode(empty).count() == 0
    again = sentencepiece_lattice.decode(sentencepiece_lattice.encode(_frame(spark, rows)))
    assert sorted(str(r["decoded"]) for r in again.collect()) == sorted(str(t) for _, t in rows)


def test_merges_in_one_pass_equal_merges_by_a_heap(spark):
    """Also where a merge makes an edge of an earlier rank ready: bc (rank 1) makes abc (rank 0) ready before cd (rank 2)."""
    pieces = ["<unk>", "abc", "bc", "cd", "a", "b", "c", "d"]
    m = sentencepiece_lattice.Model(pieces, [0.0, -1.0, -2.0, -3.0, -9.0, -9.0, -9.0, -9.0], [2] + [1] * 7, True, False, 0)
    rng = random.Random(4)
    texts = ["abcd", "abc", "bcd", "cdabc", *("".join(rng.choices("abcd", k=rng.randint(2, 40))) for _ in range(60))]
    more = sentencepiece_lattice.Model(["<unk>", *(p := sorted({"".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(30)})), "a", "b", "c"], [0.0, *(-float(rng.randint(1, 12)) for _ in p), -99.0, -99.0, -99.0], [2] + [1] * (len(p) + 3), True, False, 0)
    assert any(c & 1 for c in sentencepiece_lattice.merge_codes(m).values())
    for own in (m, more):
        units = spark.createDataFrame([(0, t) for t in set(texts)], "bucket int, unit string").repartition(2, "bucket")
        got = sentencepiece_lattice.fold_merges(sentencepiece_lattice.lattice(units, sentencepiece_lattice.piece_table(spark, own), own.longest, 2)).collect()
        found = {r["unit"]: [(x >> 26 & 63, x >> 20 & 63, x & 0xFFFFF) for x in r["path"]] for r in got}
        assert len(found) == len(got)
        for u in set(texts):
            at, want = 0, []
            for i in np.frombuffer(own.merge(u), own.kind).tolist():
                n = len(own.pieces[i]) if i else 1
                want += [(at, n, i)] if n > 1 else []
                at += n
            assert found.get(u, []) == want, u


def test_unigram_viterbi_equals_the_library(spark, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sentencepiece_lattice.DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # the same pieces as a unigram model
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -8.0 - (i * 7919 % 10007) / 2000
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    sp, own = spm.SentencePieceProcessor(model_file=path), sentencepiece_lattice.load(path)
    texts = ["The quick brown fox jumps", "information theory and there", "another  thing", "anea Thandthe reonly"]
    got = sentencepiece_lattice.encode(_frame(spark, list(enumerate(texts))), own).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_jpeg_column_and_independent_decoder(spark):
    rng = np.random.default_rng(2)
    img = np.clip(np.kron(rng.integers(0, 256, (5, 6, 3)), np.ones((8, 8, 1))) + rng.integers(-20, 20, (40, 48, 3)), 0, 255).astype(np.uint8)[:37, :45]
    data = progressive_jpeg.encode(img, 2, False)
    rows = [(1, data), (1, data), (None, data), (2, None), (3, b""), (4, data[:200])]
    got = progressive_jpeg.decode_column(spark.createDataFrame([(i, None if b is None else bytearray(b), 5) for i, b in rows], "id long, jpeg binary, height int")).collect()
    assert [r["error"] is None for r in got] == [True, True, True, True, False, False]
    ours = np.frombuffer(got[0]["pixels"], np.uint8).reshape(37, 45, 3).astype(int)
    jvm = spark.sparkContext._jvm
    im = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    a = np.array(list(im.getRGB(0, 0, 45, 37, None, 0, 45)), np.int64).reshape(37, 45)
    assert np.abs(np.stack([(a >> 16) & 255, (a >> 8) & 255, a & 255], 2) - ours).max() <= 3
    # files of an independent encoder, progressive and sequential
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    for mode in (1, 0):  # default progressive, none
        out.reset()
        param = writer.getDefaultWriteParam()
        param.setProgressiveMode(mode)
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        rgb = jvm.java.awt.image.BufferedImage(45, 37, 1)
        for y in range(37):
            for x in range(45):
                rgb.setRGB(x, y, int(img[y // 8 * 8, x // 8 * 8] @ np.array([65536, 256, 1])))
        writer.write(None, jvm.javax.imageio.IIOImage(rgb, None, None), param)
        stream.flush()
        x = progressive_jpeg.decode(bytes(out.toByteArray()))
        assert x.shape == (37, 45, 3) and np.abs(x[::8, ::8].astype(int) - img[::8, ::8]).mean() < 40
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert progressive_jpeg.decode_column(progressive_jpeg.media_of_vectors(none)).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, 3.0])], "vec_id long, embedding array<float>")
    got = {r["id"]: r for r in progressive_jpeg.decode_column(progressive_jpeg.media_of_vectors(some)).collect()}
    assert got[1]["pixels"] is None and got[2]["height"] == 16 and len(got[3]["pixels"]) == 16 * 16 * 3
