"""The corpus operators against brute force, and on nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random

import brute
import numpy as np
import pytest

from tessera.llm import decontam, html_extract, jaccard_join, langid, license_scan, line_dedup, packing, quality_crf, rabitq, suffix_dedup
from tessera.llm.fm_index import FMIndex
from tessera.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, cls string"


def corpus(seed=1):
    r = random.Random(seed)
    words = ["ab", "Cd", "efé", "gh.", "the", "of", "x1", "ÖL", "q"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(12)]
    texts = [None, "", "  \n\t", "ab", "AB", "ab Cd efé", *base]
    for t in base:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    texts += [base[0], base[0], base[1] + "\n" + base[2] + "\n" + base[3] + "\n" + base[4], base[1] + "\n" + base[2] + "\n" + base[3] + "\nlast", "w " * 30000]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", "clash") for d, t in rows], SCHEMA)


def test_jaccard(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(frame(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)
    some = frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (5, "A B C D E"), (6, None)])
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.link_groups(some).collect()) == [(0, 1), (1, 1), (1, 1), (5, 1), (6, 6)]
    kept = jaccard_join.keep_one(some)
    assert kept.columns == some.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 6]
    assert jaccard_join.link_groups(frame(spark, [])).count() == 0


def test_jaccard_blocks_of_a_hot_shingle(spark, monkeypatch):
    rows = [(i, "k l m n " + f"w{i % 7} " * (i % 5)) for i in range(60)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(frame(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_links_are_all_links(spark, monkeypatch):
    rows = [r for r in corpus(6) if len(r[1] or "") < 10000]
    for block in (1024, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        members, links = jaccard_join.linked_pairs(frame(spark, rows), k=3, percent=70)
        cls = {r.doc_id: r.cls for r in members.collect()}
        got = {(r.x, r.y) for r in links.collect()}
        want = set()
        for a, b in ((a, b) for a in rows for b in rows if cls[a[0]] < cls[b[0]]):
            x, y = (brute.shingles(t, 3) for t in (a[1], b[1]))
            if x and y and 100 * len(x & y) >= 70 * len(x | y):
                want.add((cls[a[0]], cls[b[0]]))
        assert got == want


def test_jaccard_of_a_chain_and_a_large_group(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"v{j}" if j < i else words[j] for j in range(60))) for i in range(12)]  # each near the next only
    rows += [(100 + i, " ".join(words[:-1] + [f"u{i}"])) for i in range(40)]
    for block, batch in ((1024, 8 << 20), (4, 1)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BATCH", batch)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_groups(frame(spark, rows)).collect()}
        assert got == brute.jaccard_components(rows)


def test_suffix_dedup(spark):
    rows = corpus(2)
    rows += [(100 + i, "0123456789" * 4 + "abcdefghijklmnopqrst" + str(i) * 3 + "é" * 40 + str(i % 2)) for i in range(8)]
    want = brute.repeated_bytes(rows)
    for most in (suffix_dedup.BATCH, 200):
        got = {r.doc_id: tuple(r[2:]) for r in suffix_dedup.cut(frame(spark, rows), most=most).collect()}
        assert got == want
    again = suffix_dedup.cut(frame(spark, [(1, "ab" * 40), (1, "ab" * 40), (None, "ab" * 40), (2, None)])).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in again) == [(1, 0), (1, 0), (2, 0), (9, 80)]
    assert suffix_dedup.cut(frame(spark, [])).count() == 0


def test_suffix_dedup_splits_a_crowded_anchor(spark, monkeypatch):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(90))
    other = lambda n: "".join(r.choice("xyz ") for _ in range(n))
    rows = [(i, other(i % 60) + shared[i % 3 :] + other(40) + ("abab" * 30 if i % 5 == 0 else "")) for i in range(60)]
    rows += [(60 + i, other(30) + shared[:70] + rows[i][1][-45:]) for i in range(20)]
    want = brute.repeated_bytes(rows)
    rounds = []
    finer = suffix_dedup._finer
    monkeypatch.setattr(suffix_dedup, "_finer", lambda *a: rounds.append(a[3]) or finer(*a))
    for most in (4000, 100, 0):
        got = {r.doc_id: tuple(r[2:]) for r in suffix_dedup.cut(frame(spark, rows), most=most).collect()}
        assert got == want
    assert set(rounds) == set(suffix_dedup.FINER)


def test_decontamination(spark):
    rows = corpus(3)
    items = [(7, rows[8][1]), (8, "ab of"), (9, None), (10, "..."), (None, rows[9][1]), (11, rows[10][1] + " tail words"), (7, "the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame(spark, rows), bench).selectExpr("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0").collect()
    assert sorted(map(tuple, found)) == sorted(brute.contamination(rows, items))
    cleaned = decontam.remove(frame(spark, rows), bench)
    assert cleaned.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert all(r.n_chars == len(r.text or "") for r in cleaned.collect())
    assert decontam.contamination(frame(spark, []), bench).count() == 0
    empty = decontam.contamination(frame(spark, rows), bench.limit(0)).collect()
    assert {r.n_hit for r in empty} == {0} and empty[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_fm_index():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 400)
    index = FMIndex(text, 3)
    for n in (1, 2, 5):
        pattern = r.integers(1, 4, (1, n))
        low, high = index.search(pattern, np.array([n]))
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern[0]).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_packing():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 101, 500)
    sequence, offset = packing.best_two_fit(lengths, 100)
    assert sequence.max() + 1 <= np.ceil(lengths.sum() / 100) * 1.03
    for s in np.unique(sequence):
        own = np.argsort(offset[sequence == s])
        ends = np.cumsum(lengths[sequence == s][own])
        assert (offset[sequence == s][own] == np.append(0, ends[:-1])).all() and ends[-1] <= 100


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    rows = [*corpus(4), (90, "It's <|endoftext|> we'll İ Σς é 123 ...'s"), (90, "word " * 9000)]
    got = packing.pack(frame(spark, rows), path, group=16).collect()
    inner = Tokenizer.from_file(path)
    assert sum(r.length for r in got) == sum(len(inner.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    own = packing.WordTokenizer(path)
    for _, t in rows:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == inner.encode(t or "", add_special_tokens=False).ids
    assert packing.pack(frame(spark, []), path).count() == 0


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, None), (6, "q\nq\nq\nq\nq")]
    out = {r.doc_id: r for r in line_dedup.dedup(frame(spark, rows), set_n_chars=True).collect()}
    assert {k: r.text for k, r in out.items()} == {1: "a\nb\nc\nd", 2: "x\ny", 3: "", 4: "a\nb", 5: None, 6: "q"}
    assert out[2].n_chars == 3 and out[2]._n_spans == 1 and out[2].cls == "clash"
    twice = line_dedup.dedup(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted(r.text for r in twice) == ["", "a\nb\nc", "a\nb\nc"]
    assert line_dedup.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_line_dedup"])
def test_sql(spark, duck, name):
    from tessera.llm import registry

    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    got, want = (t[columns].sort_values("doc_id").reset_index(drop=True).astype(str).replace("None", "nan") for t in (got, want))
    assert (got == want).all().all()


def test_license_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/LICENSE", "Licensed under CC BY-NC 4.0."), ("c/y.py", None), (None, "text"), ("a/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("ab/x", "")]
    got = {r.path: (r.license, r.license_via) for r in license_scan.scan(spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, df int")).collect()}
    assert got == {"a/LICENSE": ("MIT", "file"), "a/b/x.py": ("CC-BY-NC-4.0", "inherited"), "a/b/LICENSE": ("CC-BY-NC-4.0", "file"), "c/y.py": (None, "none"), None: (None, "none"), "a/z.py": ("Apache-2.0", "header"), "ab/x": (None, "none")}
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[50:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [1.0])]
    index, turn = rabitq.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = rabitq.search(index, turn, index.where("vec_id % 100 = 0"), k=10).collect()
    found = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        own = sorted((g.rank, g.vec_id) for g in got if g.query_id == q)
        found += len({v for _, v in own} & set(want.tolist()))
    assert len(got) == 40 and found >= 36
    assert rabitq.build_index(spark.createDataFrame([], "vec_id long, embedding array<float>"))[1] is None


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op2_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    model = langid.fit(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark, [(1, None), (2, "12 %"), (3, "The of and that")]), model).collect()}
    assert out[1] == out[2] == ("und", 0.0) and out[3][0] != "und"
    assert langid.identify(frame(spark, [(1, "words")]), langid.fit(docs.limit(0))).first().lang_pred == "und"


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(docs, labels)
    rows = quality_crf.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    kept = quality_crf.keep_good(frame(spark, [(1, None), (2, ""), (2, "")]), model)
    assert kept.columns == frame(spark, []).columns
    assert quality_crf.score(docs, quality_crf.fit(docs, labels.limit(0))).first().score == 0.5


def test_crf_marginals_are_exact():
    r = np.random.default_rng(0)
    u, trans, start = r.standard_normal(4), r.standard_normal((2, 2)), r.standard_normal(2)
    good, _, z = quality_crf.forward_backward(u, np.array([0, 4]), trans, start)
    weights = {}
    for path in np.ndindex(2, 2, 2, 2):
        weights[path] = np.exp(start[path[0]] + sum(u[i] * y for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
    total = sum(weights.values())
    assert np.isclose(z, np.log(total))
    assert np.allclose(good, [sum(w for p, w in weights.items() if p[i]) / total for i in range(4)])


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Big &amp; small</h1><p>One\n two<b>three</b><p>a < b</article><footer>&copy; me</footer>"
    assert [b.text for b in blocks(page)] == ["Home", "Big & small", "One twothree", "a < b", "© me"]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.fit(pages)
    for r in html_extract.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == "\n".join(b.text for b in blocks(r.html or "") if "article" in b.path)
    odd = spark.createDataFrame([(1, None, None, 1), (1, "u", "", 2), (2, "u", "<<<>", 3)], "page_id long, url string, html string, text int")
    assert [r.n_chars for r in html_extract.extract(odd, model).collect()][:2] == [0, 0]
