"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import random

import numpy as np

from tessera.llm import decontam, html_extract, jaccard_join, langid, license_scan, line_dedup, packing, quality_crf, rabitq, suffix_dedup
from tessera.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
PATHS = "path string, text string"


def texts(spark, rows, extra="", values=()):
    return spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string" + extra)


# HTML


def words_of(page):
    return [b.text for b in blocks(page)]


def test_html_keeps_formulas_and_what_follows_unclosed_elements():
    assert words_of("<article><p>before <math><mi>x</mi></math> after</p></article>") == ["before x after"]
    for name in ("select", "svg", "video", "object", "canvas", "noscript", "template"):
        assert words_of(f"<article><p>a</p><{name}><p>b</p><p>c</p>") == ["a", "b", "c"], name
        assert words_of(f"<p>a</p><{name}><{name}>q</{name}><p>c</p>") == (["a", "q", "c"] if name == "svg" else ["a", "c"]), name
    assert words_of("<select><option>q</option></select>r<svg><text>s</text></svg>") == ["r", "s"]
    assert words_of("<p>a</p><script>b<p>c") == ["a"]


def test_html_deep_nesting_is_linear():
    for page in ("<div>x" * 20000, "<div>x" * 20000 + "</div>" * 20000):
        found = blocks(page)
        assert len(found) == 20000 and found[0].path == ("div",) and len(found[-1].path) == 20000
    assert html_extract.vectors(found).shape == (20000, html_extract.DIM)


def test_html_labels_layouts_without_telling_names(spark):
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    say = random.Random(4)
    words = "river stone over quiet garden where people often walk along old walls and talk about plain things".split()
    sentence = lambda n: " ".join(say.choice(words) for _ in range(n)).capitalize() + "."
    good = total = 0
    for k in range(30):
        body = [sentence(say.randint(12, 60)) for _ in range(say.randint(3, 8))]
        menu = "".join(f"<div><a href='/{i}'>{say.choice(words)}</a></div>" for i in range(6))
        page = f"<body><div class=q{k}>{menu}</div><div class=z{k}><h1>{sentence(5)}</h1>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><div class=w{k}>&copy; {say.choice(words)}</div></body>"
        own = blocks(page)
        p = model.predict([html_extract.vectors(own)])[0]
        good += sum((q >= 0.5) == (b.text in body) for q, b in zip(p, own) if b.node.words[0] != "h1")
        total += sum(b.node.words[0] != "h1" for b in own)
    assert good / total > 0.9


def test_html_generated_truth_is_learnt_by_other_layouts():
    bodies = ["some longer words that make up a text of the article and go on for a while"]
    own = [blocks(p) for p in html_extract.generated(bodies, ["Home page", "About"], 60, seed=77)]
    truth = [np.array([b.text.startswith(html_extract._TRUE) for b in p]) for p in own]
    for b in (b for p in own for b in p):
        b.text = b.text.replace(html_extract._TRUE, "") or "."
    model = html_extract.train(["<article><p>A page of its own, with words in it.</p></article><footer>x</footer>"])
    found = np.concatenate(model.predict([html_extract.vectors(p) for p in own])) >= 0.5
    assert (found == np.concatenate(truth)).mean() > 0.9


def test_html_prediction_in_parts_is_the_whole_one(monkeypatch):
    model = html_extract.BlockLabeller.fresh()
    r = np.random.default_rng(1)
    pages = [r.standard_normal((n, html_extract.DIM)).astype(np.float32) for n in (1, 9, 30)]
    whole = model.predict(pages)
    monkeypatch.setattr(html_extract, "STEPS", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.predict(pages)))


def test_html_rows(spark):
    schema = "page_id long, url string, html string, text string"
    long = "<article>" + "<p>word word word word word word.</p>" * 20000 + "</article>"
    rows = [(1, "u", long, "q"), (1, "u", long, "q"), (1, "v", None, "q"), (None, None, " \n", None)]
    pages = spark.createDataFrame(rows, schema)
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    out = html_extract.extract(pages, model).collect()
    assert len(out) == 4 and out[0] == out[1] and out[0].text.count("\n") == 19999 and [r.n_chars for r in out[2:]] == [0, 0]
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


# licences and lines


def test_license_clashing_names_ties_and_long_texts(spark):
    notice = "# Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x", None), ("a/y", "w\n" * 30000 + notice), ("a/y", "w\n" * 30000 + notice), ("a/z", "")]
    names = "own grant _hash _dir _near_dir _at near depth tf idf word license cosine license_via".split()
    files = spark.createDataFrame([(*r, *names) for r in rows], PATHS + "".join(f", {n} string" for n in names))
    out = license_scan.scan(files)
    assert out.columns == files.columns
    got = sorted((r.path, r.license, r.license_via, r.own, r.grant, r._hash) for r in out.collect())
    assert got == sorted((p, x, v, "own", "grant", "_hash") for p, x, v in (("a/LICENSE", "MIT", "file"), ("a/x", "MIT", "inherited"), ("a/y", "Apache-2.0", "header"), ("a/y", "Apache-2.0", "header"), ("a/z", "MIT", "inherited")))
    tie = [("A-1", "some common words here"), ("B-1", "some common words here")]
    got = license_scan.scan(spark.createDataFrame([("p", "some common words here")], PATHS), templates=tie).first()
    assert (got.license, got.cosine) == ("B-1", 1.0)
    assert license_scan.scan(files.limit(0)).count() == 0


def test_lines_clashing_names_and_long_texts(spark):
    names = "_cut _starts _new _id _hash _mark_id _mark_hash _row _n_lines".split()
    long = "\n".join(f"line {i}" for i in range(20000))
    docs = texts(spark, [(1, long), (2, "x\n" + long), (3, None), (4, "")], "".join(f", {n} string" for n in names), names)
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "_n_removed", "_n_spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == long and got[2].text == "x" and got[3].text is None and got[4].text == ""
    assert {(r._cut, r._starts, r._mark_id, r["_row"]) for r in got.values()} == {("_cut", "_starts", "_mark_id", "_row")}
    assert got[2]._n_lines == 20001 and got[2]._n_removed == 20000


# classifiers


def test_language_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    one = docs.where("lang = 'en' and n_chars > 200").first().text
    rows = [(1, one), (1, one), (None, one * 400), (2, ""), (2, None)]
    out = langid.identify(texts(spark, rows, ", lang string, score string, bits string", ("x", "y", "z")), model).collect()
    assert [r.lang_pred for r in out] == ["en", "en", "en", "und", "und"] and out[0] == out[1]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_against_plain_kernels():
    """The scored margins are those of a presence kernel computed string by string."""
    r = random.Random(2)
    sample = [("".join(r.choice("abcd ") for _ in range(30)), "x") for _ in range(12)] + [("".join(r.choice("efgh ") for _ in range(30)), "y") for _ in range(12)]
    grams = lambda t: {t[i : i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)}
    buffers = lambda ts: (np.frombuffer("".join(ts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in ts]))))
    seen = langid.presence(*buffers([t for t, _ in sample]))
    exact = np.array([[len(grams(a) & grams(b)) for b, _ in sample] for a, _ in sample])
    assert np.abs((seen.astype(int) @ seen.T.astype(int)) - exact).max() <= 3  # hashed n-grams meet now and then
    model = langid.KernelLanguageModel.fit(seen, [y for _, y in sample], landmarks=24, ridge=1e-3)
    norm = np.sqrt(np.diag(exact))
    kernel = exact / np.outer(norm, norm)
    target = np.where(np.array([y for _, y in sample]) == "x", 1.0, -1.0)
    # ridge regression in the span of all rows, with an unpenalised-like constant: same signs as the plain dual solution
    plain = kernel @ np.linalg.solve(kernel + 1e-3 * len(sample) * np.eye(len(sample)), target)
    best, share = model.predict(*buffers([t for t, _ in sample]))
    assert [model.names[b] for b in best] == ["x" if p > 0 else "y" for p in plain] and ((share > 0.5) & (share <= 1)).all()


def test_language_fit_is_bounded_in_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(50)] + [(2, "autre", "fr")] * 9, "doc_id long, text string, lang string")
    taken = []
    monkeypatch.setattr(langid.KernelLanguageModel, "fit", classmethod(lambda cls, seen, langs, **kw: taken.append(langs)))
    langid.fit(docs, sample_docs=20)
    langid.fit(docs, sample_docs=100)
    assert len(taken[0]) == 20 and sorted(taken[1]) == ["en"] * 50 + ["fr"]


def test_quality_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(docs, labels)
    one = docs.where("n_chars > 200").first().text
    rows = [(1, one), (1, one), (2, None), (2, ""), (3, "line of words here\n" * 20000), (None, "x")]
    own = texts(spark, rows, ", score string, predicted string, quality string", ("s", "p", "q"))
    out = quality_crf.score(own, model).collect()
    assert len(out) == 6 and out[0] == out[1] and out[2] == out[3] and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    kept = quality_crf.keep_good(own, model)
    assert kept.columns == own.columns and kept.count() == sum(r.predicted for r in out) and {r.score for r in kept.collect()} <= {"s"}
    assert quality_crf.score(own.limit(0), model).count() == quality_crf.keep_good(own.limit(0), model).count() == 0


def test_quality_scores_against_plain_chains():
    """Scores of whole documents by enumerating every labelling of their lines."""
    r = np.random.default_rng(3)
    model = quality_crf.LineCRF(r.standard_normal(quality_crf.N_FEATURES) * 0.3, r.standard_normal((2, 2)), r.standard_normal(2), 1.3, -0.2)
    rows = ["one line", "A first line.\nsecond!! ### line\n\nlast 12 34", "", "a\nb\nc"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    base, size, at = quality_crf.base_features(data, offsets)
    unary = quality_crf.features(base, at) @ model.weights
    for d, text in enumerate(rows):
        lines = text.split("\n")
        u = unary[at[d] : at[d + 1]]
        assert len(u) == len(lines) and size[at[d] : at[d + 1]].tolist() == [len(x) for x in lines]
        good, total = np.zeros(len(u)), 0.0
        for labels in np.ndindex(*[2] * len(u)):
            w = np.exp(model.start[labels[0]] + sum(u[i] * y for i, y in enumerate(labels)) + sum(model.trans[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
        weight = np.array([len(x) + 1 for x in lines])
        p = np.clip((good / total * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(model.slope * np.log(p / (1 - p)) + model.shift)))
        assert np.isclose(model.scores(data, offsets)[d], want)


def test_quality_fit_is_bounded_in_rows(spark, monkeypatch):
    docs = texts(spark, [(1, f"text {i}") for i in range(30)] + [(2, "x\n" * 600), (2, "y" * 70000), (3, "z"), (3, "z")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1), (1, None)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality_crf.LineCRF, "fit", classmethod(lambda cls, bases, sizes, y, **kw: taken.append(sorted(y.tolist()))))
    quality_crf.fit(docs, labels, sample_docs=10)
    quality_crf.fit(docs, labels)
    assert len(taken[0]) == 10 and taken[1] == [0] + [1] * 30


# vectors


def test_neighbours_repeated_rows_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 12))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(100, x[7].tolist(), "c"), (100, x[100].tolist(), "c"), (5, x[5].tolist(), "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    ids, vec = np.array([row[0] for row in rows]), np.array([row[1] for row in rows])
    index, turn = rabitq.build_index(table)

    def plain(q_id, q):
        d = np.sqrt(((vec - q) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q_id][:10]
        return [(n + 1, int(ids[i]), round(float(d[i]), 9)) for n, i in enumerate(order)]

    want = sorted([(0, *y) for y in plain(0, x[0])] + [(100, *y) for y in plain(100, x[100])] + [(100, *y) for y in plain(100, x[7])] + [(200, *y) for y in plain(200, x[200])])
    for size in (rabitq.QUERY_BYTES, 100):
        monkeypatch.setattr(rabitq, "QUERY_BYTES", size)
        got = rabitq.search(index, turn, index.where("vec_id % 100 = 0"))
        assert sorted((g.query_id, g["rank"], g.vec_id, round(g.score, 9)) for g in got.collect()) == want
    assert rabitq.search(index.limit(0), turn, index.limit(0)).count() == 0
    few, turn = rabitq.build_index(table.where("vec_id < 4"))
    assert rabitq.search(few, turn, few.where("vec_id = 0")).count() == 3


# copies and packing


def test_copies_with_clashing_names(spark):
    names = "_lost _mark _same _n _row hash component_id mark".split()
    docs = texts(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, None), (3, "z z z z z")], "".join(f", {n} string" for n in names), names)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r._lost, r._same) for r in kept.collect()) == [(1, "a b c d e f", "_lost", "_same"), (3, "", "_lost", "_same"), (3, "z z z z z", "_lost", "_same")]
    bench = spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    assert decontam.remove(docs, bench).columns == docs.columns and suffix_dedup.cut(docs).count() == 4


def test_packing_is_no_worse_than_plain_first_fit():
    r = np.random.default_rng(9)
    for top in (100, 60, 30):
        lengths = r.integers(1, top + 1, 300)
        sequence, _ = packing.best_two_fit(lengths, 100)
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            for i, used in enumerate(bins):
                if used + n <= 100:
                    bins[i] += n
                    break
            else:
                bins.append(n)
        assert sequence.max() + 1 <= len(bins) + 1
