"""The pipeline's stages against plain versions, on small fixtures."""

import random
import re

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)


def one_of_each(rows, k=5, percent=80):
    """The smallest doc_id of each group of rows with distinct ids, by all pairs of k-word sets."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    group = {d: d for d, _ in rows}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[a] != group[b]:
                least, other = sorted((group[a], group[b]))
                group = {d: least if g == other else g for d, g in group.items()}
    return {d for d, g in group.items() if g == d}


def planted(seed=1):
    """Texts of 60 words and copies whose last words differ: 5-word similarities of 0.875, 0.836, 0.806 and 0.778."""
    r = random.Random(seed)
    rows = []
    for b, changed in enumerate((4, 5, 6, 7, 5, 6)):
        base = [f"w{r.randrange(5000)}" for _ in range(60)]
        rows += [(10 * b, " ".join(base)), (10 * b + 1, " ".join([*base[:-changed], *(f"x{b}y{i}" for i in range(changed))]))]
    return [*rows, (90, None), (91, ""), (92, "a b"), (93, "A B")]


def test_near_duplicates_take_five_words_and_080(spark):
    rows = planted()
    got = {r.doc_id for r in P.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert got == one_of_each(rows)
    assert {1, 11, 21, 41, 51} & got == set() and 31 in got
    assert {11, 21, 41, 51} <= one_of_each(rows, 4, 85)


def test_near_duplicates_drop_rows_not_ids(spark):
    rows = planted()[:2]
    (a, text), (b, near) = rows
    kept = P.near_duplicates(spark, frame(spark, [(a, text), (b, near), (b, "a text of its own"), (b, "a text of its own"), (None, near), (7, None)]), "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept) == sorted([(a, text), (b, "a text of its own"), (-1, near), (7, "")])


def test_run(spark, tmp_path):
    """All five stages; without labels the classifier rejects nothing."""
    from tokenizers import Tokenizer

    from tessera.llm.packing import default_tokenizer

    phrase = " ".join(f"bench{i}" for i in range(12))
    top = "line one here\nline two here\nline three here"
    rows = [r for r in planted() if r[0] < 90] + [(100, top + "\nand the rest"), (101, top), (102, phrase), (103, "before it come some words " + phrase)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lengths = {}
    for r in P.run(spark, str(tmp_path)).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    left = {d: "before it come some words" if d == 103 else t for d, t in rows if d not in (101, 102)}  # 101 loses its lines, 102 is the phrase
    want = one_of_each([(d, t) for d, t in rows if d != 101]) - {102}
    inner = Tokenizer.from_file(default_tokenizer())
    assert {11, 21} & want == set() and {31, 100, 103} <= want
    assert set(lengths) == want
    assert all(abs(n - len(inner.encode(left[d], add_special_tokens=False).ids) - 1) <= (d == 103) for d, n in lengths.items())


# odd inputs of every stage

FILTERS = [(name, stage) for name, stage in P.STAGES[:-1]]
CLASHING = "_row _id _hash _cut _starts cls mark score predicted component_id n_shingles kind n id words items piece length".split()


def tables(spark, folder, *, labels=(), benchmark=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def clashing(spark, rows):
    values = [f"kept {c}" for c in CLASHING]
    return spark.createDataFrame([(d, t, None, None, None if t is None else len(t), *values) for d, t in rows], COLUMNS + "".join(f", {c} string" for c in CLASHING))


def test_the_classifier_rejects_what_the_labels_call_bad(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = P.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    good = [d in left for d, q in marked.items() if q == 1]
    bad = [d not in left for d, q in marked.items() if q == 0]
    assert sum(bad) >= 0.9 * len(bad) > 0 and sum(good) >= 0.95 * len(good)
    assert left < {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    empty = clashing(spark, [])
    for _, stage in FILTERS:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert P.best_fit_packing(spark, empty, str(tmp_path)).count() == 0
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_clashing_names_nulls_and_repeats(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    lines = "\n".join(f"line {i} of some words" for i in range(3000))
    rows = [(1, text), (2, None), (3, ""), (None, "no id here"), (5, lines), (6, "a plain text of its own")]
    tables(spark, tmp_path, benchmark=[(1, None), (None, "..."), (2, "a phrase that no document holds at all, to be sure")])
    docs = clashing(spark, rows)
    for name, stage in FILTERS:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == f"kept {c}" for r in got for c in CLASHING), name
        # a text without words gives no piece of the benchmark and no shingle: it is nobody's copy
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((d or 0, t or "") for d, t in rows), name
    twice = clashing(spark, [*rows, *rows])
    once = P.near_duplicates(spark, twice, str(tmp_path))
    assert once.where("doc_id = 1").count() == 1  # repeated rows are one group
    assert once.where("doc_id in (2, 3) or doc_id is null").count() == 6  # without words or an id a row is in none
    packed = P.best_fit_packing(spark, twice, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, None, 5, 6} and len([r for r in packed if r.doc_id == 2]) == 2
