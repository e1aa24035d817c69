"""Phrases, WARC bundles and resampling against plain versions, and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from brute import LOW

from tessera.llm import phrases, registry, resample, warc

SF = "/root/testdata/sf0.001"


# phrases


def plain_phrases(rows, least, longest=4, top=2000, within=80):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    around = {}
    for (lang, q), b in found.items():
        for m in range(2, len(q)):
            for i in range(len(q) - m + 1):
                key = lang, q[i : i + m]
                around[key] = max(around.get(key, 0), b)
    out = {}
    for (lang, p), a in found.items():
        if 100 * around.get((lang, p), 0) < within * a or (lang, p) not in around:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def sentences(seed, n=150):
    r = random.Random(seed)
    words = ["a", "B", "ß", "der", "im", "x-y", "Ü", "日本", "c\x01", "(d)"]
    fixed = ["in the end of it", "A b ß der im x", "der im"]
    return ["".join(r.choice([*words, *fixed]) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 90])
def test_phrases_are_those_of_a_plain_count(spark, shard_bytes):
    r = random.Random(3)
    rows = [(t, r.choice(["en", "de", None])) for t in sentences(1)] + [(None, "en"), ("", None), ("a b " * 400, "long"), ("one. two, three", "few")] + [("a b ß", "en")] * 30
    docs = spark.createDataFrame([(t, x, "id", "n", 1) for t, x in rows], "text string, lang string, shard string, phrase string, n int").repartition(3)
    for least in (1, 5, 30):
        got = sorted(tuple(x) for x in phrases.collocations(docs, least=least, shard_bytes=shard_bytes).collect())
        assert got == plain_phrases(rows, least)
    some = sorted(tuple(x) for x in phrases.collocations(docs, least=5, longest=3, top=4, within=50, shard_bytes=shard_bytes).collect())
    assert some == plain_phrases(rows, 5, 3, 4, 50)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), (" .,", "en")], docs.schema)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    """The score's product is taken in decimals: 2000000 * a for a near the largest long."""
    big = 9_000_000_000_000_000_000
    value = spark.sql(f"select cast(2000000 as decimal(7,0)) * cast({big} as decimal(19,0)) div (cast({big} as decimal(19,0)) + cast({big} as decimal(19,0))) as v").first().v
    assert value == 1000000


def test_lists_of_a_shard_are_kept_as_gaps():
    sizes = np.array([3, 1, 2])
    positions = np.array([2, 5, 9, 0, 1, 7])
    assert (phrases._from_gaps(phrases._to_gaps(positions, sizes), sizes) == positions).all()


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, digest string, first string, n int")


def odd_pages():
    long = "é" * 60
    return [
        (5, "http://a/ b\r\nX: y", long),
        (3, None, long),
        (9, "u", long),
        (9, "u", long),
        (None, "u", long),
        (1, "u", "é" * 49),
        (2, "u", "é" * 49),
        (4, "u", None),
        (6, "u", ""),
        (7, "u", "WARC/1.1\r\n\r\n" * 40 + "\r\n\r\n"),
        (8, "u", "z" * 300000),
    ]


@pytest.mark.parametrize("sizes", [(1 << 20, 64 << 20), (400, 300)])
def test_warc_round_trip(spark, sizes):
    rows = odd_pages()
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(pages(spark, rows).repartition(3), folder, frame_bytes=sizes[0], bundle_bytes=sizes[1])
    records = warc.read_bundles(index, folder)
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        later = len(raw) >= 100 and (page is None or page > min(same))
        want.append((-1 if page is None else page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", min(same) if later else None))
    assert got == sorted(want)
    back = sorted((-1 if r.page_id is None else r.page_id, r.html) for r in warc.restore(records).collect())
    assert back == sorted((-1 if p is None else p, h or "") for p, _, h in rows)
    assert {r.url for r in records.collect() if r.page_id in (3, 5)} == {None, "http://a/%20b%0D%0AX:%20y"}
    one = warc.lookup(index, spark.createDataFrame([(8,), (5,), (77,), (None,)], "page_id long"), folder).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in one) == [(0, "revisit"), (5, "revisit"), (8, "response")]


def test_bundles_are_plain_zstandard(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(pages(spark, odd_pages()).coalesce(1), folder, frame_bytes=500)
    system, base = pafs.FileSystem.from_uri(folder)
    name = index.first().bundle
    with open(f"{base}/{name}", "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.count(b"WARC-Record-ID") == len(odd_pages()) == index.count() == len(list(warc.parse(whole)))
    with system.open_input_file(f"{base}/{name}") as f:
        frames = warc.read_seek_table(f)
    for r in index.collect():
        place, size = frames[r.frame]
        with open(f"{base}/{name}", "rb") as f:
            f.seek(place)
            plain = zstandard.ZstdDecompressor().decompress(f.read(size))
        assert warc.record_id(r.page_id).encode() in plain[r.offset : r.offset + r.length].split(b"\r\n\r\n")[0]


def test_broken_bundles_are_noticed_and_pruned(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(pages(spark, odd_pages()), folder)
    system, base = pafs.FileSystem.from_uri(folder)
    with open(f"{base}/bundle-lost.warc.zst", "wb") as f:
        f.write(b"cut off")
    with system.open_input_file(f"{base}/bundle-lost.warc.zst") as f, pytest.raises(ValueError):
        warc.read_seek_table(f)
    assert warc.prune(index, folder) == 1 and "bundle-lost.warc.zst" not in os.listdir(base)
    record = warc.to_record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, False, "d")
    with pytest.raises(ValueError):
        list(warc.parse(record))


def test_warc_of_an_empty_table(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(pages(spark, []), folder)
    assert index.count() == 0 and warc.read_bundles(index, folder).count() == 0


# resampling


def plain_draw(docs, target, percent=10, least=20, longest=1, buckets=10000, seed="2024"):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, other = [(d, *found(t)) for d, t in docs], [found(t)[1] for t in target]
    s, t = Counter(b for _, _, x in own for b in x), Counter(b for x in other for b in x)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((float(t[b] + 1) * float(s_all)) / (float(s[b] + 1) * float(t_all))))
    rows = []
    for d, n, x in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in x)
        rows.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 50, "longest": 3, "buckets": 50}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_resample_is_the_plain_draw(spark, options):
    docs = list(enumerate(sentences(2, 200))) + [(900, None), (901, ""), (None, "a b " * 30), (902, "der im " * 9000), (903, "a b " * 10), (903, "a b " * 10), (903, "a b " * 12)]
    bench = ["the end of it", None, "der im der im", "日本 ß"]
    table = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, weight string, rank int").repartition(5)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    got = sorted((tuple(r) for r in resample.resample(table, target, **options).collect()), key=str)
    renamed = {("least" if k == "least_words" else k): v for k, v in options.items()}
    assert got == plain_draw(docs, bench, **renamed)


@pytest.mark.parametrize("sizes", [(1 << 19, 4096, 1 << 18), (37, 5, 20), (8, 1, 3), (50, 7, 1000)])
@pytest.mark.parametrize("percent", [0, 7, 33, 100])
def test_draw_by_runs_blocks_and_ranges(spark, sizes, percent):
    r = random.Random(5)
    rows = [(i if i % 50 else None, 30, r.randint(-3, 3), r.choice([0, 0, 5, r.randint(-40, 40)]), 30 if i % 9 else 3) for i in range(400)]
    rows += [(3, 30, 0, 5, 30)] * 60  # equal rows, and a hot score
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, n_words long").repartition(4)
    got = resample.draw(scored, percent=percent, run_rows=sizes[0], block_rows=sizes[1], range_rows=sizes[2]).collect()
    order = sorted((x for x in rows if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    want = [(*x[:4], i + 1) for i, x in enumerate(order[: percent * len(order) // 100])]
    assert sorted((tuple(g) for g in got if g.rank is not None), key=lambda g: g[4]) == want
    assert len(got) == len(rows) and Counter(tuple(g)[:4] for g in got) == Counter(x[:4] for x in rows)


def test_tournament_names_winner_and_challenger():
    r = random.Random(1)
    tree = resample.Tournament(8)
    for _ in range(200):
        tree.set(r.randrange(8), (r.randint(0, 9),))
        heads = sorted((h, i) for i, h in enumerate(tree.heads))
        assert tree.heads[tree.best()] == heads[0][0] and tree.challenger() == heads[1][0]


def test_resample_of_empty_tables(spark):
    docs, bench = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert resample.resample(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "w " * 30)], docs.schema)
    assert resample.resample(one, bench, percent=100).first().rank == 1


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_warc_bundles", "op13_importance_resampling"])
def test_new_queries_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    text = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).map(lambda v: v if v is None or isinstance(v, str) else int(v)).values.tolist()))
    assert text(got) == text(want)
