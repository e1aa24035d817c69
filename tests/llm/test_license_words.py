"""License scans with the frequencies of all words, against plain cosines."""

import math
import re

from tessera.llm import license_scan

LINE = "Released under the MIT License. All rights reserved."


def cosine(line, template, texts):
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    sets = [set(words(t)) for t in texts]
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in s for s in sets))) + 1
    a, b = ({w: words(t).count(w) * idf(w) for w in words(t)} for t in (line, template))
    return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_other_words_weigh_by_their_own_frequency(spark):
    texts = [LINE, "License " + LINE, *["all rights reserved"] * 60, *["released", "under", "the", "mit", "license"] * 20, *[f"plain w{i}" for i in range(40)]]
    files = spark.createDataFrame([(f"d{i}/x.txt", t) for i, t in enumerate(texts)] + [("n/x", None)], "path string, text string")
    got = {r.path: (r.license, r.cosine) for r in license_scan.scan(files).where("license is not null").collect()}
    want = cosine(LINE, "Released under the MIT License.", texts)
    assert want >= license_scan.THRESHOLD and got["d0/x.txt"][0] == "MIT" and abs(got["d0/x.txt"][1] - want) < 2e-6
    assert set(got) <= {"d0/x.txt", "d1/x.txt"}
    assert license_scan.scan(files.limit(0)).count() == 0
