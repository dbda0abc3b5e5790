"""Licences against a plain version: TF-IDF cosines, whole texts as licence files, nearest ancestors, ties, odd names."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyspark.llm import license_scan as L

CUE, TERM = re.compile(L.CUE), re.compile(L.TERM)


def plain(files, named):
    """{path: (license, from, source)} of unique paths."""
    words = lambda t: Counter(TERM.findall(t.lower()))
    pieces = [(p, w, words(t)) for p, text in files.items() if text and CUE.search(text) for w, t in [*((False, x) for x in text.split("\n") if CUE.search(x)), (True, text)]]
    pieces = [x for x in pieces if x[2]]
    df = Counter(t for _, _, c in pieces for t in c)
    idf = lambda t: math.log((len(pieces) + 1) / (df[t] + 1)) + 1
    weigh = lambda c: {t: n * idf(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    close = []
    for path, whole, c in pieces:
        v = weigh(c)
        for name, text in L.TEMPLATES:
            u = weigh(words(text))
            cosine = round(sum(v[t] * u[t] for t in v.keys() & u.keys()) / (norm(v) * norm(u)), 6)
            if cosine >= L.LEAST_COSINE:
                close.append((path, whole, -cosine, name))
    best = lambda rows: min(rows)[1] if rows else None
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    out = {}
    for path in files:
        own = best([(c, n) for p, _, c, n in close if p == path])
        out[path] = (own, path, "header") if own else (None, None, "none")
        at = folder(path)
        while not own:
            found = best([(c, n) for p, w, c, n in close if folder(p) == at and (w or named(p))])
            if found:
                out[path] = (found, at, "directory")
            if found or not at:
                break
            at = folder(at) if "/" in at else ""
    return out


def test_licences_against_a_plain_version(spark):
    long_text = L.TEMPLATES[1][1] + "\n" + " ".join([L.TEMPLATES[1][1]] * 3)
    files = {
        "a/LICENSE": "Released under the MIT License.", "a/b/x.py": "import os", "a/y.py": "text\nLicensed under the Apache License, Version 2.0.\nmore " * 3, "a/b/c/whole": long_text, "a/b/c/d/z": "nothing",
        "c/z.py": "no notice here", "e/COPYING": "GNU General Public License, version 3.\n" + L.TEMPLATES[4][1], "e/f/g/h": "", "e/prose": "The copyright of this poem is unknown, and so on and on for many words " * 5, "top": None, "k/two": "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.", "k/n": "plain",
    }
    df = spark.createDataFrame([(p, t, 1, 2, 3, 4) for p, t in files.items()], "path string, text string, d int, _path int, _dir int, row int")
    got = L.scan(df).collect()
    assert {r.path: (r.license, r.license_from, r.license_source) for r in got} == plain(files, lambda p: re.search(L.FILE_NAME, p))
    assert all((r.d, r._path, r._dir, r.row) == (1, 2, 3, 4) for r in got)


def test_documents_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    files = {f"{d.source or '_'}/{d.lang or '_'}/{d.doc_id}": d.text for d in docs}
    got = {r.path: (r.license, r.license_from, r.license_source) for r in L.op1_license_scan(spark, sf).collect()}
    assert got == plain(files, lambda p: False)


def test_repeated_paths_and_nulls(spark):
    df = spark.createDataFrame([("a/x", "Released under the MIT License."), ("a/x", "nothing"), (None, "MIT License"), ("", ""), (None, None)], "path string, text string")
    got = sorted((r.path or "-", r.license_source, r.license or "-") for r in L.scan(df, is_license_file=F.lit(None).cast("boolean")).collect())
    assert got == [("-", "none", "-"), ("-", "none", "-"), ("-", "none", "-"), ("a/x", "header", "MIT"), ("a/x", "header", "MIT")]
