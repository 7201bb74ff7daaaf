import math
import re

import pytest

from lexiweave.llm import licenses


def brute(text, templates=licenses.TEMPLATES):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, low)
    base = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, score = {b for _, b in base}, 1.0 if base else 0.0
    for label, t, must in templates:
        n, t = math.ceil(1.5 * len(t.split())), set(t.split())
        for at in range(len(words)):
            b = set(words[at : at + n])
            if len(t & b) >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9) and set(must.split()) <= b:
                labels.add(label)
                score = max(score, len(t & b) / len(t))
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score)


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining
// a copy of this software and associated documentation files
// (the "Software"), to deal in the Software without
// restriction"""
TEXTS = [
    None, "", "   ", "Nothing here", "All rights\nreserved. All RIGHTS-reserved", "Licensed under CC BY-NC 4.0.", "x ccby cc é by",
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "licence under the mit released",
    "This work is licensed under the GNU General Public License, version 3." * 3, "general public\tlicense" + " w" * 30000 + " cc by",
    "apache license\nversion 2 0 under licensed the", WRAPPED, "Released under the BSD License", "Licensed under CC BY 4.0",
    "released " + "x " * 9 + "under the " + "y " * 9 + "mit license", "worK This worK is licensed under GNU General Public, version 3",
    "by by by licensed licensed under cc x by 4", ("licensed under the " * 400 + "gnu lesser general public license "),
]


def test_scan_matches_brute_force(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], 0), (4, TEXTS[4], 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    for g, (i, t, _) in zip(sorted(map(tuple, got), key=key), sorted(rows, key=lambda r: r[0] if r[0] is not None else -1), strict=True):
        assert g[1:-1] == brute(t)[:-1] and abs(g[-1] - brute(t)[-1]) < 1e-12, (i, g, brute(t))


@pytest.mark.parametrize("text,labels", [(WRAPPED, "mit"), ("Released under the BSD License", ""), ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("released " + "x " * 9 + "under the " + "y " * 9 + "mit license", "")])
def test_wrapped_notices_and_neighbours(text, labels):
    assert brute(text)[5] == labels


def test_empty_table_and_low_threshold(spark):
    df = spark.createDataFrame([(1, "released by the mit")], "doc_id long, text string")
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df).first().labels == ""
    assert licenses.scan(df, threshold=0.5).first().labels == "mit"
