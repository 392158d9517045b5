import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tabscope.llm import licenses
from tabscope.llm.licenses import scan_licenses
from tabscope.llm.queries import QUERIES, SQL

NOTICES = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
]


def corpus():
    r = random.Random(6)
    words = ["the", "of", "license", "licensed", "under", "rights", "all", "cc", "by", "public", "general", "word", "É", "4", "0", "version", "mit", "released"]
    rows = []
    for i in range(250):
        lines = [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(r.randint(0, 4))]
        if i % 4 == 0:
            notice = r.choice(NOTICES).split()
            for _ in range(r.randint(0, 2)):
                notice[r.randrange(len(notice))] = r.choice(words)
            lines.insert(len(lines) // 2, " ".join(notice))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "cc\nby cc-BY, cc  by"), (903, "all RIGHTS\n\nreserved" * 2), (904, "general public license " * 20_000)]
    rows += [(905, "ccé by \x7f cc\x00by"), (906, "CC BY"), (906, "CC BY"), (None, "cc by")]
    return rows


def windows(words, step):
    return [set(words[i : i + 2 * step]) for i in range(0, len(words), step)]


def brute(rows):
    found = licenses.templates_of(licenses.TEMPLATES, licenses.PHRASES, licenses.CONTAINMENT)
    out = []
    for doc, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(licenses.WORD, text)
        starts, labels, base, score = [], set(), set(), 0.0
        for t in found:
            if t.phrase:
                at = [i for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
                if at:
                    base.add(t.label)
                    score = 1.0
                starts += at
                continue
            for window in windows(words, licenses.window_step(found)):
                shared = len(window & set(t.words))
                if shared >= licenses.CONTAINMENT * len(t.words) - 1e-9:
                    labels.add(t.label)
                    score = max(score, shared / len(t.words))
        out.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), score))
    return out


def test_query_equals_brute_force_and_its_sql(spark, folder):
    path = folder(*corpus())
    got = sorted(map(tuple, QUERIES["op3_license_scan"](spark, path).collect()), key=str)
    assert got == sorted(brute(corpus()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(SQL["op3_license_scan"]).fetchall(), key=str) == got
    assert sum(r[2] > 0 for r in got) > 5 and sum(r[6] != r[5] for r in got) > 20


def test_the_usual_notices_are_labelled(documents):
    rows = scan_licenses(documents(*enumerate(f"Some text.\n{n}\nMore." for n in NOTICES))).collect()
    assert [r.labels for r in sorted(rows)] == ["cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "apache-2.0", "mit", "reserved"]
    assert {r.score for r in rows} == {1.0}


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    "gpl": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public\n * License as published by",
    "gpl-3.0": "This work is licensed under the\nGNU General\nPublic License,\nversion 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
    "apache-2.0": "Licensed\nunder\nthe\nApache\nLicense,\nVersion\n2.0",
}


@pytest.mark.parametrize("before", [0, 1, 21, 22, 23, 35, 44, 45, 400])
def test_notices_broken_over_lines_are_labelled(spark, folder, before):
    rows = list(enumerate("filler\n" * before + text + "\nmore " * 30 for text in WRAPPED.values()))
    path = folder(*rows)
    got = QUERIES["op3_license_scan"](spark, path).orderBy("doc_id").collect()
    for label, r in zip(WRAPPED, got):
        assert label in r.labels.split(",") and r.score == 1.0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(SQL["op3_license_scan"]).fetchall()) == sorted(map(tuple, got))


@pytest.mark.parametrize("containment", [0.3, 0.5, 1.0])
def test_any_threshold(documents, containment):
    rows = corpus()
    got = scan_licenses(documents(*rows), containment=containment).collect()
    want = {}
    for doc, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        step = max(len(t.split()) for t in licenses.TEMPLATES)
        blocks = windows(re.findall(licenses.WORD, text), step)
        shares = [len(b & set(t.split())) / len(set(t.split())) for b in blocks for t in licenses.TEMPLATES]
        want[doc] = max([s for s in shares if s >= containment - 1e-9], default=0.0)
    for r in got:
        assert r.score == pytest.approx(1.0 if r.n_base else want[r.doc_id])


def test_own_templates_empty_tables_and_extra_columns(spark, documents):
    assert scan_licenses(documents()).collect() == []
    docs = spark.createDataFrame([(1, "x y z", "q", 3)], "doc_id int, text string, row string, n_words int")
    got = scan_licenses(docs, {"x z w": "mine"}, {"y z": "order"}, 0.6).first()
    assert (got.n_words, got.n_base, got.first_word, got.labels) == (3, 1, 1, "mine,order")
    with pytest.raises(ValueError):
        scan_licenses(docs, {}, {})


def test_words_at_both_ends_and_beyond_ascii(documents):
    texts = ["", " ", "\x00\x7f", ".cc by.", "cc by", " cc by", "cc by ", "\ncc\x00by\x7fcc by", "\u0085cc by", "cc\U0001F600 by", "cc \U00010400 by", "cc\u212A CC BY", "CC BY É."]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, scan_licenses(documents(*rows)).collect())) == brute(rows)


def seconds(df):
    best = float("inf")
    for _ in range(4):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def test_word_sets_cost_less_than_a_search_for_each_word(documents):
    r = random.Random(3)
    words = [w for t in licenses.TEMPLATES for w in t.split()] + [f"w{i}" for i in range(3_000)]
    docs = documents(*((i, " ".join(r.choices(words, k=5_000))) for i in range(400))).localCheckpoint()
    found = licenses.templates_of(licenses.TEMPLATES, licenses.PHRASES, licenses.CONTAINMENT)
    searched = docs.select(F.regexp_extract_all("text", F.lit(licenses.WORD), F.lit(0)).alias("words"))
    limit = seconds(searched)
    assert seconds(licenses.word_sets(docs, found)) < limit


def test_windows_are_joined_once_for_phrases_and_templates(documents):
    plan = scan_licenses(documents(*corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
