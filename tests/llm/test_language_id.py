import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import language_id
from tabscope.llm.language_id import Scorer, fit, has_letter, keep_recognised, predict, training_sample, with_usual_shares
from tabscope.llm.queries import QUERIES

ENGLISH = "the cat sat on the mat and looked at the garden while rain fell over the town".split()
GERMAN = "die katze sass auf der matte und schaute in den garten während regen über die stadt fiel".split()


def made(n=200):
    r = random.Random(3)
    rows = []
    for i in range(n):
        words, lang = (ENGLISH, "en") if i % 2 else (GERMAN, "de")
        rows.append((i, " ".join(r.choice(words) for _ in range(12)), lang))
    return rows


def test_query_held_out_rows_and_contract(spark, folder):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 ² _!", "de"), (1003, "GARTEN", None), (3, "the mat", "en"), (None, "die stadt", "de")]
    rows = made() + odd
    got = QUERIES["op8_language_id"](spark, folder(*rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in made()}
    for r in got:
        crc = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        assert r.held_out == (crc % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in truth and r.doc_id != 3:
            assert r.lang_pred == truth[r.doc_id]
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "de"]


def brute(rows):
    """Words by frequency, else the mean of their longest known n-grams, one document after the other."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams_of = lambda w, n: [x[i : i + n] for x in [f" {w} " if n > 1 else w] for i in range(len(x) - n + 1)]
    taught = [(t, lang) for i, t, lang in rows if lang is not None and crc(i) != 2]
    sizes = Counter(lang for _, lang in taught)
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    counts = [{x: Counter() for x in langs} for _ in range(6)]
    for t, lang in taught:
        for w in words_of(t):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams_of(w, n))
    known = [set().union(*[c.keys() for c in level.values()]) for level in counts]

    def log(n, lang, item):
        own = counts[n][lang]
        return math.log((own[item] + 0.5) / (sum(own.values()) + 0.5 * (len(known[n]) + 1)))

    def score(lang, w):
        if w in known[0]:
            return log(0, lang, w)
        for n in range(5, 0, -1):
            found = [g for g in grams_of(w, n) if g in known[n]]
            if found:
                return sum(log(n, lang, g) for g in found) / len(found)
        return 0.0

    out = {}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[i] = (crc(i) == 2, "und", 0.0)
            continue
        total = [math.log(sizes[x] / len(taught)) + sum(score(x, w) for w in words_of(t)) for x in langs]
        best = max(range(len(langs)), key=lambda k: total[k])
        out[i] = (crc(i) == 2, langs[best], 1 / sum(math.exp(v - total[best]) for v in total))
    return out


def test_query_equals_brute_force(spark, folder):
    r = random.Random(8)
    pool = {"en": ENGLISH, "de": GERMAN, "xx": ["katz", "gardens", "mats", "übern", "水", "ja"]}
    rows = [(i, " ".join(r.choice(pool[x]) for _ in range(r.randint(0, 9))), x if r.random() < 0.8 else None) for i, x in enumerate(r.choices(list(pool), [5, 3, 1], k=240))]
    rows += [(900, None, "en"), (901, "12 ?!", "de"), (902, "水水 gartenmatte xyzzy", None), (None, "die town", None), (903, "the " * 2000, None)]
    want = brute(rows)
    got = QUERIES["op8_language_id"](spark, folder(*rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.held_out, x.lang_pred) == want[x.doc_id][:2] and x.score == pytest.approx(want[x.doc_id][2], abs=1e-9)


def test_real_languages_when_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in got)
    assert len(got) > 30 and right / len(got) > 0.95


def test_labels_and_ids_are_no_inputs(spark, documents):
    model = fit(documents(*made()))
    a = predict(documents((1, "the garden", "de"), (2, "die matte", "en")), model)
    assert [r.lang_pred for r in a.orderBy("doc_id").collect()] == ["en", "de"]


def test_scores_follow_the_definition(documents):
    """Known words by smoothed frequency, an unseen word by its longest known n-grams."""
    model = fit(documents((1, "ab ab cd", "x"), (2, "ab ef", "y"), (3, "ef", "y")))
    assert model.languages == ["y", "x"]
    words = {"x": Counter(ab=2, cd=1), "y": Counter(ab=1, ef=2)}
    v = 3
    def log(lang, w):
        return np.log((words[lang][w] + 0.5) / (sum(words[lang].values()) + 0.5 * (v + 1)))
    scorer = Scorer(model)
    assert scorer.likelihoods("ab") == pytest.approx([np.log(2 / 3) + log("y", "ab"), np.log(1 / 3) + log("x", "ab")])
    # " abz ": no 5-, 4-gram is known; " ab" is the only known 3-gram.
    threes = {"x": Counter({" ab": 2, "ab ": 2, " cd": 1, "cd ": 1}), "y": Counter({" ab": 1, "ab ": 1, " ef": 2, "ef ": 2})}
    want = [np.log((threes[x][" ab"] + 0.5) / (6 + 0.5 * 7)) for x in ("y", "x")]
    assert scorer.unseen("abz") == pytest.approx(want)
    assert " " not in model.grams and scorer.unseen("水") == pytest.approx([0, 0])


def test_a_script_never_learned_gets_the_language_of_most_documents(documents):
    docs = [(i, "die katze sass auf der matte", "de") for i in range(30)] + [(100 + i, "a cat is on it", "en") for i in range(9)]
    model = fit(documents(*docs))
    got = predict(documents((1, "政府は新しい法律を発表した " * 50), (2, "правительство " * 90)), model).collect()
    assert {r.lang_pred for r in got} == {"de"} and all(r.score == pytest.approx(30 / 39) for r in got)


@pytest.mark.parametrize("most", [1, 4, 7, 100, 10_000])
def test_every_language_keeps_its_most_frequent_items(documents, most):
    """Words that all occur once, and a rare language beside a large one."""
    large = [(i, " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x{chr(97 + j)}" for j in range(8)), "big") for i in range(60)]
    docs = documents(*large, (900, "uno due uno", "rare"), (901, "uno tre", "rare"))
    model = fit(docs, max_words=most)
    of = lambda lang: sorted(w for w, i in model.words.items() if (len(w) == 5) == (lang == "big"))
    share = min(3, most // 2)
    assert of("rare") == sorted(["uno", "due", "tre"][:share])
    everything = sorted(w for _, t, _ in large for w in t.split())
    assert of("big") == everything[: most - share]


def test_shares_of_a_bound():
    assert language_id._shares({"a": 10, "b": 2, "c": 10}, 12) == {"b": 2, "a": 5, "c": 5}
    assert language_id._shares({"a": 1, "b": 1}, 1) == {"a": 0, "b": 1}
    assert language_id._shares({}, 5) == {}


def test_executors_need_not_have_the_package(tmp_path):
    """Only the driver's search path has it; workers start elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "driver.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "rows = [(i, 'the cat sat' if i % 2 else 'die katze sass', 'en' if i % 2 else 'de', 's', 9) for i in range(40)]\n"
        "docs = s.createDataFrame(rows, 'doc_id long, text string, lang string, source string, n_chars long')\n"
        "try:\n"
        "    s.range(1).rdd.map(lambda _: __import__('tabscope')).collect(); print('importable')\n"
        "except Exception: pass\n"
        "from tabscope.llm import language_id as li\n"
        "print(li.identify(docs).filter('lang_pred in (\"en\", \"de\")').count())\n"
        "print(li.keep_recognised(docs, li.with_usual_shares(docs, li.fit(docs))).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["40", "40"], out.stderr[-2000:]


def test_known_shares_follow_the_counts(documents):
    """The share of n-grams that the language has, one by one from the model's counts."""
    model = fit(documents(*made()))
    scorer = Scorer(model)
    for text in ("the garden, katze über a", "x", "die die xqz", "", None, "я水"):
        for language in range(2):
            grams = [g for w in language_id._words(text) for g in language_id._familiar_grams(w)]
            counts, least = scorer._counts(grams, language) if grams else ([], [])
            want = float(np.mean(np.asarray(counts) >= np.asarray(least))) if grams else None
            assert scorer.known_share(text, language) == want


def test_sample_is_bounded(documents):
    rows = training_sample(documents(*made(120), (500, "x", None)), per_language=7).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in rows} == {"en": 7, "de": 7}


def test_small_cache_changes_nothing(documents, monkeypatch):
    model = fit(documents(*made()))
    text = " ".join(f"{w}{'abcdefgh'[i % 8]}" for i, w in enumerate(ENGLISH * 40))
    want = Scorer(model).likelihoods(text)
    monkeypatch.setattr(language_id, "CACHED_WORDS", 8)
    assert Scorer(model).likelihoods(text) == pytest.approx(want)


def test_empty_tables_long_texts_and_columns_kept(spark, documents):
    assert language_id.identify(documents()).collect() == []
    assert [r.lang_pred for r in language_id.identify(documents((1, "a b"))).collect()] == ["und"]
    model = fit(documents(*made()))
    docs = spark.createDataFrame(
        [(1, "the garden " * 50_000, "p", 0.5), (2, "12", "q", 1.0), (3, None, "r", 2.0)],
        "doc_id bigint, text string, letters string, score double",
    )
    kept = keep_recognised(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert docs.select(has_letter(docs.text).alias("x")).filter("x").count() == 1


def test_texts_in_no_learned_language_go(documents):
    """Whatever their length and however uneven the labels; clean short texts stay."""
    docs = documents(*made(), *[(2000 + i, t, "en") for i, t, lang in made() if lang == "en"])
    model = with_usual_shares(docs, fit(docs))
    assert len(model.usual) == 2 and min(model.usual) > 0.9
    foreign = ["Правительство объявило новый закон о пенсиях", "政府は新しい法律を発表した", "η κυβέρνηση ανακοίνωσε", "rząd przedstawił nową ustawę o emeryturach", "я", "xq zvk wjq kpx"]
    clean = ["the", "the mat.", "GARTEN", "Regen über die Stadt", "the garden, 12 34 !!", "rain fell"]
    rows = [(i, t * n) for i, (t, n) in enumerate([(f"{t} ", n) for t in foreign for n in (1, 300)])]
    rows += [(100 + i, t) for i, t in enumerate(clean)]
    kept = {r.doc_id for r in keep_recognised(documents(*rows), model).collect()}
    assert kept == set(range(100, 100 + len(clean)))


def test_a_left_out_language_goes_and_a_learned_one_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    taught = docs.filter("lang <> 'es' AND doc_id % 2 = 0")
    model = with_usual_shares(taught, fit(taught))
    new = docs.filter("doc_id % 2 = 1").select("doc_id", "text", "lang")
    rows = {r["lang"]: r["count"] for r in new.groupBy("lang").count().collect()}
    kept = {r["lang"]: r["count"] for r in keep_recognised(new, model).groupBy("lang").count().collect()}
    assert kept.get("es", 0) <= 0.05 * rows["es"]
    assert all(kept[x] >= 0.95 * rows[x] for x in ("en", "de", "fr"))


def test_a_language_of_one_document_stays(documents):
    docs = documents(*made(), (7000, "kissa istui matolla ja katsoi puutarhaa", "fi"))
    model = with_usual_shares(docs, fit(docs))
    assert model.usual[model.languages.index("fi")] < 0.5
    assert 7000 in {r.doc_id for r in keep_recognised(docs, model).collect()}
