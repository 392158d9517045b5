import random
from collections import defaultdict

import corpus_pipeline
from tabscope.llm.decontaminate import words_of
from tabscope.llm.tokenizing import WORD_BPE, WordBpe, vocabulary
from tests.llm.test_decontaminate import brute_match
from tests.llm.test_simhash import brute_components, brute_fingerprint

EN = "the of and to in that is was for with".split()
DE = "der die das und ist nicht ein mit den auf".split()


def corpus():
    r = random.Random(12)
    rows = []
    for i in range(160):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        own = [r.choice(words) if r.random() < 0.5 else f"{r.choice(words)}{r.choice('abcdefgh')}{r.choice(words)}" for _ in range(r.randint(60, 200))]
        rows.append((i, " ".join(own), lang))
    items = [(j, " ".join(rows[j][1].split()[5:25])) for j in (1, 2)]
    rows += [(200 + i, rows[i][1].upper().replace("É", "é"), rows[i][2]) for i in range(10, 20)]
    for i in range(20, 40):
        words = rows[i][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words), rows[i][2]))
    dirty = items[0][1].split()
    dirty[3] = "edited"
    rows += [(500, " ".join(rows[50][1].split()[:40] + dirty + rows[51][1].split()), "en")]
    rows += [(600, "12 34 !!", "en"), (601, None, "de"), (602, "", None), (603, "word " * 9000, "en")]
    return rows, items


def expected(rows, items):
    """Ids that each stage keeps, by brute force (all but the language, which keeps what has letters)."""
    docs = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    kept = [set(docs)]
    groups = defaultdict(list)
    for i, t in docs.items():
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(i)
    kept.append({max(g) for g in groups.values()})
    label = brute_components([(i, brute_fingerprint(docs[i])) for i in kept[-1]])
    kept.append({i for i in kept[-1] if label[i] == i})
    clean = set()
    for i in kept[-1]:
        words = words_of(docs[i])
        if len(words) > 5000 or all(brute_match(words_of(t), words) > int(0.2 * len(words_of(t)) + 1e-9) for _, t in items):
            clean.add(i)
    kept.append(clean)
    return docs, kept


def test_stages_against_brute_force(spark, folder):
    rows, items = corpus()
    path = folder(*rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts, kept = expected(rows, items)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontaminate", "packing"]
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], kept):
        out = stage(spark, docs, path)
        assert out.columns == columns
        docs = out.cache()
        assert {r.doc_id for r in docs.collect()} == want
    assert len(kept[0]) > len(kept[1]) > len(kept[2]) > len(kept[3]) > 100
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    bpe = WordBpe(vocabulary(WORD_BPE))
    lengths = defaultdict(int)
    for r in final:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(bpe.ids(texts[i])) // 4 + 1 for i in kept[-1]}


def test_run_and_an_empty_table(spark, folder):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    path = folder(benchmark=bench)
    assert corpus_pipeline.run(spark, path).collect() == []
