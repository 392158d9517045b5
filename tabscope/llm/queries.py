"""Queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import (
    chat,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    filter_audit,
    language_id,
    licenses,
    lm_scoring,
    packing,
    quality_ledger,
    sharding,
    simhash,
    token_counts,
)
from tabscope.plans.scratch import materialise, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """The lengths of all documents under the byte-level encoding, each followed by an end token."""
    lengths = token_counts.token_lengths(table(spark, sf, "documents"), extra=1)
    histogram = materialise(token_counts.length_histogram(lengths), "lengths")
    return token_counts.suffix_sums(histogram)


@query("op2_deleted_interpolation")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All documents under a model of four fifths of them."""
    return lm_scoring.score_held_out(table(spark, sf, "documents"))


def _license_sql() -> str:
    """Containment of every template in every window, and phrases looked up at every word."""
    found = licenses.templates_of(licenses.TEMPLATES, licenses.PHRASES, licenses.CONTAINMENT)
    alike = ", ".join(
        f"({[str(w) for w in t.words]}, {t.need}, '{t.label}')" for t in found if not t.phrase
    )
    places = "\nUNION ALL\n".join(
        f"SELECT row, i - 1 AS place, '{t.label}' AS label "
        "FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM documents_words) "
        "WHERE " + " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(t.words))
        for t in found
        if t.phrase
    )
    step = licenses.window_step(found)
    return f"""
    WITH lower_texts AS (SELECT row_number() OVER () AS row, doc_id, {LOWER_SQL} AS text FROM documents),
    documents_words AS (
      SELECT row, doc_id, regexp_extract_all(text, '{licenses.WORD}') AS words FROM lower_texts),
    window_words AS (
      SELECT row, list_distinct(words[i + 1:i + {2 * step}]) AS words
      FROM (SELECT row, words, unnest(range(0, len(words), {step})) AS i FROM documents_words)),
    templates(words, need, label) AS (VALUES {alike}),
    alike AS (
      SELECT row, label, len(list_intersect(l.words, t.words)) / len(t.words) AS containment
      FROM window_words l, templates t WHERE len(list_intersect(l.words, t.words)) >= t.need),
    places AS ({places}),
    base AS (
      SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY row),
    labels AS (
      SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
      FROM (SELECT row, label, containment FROM alike UNION ALL SELECT row, label, 1.0 FROM places)
      GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0.0)::DOUBLE AS score
    FROM documents_words LEFT JOIN base USING (row) LEFT JOIN labels USING (row)
    """


@query("op3_license_scan", _license_sql())
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against the customary notices and phrases."""
    return licenses.scan_licenses(table(spark, sf, "documents"))


CONTROL = f"{chat.END}{chat.START}assistant ok"


@query(
    "op4_chat_windows",
    rf"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
    turns AS (
      SELECT *, row_number() OVER w - 1 AS no, sum(tokens) OVER w - tokens AS place FROM (
        SELECT *, 4 + len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')) AS tokens,
          {len(chat.START) + len(chat.END) + 2} + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
            + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars
        FROM said)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
    system AS (SELECT conv_id, tokens, chars FROM turns WHERE no = 0 AND role = 'system'),
    placed AS (
      SELECT t.*, place // step AS a, (place + t.tokens - 1) // step AS b FROM (
        SELECT t.*, coalesce(s.tokens, 0) AS held,
          CASE WHEN coalesce(s.tokens, 0) < {chat.BUDGET} THEN least(
              greatest({chat.BUDGET - chat.HISTORY} - coalesce(s.tokens, 0), {chat.BUDGET // 4}),
              {chat.BUDGET} - coalesce(s.tokens, 0))
            ELSE {chat.BUDGET // 4} END AS step
        FROM turns t LEFT JOIN system s ON t.conv_id = s.conv_id) t),
    spans AS (
      SELECT conv_id, a, b, min(place) AS place, min(no) AS no, sum(tokens) AS tokens,
        greatest(0, least({chat.HISTORY}, {chat.BUDGET} - max(held) - sum(tokens))) AS room
      FROM placed GROUP BY ALL),
    pieces AS (
      SELECT conv_id, a, b, chars, tokens FROM placed
      UNION ALL
      SELECT s.conv_id, s.a, s.b, p.chars, p.tokens FROM spans s JOIN placed p ON p.conv_id = s.conv_id
        AND p.no < s.no AND p.place >= s.place - s.room AND NOT (p.no = 0 AND p.role = 'system')
      UNION ALL
      SELECT s.conv_id, s.a, s.b, y.chars, y.tokens FROM spans s JOIN system y ON y.conv_id = s.conv_id
      WHERE s.no > 0),
    windows AS (
      SELECT conv_id, a, b, sum(chars) AS chars, sum(tokens) AS tokens FROM pieces GROUP BY ALL),
    digests AS (
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256
      FROM turns GROUP BY conv_id)
    SELECT d.*, w.formatted_chars, w.n_windows, w.max_tokens
    FROM digests d JOIN (
      SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows, max(tokens)::BIGINT AS max_tokens
      FROM windows GROUP BY 1) w USING (conv_id)
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, and one that says the marks of the template."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat.conversation_digests(chat.budgeted_windows(given.unionByName(marks)))


@query("op5_simhash_components")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: three-word shingles, links at three or fewer differing bits."""
    return simhash.simhash_components(table(spark, sf, "documents"), width=3, radius=3)


@query("op6_rendezvous_shards")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All documents over 24 shards of equal weight."""
    return sharding.shard_documents(table(spark, sf, "documents"), [1.0] * 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query("op7_packed_sequences")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packing.pack_documents(table(spark, sf, "documents"), packing.CAPACITY)


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    return language_id.identify(table(spark, sf, "documents"))


@query("op9_benchmark_passages")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item that a document holds with at most a fifth of its words edited."""
    return decontaminate.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op10_digest_index",
    f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one batch of a new index."""
    path = scratch_folder(spark, "digest-index")
    index = exact_dedup.DigestIndex(spark, path.rpartition("/")[2].replace("-", "_"), path, buckets(spark))
    digests = materialise(
        exact_dedup.text_digests(table(spark, sf, "documents"), keep=["doc_id"]), "digests"
    )
    index.add(digests, "documents")
    return index.verdicts(digests, "documents")


@query(
    "op11_fill_in_middle",
    rf"""
    WITH given AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_in_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents),
    units AS (
      SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM given),
    cuts AS (
      SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
          OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM units),
    parts AS (
      SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
        array_to_string(units[b + 1:n], '') AS s
      FROM cuts)
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut at two lines; the text is restored from the output and its form alone."""
    written = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return written.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )


@query(
    "op12_filter_audit",
    r"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
    known AS (
      SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    bits AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS failed
      FROM words w LEFT JOIN known k ON w.doc_id = k.doc_id),
    counts AS (
      SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY 1, 2),
    letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (
      SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    steps AS (
      SELECT o.filter_order, s.step, l.letter, l.bit,
        (SELECT coalesce(sum(x.bit), 0) FROM letters x
         WHERE contains(substr(o.filter_order, 1, s.step - 1), x.letter))::INT AS before
      FROM orders o, (SELECT unnest(range(1, 6)) AS step) s, letters l
      WHERE substr(o.filter_order, s.step, 1) = l.letter),
    results AS (
      SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (failed & before <> 0 AND failed & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS toxic_lost
      FROM counts, steps GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
      redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
      toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM results
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Five filters over all documents by source, in all 120 orders."""
    return filter_audit.audit_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _ledger_sql() -> str:
    """Measurements by regular expressions, windows one by one; the rules' conditions are the same text."""
    bits = " + ".join(f"({r.fails})::BIGINT * {1 << i}" for i, r in enumerate(quality_ledger.RULES))
    base = quality_ledger.mask_of(quality_ledger.BASE, quality_ledger.RULES)
    fatal = quality_ledger.mask_of(quality_ledger.POLICY.fatal, quality_ledger.RULES)
    window = quality_ledger.WINDOW
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
      FROM texts),
    windows AS (
      SELECT row, i, count(*) OVER (PARTITION BY row, said) AS times FROM (
        SELECT row, i, array_to_string(words[i:i + {window - 1}], ' ') AS said
        FROM (SELECT row, words, unnest(range(1, len(words) - {window - 2})) AS i FROM words))),
    repeats AS (
      SELECT row, count(DISTINCT i + j) AS n_repeat_words
      FROM windows, (SELECT unnest(range(0, {window})) AS j) WHERE times > 1 GROUP BY row),
    measures AS (
      SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
        len([x FOR x IN words IF regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')])::BIGINT AS n_lettered,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM words LEFT JOIN repeats USING (row)),
    ledger AS (SELECT *, {bits} AS failed FROM measures)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      failed & {base} <> 0 AS base_failed, failed & {fatal} = 0 AS kept, n_capitals, n_lettered, n_lines, failed,
      '{quality_ledger.RULES_VERSION}' AS rules_version, '{quality_ledger.POLICY.version}' AS policy
    FROM ledger
    """


@query("op13_quality_ledger", _ledger_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in the ledger, under the usual policy."""
    measures = quality_ledger.measured(table(spark, sf, "documents"))
    ledger = materialise(quality_ledger.with_bits(measures), "quality-ledger")
    return ledger.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality_ledger.failed_any(quality_ledger.BASE).alias("base_failed"),
        quality_ledger.keeps(quality_ledger.POLICY).alias("kept"),
        "n_capitals",
        "n_lettered",
        "n_lines",
        "failed",
        "rules_version",
        F.lit(quality_ledger.POLICY.version).alias("policy"),
    )
