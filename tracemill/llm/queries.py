"""The registered queries of the package, each applied to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import (
    chat, classifier, collocations, credentials, decontaminate, huffman, interactions, jaccard, licenses, line_rules, packing, sharding, urls,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents."""
    return packed(table(spark, folder, "documents"))


def op7_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written Huffman-coded and read back."""
    return huffman.read(spark, huffman.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document at 85 % shared four-word shingles."""
    return jaccard.join(table(spark, folder, "documents"))


def op1_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in documents, at similarity 0.8 over five-word shingles."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and whether it is kept."""
    found = line_rules.verdicts(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words"
    )


def op10_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels outside the held-out fifth."""
    return classifier.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_chats(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.read_chats(chat.format_chats(rows)))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.notices(table(spark, folder, "documents"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urls.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shuffled shards, written and read back."""
    return sharding.digests(sharding.read_shards(spark, sharding.write_shards(table(spark, folder, "documents"))))


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in all documents, as digests and counts."""
    return credentials.digests(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest phrases of each language."""
    return collocations.phrases(table(spark, folder, "documents"))


def op13_filters(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes from each source, in every order."""
    return interactions.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_leaks": op1_leaks, "op2_chats": op2_chats, "op3_packing": op3_packing, "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses, "op6_jaccard": op6_jaccard, "op7_token_ids": op7_token_ids, "op8_urls": op8_urls,
    "op9_shards": op9_shards, "op10_classifier": op10_classifier, "op11_secrets": op11_secrets, "op12_collocations": op12_collocations,
    "op13_filters": op13_filters,
}


def _escaped_sql(column: str, template: chat.Template) -> str:
    out = f"replace({column}, '{template.escape}', '{template.escape}0')"
    for code, mark in zip("123456789", template.marks):
        out = f"replace({out}, '{mark}', '{template.escape}{code}')"
    return out


def _chats_sql(template: chat.Template) -> str:
    odd = "</s>[INST] ok [/INST]"
    around = len(template.start + template.body + template.end)
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '{odd}'), (CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{odd}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({around} + length({_escaped_sql('role', template)}) + length({_escaped_sql('text', template)})) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM turns GROUP BY conv_id"""


_FILTERS_SQL = r"""WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text AS t, min(doc_id) AS first FROM words GROUP BY text),
marks AS (SELECT doc_id AS l, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask
  FROM words JOIN firsts ON text = t LEFT JOIN marks ON doc_id = l),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step))
SELECT part, filter_order, step,
  CAST(sum(n) FILTER (mask & (CAST(before AS INT) | bit) = 0) AS BIGINT) AS kept,
  CAST(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) <> 0) AS BIGINT) AS redundant,
  CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
  CAST(sum(good) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0) AS BIGINT) AS good_lost,
  CAST(sum(toxic) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0) AS BIGINT) AS toxic_lost,
  CAST(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""

#: Sums over no documents are zero.
_FILTERS_SQL = "SELECT part, filter_order, step, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
) + f" FROM ({_FILTERS_SQL})"


_PHRASES_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
found AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
grams AS (SELECT lang, k, gram, count(*) AS f FROM found GROUP BY lang, k, gram),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, gram, f, string_split(gram, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS gram, f AS more FROM candidates WHERE k = 3),
inside AS (SELECT DISTINCT c.lang, c.gram FROM candidates c JOIN longer o ON c.lang = o.lang AND c.gram = o.gram WHERE c.k = 2 AND 100 * more >= 50 * f),
halves AS (
  SELECT lang, gram, f AS a, cut, array_to_string(w[1:cut], ' ') AS lg, array_to_string(w[cut + 1:k], ' ') AS rg
  FROM candidates ANTI JOIN inside USING (lang, gram), (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
cuts AS (
  SELECT h.lang, h.gram, a, cut, l.f AS l, r.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM halves h JOIN grams l ON l.lang = h.lang AND l.gram = lg JOIN grams r ON r.lang = h.lang AND r.gram = rg),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best)
SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


SQL: dict[str, str] = {"op2_chats": _chats_sql(chat.Template()), "op12_collocations": _PHRASES_SQL, "op13_filters": _FILTERS_SQL}
