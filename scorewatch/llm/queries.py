"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm import (
    bpe_codec,
    chat_format,
    collocations,
    embedding_dedup,
    exact_search,
    language_id,
    ngram_join,
    packing,
    quality_divergence,
    sharding,
    spelling,
    substring_dedup,
    token_files,
)
from scorewatch.llm.common import stored, table
from scorewatch.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = table(spark, folder, "documents")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.with_crc(token_files.read_token_files(spark, path))


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=2048)


@query
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = stored(chat_format.format_chats(turns), "chats")
    back = chats.select(
        "conv_id", "formatted", "valid", chat_format.turns_of(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
ORACLE["op9_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, n, CASE WHEN n = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(n)
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length({_ESCAPED.format("role")}) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS formatted_chars,
    string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, 's?u(au)*a?') AS valid
FROM chats"""


@query
def op10_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # a table between the two, so that an executor does not hold workers and batches of both at once
    tokens = stored(bpe_codec.encode_texts(table(spark, folder, "documents"), path, public_tokenizers.PATTERN), "ids")
    back = bpe_codec.decode_ids(tokens, path, public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe_codec.ids_sha256("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, folder, "documents"), window=50)


@query
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, folder, "documents"), k=5, percent=75)


@query
def op2_distribution_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_divergence.judge(docs, quality_divergence.learn_references(docs))


@query
def op5_nearest_centroid_language(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = table(spark, folder, "documents").withColumn("held_out", held_out)
    model = language_id.learn(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model).withColumn("held_out", held_out)


@query
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), threshold=0.9)


@query
def op6_best_fit_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), shards=24).select(
        "*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_pivot_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.top_products(table(spark, folder, "embeddings"), is_query="pmod(vec_id, 20) = 0", k=20, scale=64)


ORACLE["op11_pivot_topk_search"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20"""


@query
def op12_rabin_karp_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), top=2000)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE["op12_rabin_karp_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, range(1, 5) r(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k >= 2 AND a >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM candidates JOIN range(1, 4) x(cut) ON cut < k
), heads AS MATERIALIZED (
  SELECT p.*, f.a AS l FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.head
), cuts AS (
  SELECT p.*, f.a AS r, CAST(2000000 * p.a::HUGEINT // (l + f.a) AS BIGINT) AS score
  FROM heads p JOIN f ON f.lang = p.lang AND f.phrase = p.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c JOIN range(2, 4) y(s) ON s < c.k JOIN range(1, 4) z(i) ON i + s - 1 <= c.k GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000"""


@query
def op13_qchunk_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, folder, "documents"), every=97)


# crc32 is folded over the bytes of a text; letters of two bytes stand for one sign each while edits are counted
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(35, 127)) if not c.islower() and c not in "$'\\")[:64]
ORACLE["op13_qchunk_spelling"] = rf"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS step
  FROM range(256) t(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY ALL
), coded AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(range(len(code) // 2),
    lambda c, i: xor(c >> 8, step[(xor(c, ('0x' || code[2 * i + 1:2 * i + 2])::BIGINT) & 255) + 1]), 4294967295::BIGINT)) AS h FROM coded, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:length(run)] ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), variants AS (
  SELECT word, n, word AS v FROM words
  UNION SELECT word, n, word[1:i - 1] || word[i + 1:length(word)] FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM variants a JOIN variants b ON a.v = b.v AND a.word <> b.word
  WHERE levenshtein(translate(a.word, $${_ACCENTED}$$, $${_SIGNS}$$), translate(b.word, $${_ACCENTED}$$, $${_SIGNS}$$)) = 1
), best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near
  FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)"""
