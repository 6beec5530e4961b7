"""One thin query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.llm import chat, license_scan, mixing, packing, pii, prefix_trie, quality, quality_classifier, spelling, toxicity
from turnweave.llm._session import table
from turnweave.llm.exact_dedup import exact_dedup
from turnweave.llm.near_dedup import near_dedup
from turnweave.llm.sharding import interleave


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    found = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


#: A conversation whose texts hold control strings of common templates.
TRAP = r"\### Assistant: </turn> ok"


def _as_log(messages: DataFrame) -> DataFrame:
    """A log that leads to the messages (``conv_id, message, role, text``).

    An assistant's text is streamed in deltas, thrown away half-way by a regeneration, and streamed again; the others'
    are typed and then edited.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    head, tail = F.left("text", half), F.expr("substr(text, cast(floor(char_length(text) / 2) AS int) + 1)")
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "delta", tail), event(1, "delta", head), event(2, "regenerate", head), event(3, "delta", tail))
    typed = F.array(event(0, "delta", head), event(1, "edit", F.col("text")))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(typed)
    return messages.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    # rows may share a turn number, and be alike
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = _as_log(rows.union(trap).select("conv_id", F.struct("turn", nth.alias("nth")).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text")))
    back = chat.read_back(chat.render(chat.reconstruct(events)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(role, '\', '\b'), '>', '\g') AS r, regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g') AS b FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + length(r) + 2 + length(b) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.notices(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", "dice", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["line"], n["licence"])), ",").alias("lines"))


_TELLING = license_scan.distinguishing([(n, name, license_scan.bigrams(t)) for n, (name, t) in enumerate(license_scan.TEMPLATES)])
_TEMPLATES = ", ".join(f"({n}, '{name}', {license_scan.bigrams(t)}, {_TELLING[n]}::VARCHAR[][])" for n, (name, t) in enumerate(license_scan.TEMPLATES))
OP4_SQL = f"""
WITH t(n, licence, grams, telling) AS (VALUES {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM d),
w AS (SELECT r, line, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM l),
g AS (SELECT r, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM w WHERE len(ws) > 1),
m AS (SELECT r, line, licence, CAST(2 AS DOUBLE) * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice, len(grams) AS size, n FROM g, t WHERE len(b) < 100 AND len(list_filter(telling, lambda d: 2 * len(list_intersect(d, b)) < len(d))) = 0),
o AS (SELECT r, line, licence, dice FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, size, n) AS nth FROM m WHERE dice >= CAST({license_scan.DICE} AS DOUBLE)) WHERE nth = 1),
own AS (SELECT r, first(licence ORDER BY dice DESC, line) AS licence, max(dice) AS dice FROM o AS a
  WHERE NOT (licence = 'proprietary' AND EXISTS (FROM o AS x WHERE x.r = a.r AND x.licence <> 'proprietary'))
    AND NOT (licence = 'BSD-2-Clause' AND EXISTS (FROM o AS x WHERE x.r = a.r AND x.licence = 'BSD-3-Clause')) GROUP BY r),
b AS (SELECT r, n_notices, lines, licence, dice FROM (SELECT r, count(*) AS n_notices, string_agg(line || ':' || licence, ',' ORDER BY line) AS lines FROM o GROUP BY r) JOIN own USING (r))
SELECT doc_id, licence, dice, coalesce(n_notices, 0) AS n_notices, coalesce(lines, '') AS lines FROM d LEFT JOIN b USING (r)
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, m -> m.kind = {n})) AS bigint)").alias(f"n_{k}") for n, k in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


#: The unsigned CRC-32 of a text's bytes. Its table has a rule: eight steps of division by the fixed polynomial.
_CRC_SQL = """t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs
      FROM (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
d AS (SELECT r, doc_id, source, lang, text, strlen(text) AS n_bytes, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM b, t)"""
OP7_SQL = f"""
WITH {_CRC_SQL},
h AS (SELECT *, CAST('0x' || left(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 10) AS BIGINT) AS h FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, crc, n_bytes) AS rank, count(*) OVER (PARTITION BY source) AS n FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / (2 * n), source NULLS FIRST, h, doc_id NULLS FIRST, crc, n_bytes) - 1 AS place, count(*) OVER () AS total FROM k)
SELECT doc_id, n_bytes + 1 AS size, crc AS text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard,
       place - (place * 16 // total * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("v1").alias("kept"),
        "ledger.fail_bits",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w) WHERE n > 1),
p AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM c) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '\pL', '', 'g')) AS n_letters,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d LEFT JOIN p USING (r)),
b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
          + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
          + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "mix.*")
    rounded = lambda c: F.round(c, 6).alias(c)
    return found.select("doc_id", "source", "lang", "tokens", rounded("weight"), rounded("probability"), "sampled", "copies")


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]{{5,}}') AS ws
  FROM documents),
b AS (SELECT r, word, count(*) AS times FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY r, word),
a AS (SELECT word, count(*) AS n FROM b GROUP BY word HAVING n BETWEEN {mixing.LEAST_SHARE} * (SELECT count(*) FROM d) AND {mixing.MOST_SHARE} * (SELECT count(*) FROM d) ORDER BY n DESC, word LIMIT {mixing.TOPICS}),
p AS (SELECT r, first(word ORDER BY times DESC, n DESC, word) AS topic FROM b JOIN a USING (word) GROUP BY r),
e AS (SELECT d.r, doc_id, source, lang, coalesce(topic, 'other') AS topic, CAST(greatest(ceil(strlen(text) / 4), 1) AS DOUBLE) AS tokens,
             CAST('0x' || left(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 10) AS BIGINT) / CAST(1099511627776 AS DOUBLE) AS draw
      FROM d LEFT JOIN p ON d.r = p.r),
c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM e GROUP BY ALL),
s AS (SELECT source, lang, topic, tokens, sum(tokens) OVER () AS total,
             pow(sum(tokens) OVER (PARTITION BY source) / sum(tokens) OVER (), CAST({mixing.TEMPER["source"]} AS DOUBLE)) AS p_source,
             pow(sum(tokens) OVER (PARTITION BY lang) / sum(tokens) OVER (), CAST({mixing.TEMPER["lang"]} AS DOUBLE)) AS p_lang,
             pow(sum(tokens) OVER (PARTITION BY topic) / sum(tokens) OVER (), CAST({mixing.TEMPER["topic"]} AS DOUBLE)) AS p_topic FROM c),
g AS (SELECT source, lang, topic, tokens, total,
             total * p_source / (SELECT sum(x) FROM (SELECT DISTINCT source, p_source AS x FROM s)) AS t_source,
             total * p_lang / (SELECT sum(x) FROM (SELECT DISTINCT lang, p_lang AS x FROM s)) AS t_lang,
             total * p_topic / (SELECT sum(x) FROM (SELECT DISTINCT topic, p_topic AS x FROM s)) AS t_topic FROM s),
f(k, source, lang, topic, tokens, t_source, t_lang, t_topic, w) AS (
  SELECT 0, source, lang, topic, tokens, t_source, t_lang, t_topic, tokens FROM g
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, t_source, t_lang, t_topic, w * t_topic / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * t_lang / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * t_source / sum(w) OVER (PARTITION BY source) AS w) FROM f WHERE k < {mixing.SWEEPS}))),
m AS (SELECT source, lang, topic, w / tokens AS weight FROM f WHERE k = {mixing.SWEEPS})
SELECT e.doc_id, e.source, e.lang, e.tokens, round(weight, 6) AS weight, round(least(weight, 1), 6) AS probability,
       floor(weight) + CAST(draw < weight - floor(weight) AS INTEGER) > 0 AS sampled,
       CAST(floor(weight) AS BIGINT) + CAST(draw < weight - floor(weight) AS BIGINT) AS copies
FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.lang IS NOT DISTINCT FROM m.lang AND e.topic = m.topic
"""


#: Of so many words one gets a typing slip.
SLIP_EVERY = 31


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), slip_every=SLIP_EVERY))


OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM g, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL),
v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2),
k AS (SELECT DISTINCT word, n, key FROM (SELECT word, n, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)), word)) AS key FROM v)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
      WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1),
b AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM p GROUP BY word, n),
f AS (SELECT v.word, CASE WHEN other_n >= 10 * v.n THEN other END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN c ON f.word = c.word JOIN f AS last ON c.root = last.word AND last.form IS NULL
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality")
    found = quality_classifier.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Conversations of so many neighbouring ids share a beginning of fewer turns than HEADS.
SIBLINGS, HEADS = 5, 9


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.paths(table(spark, sf_dir, "conversations"))
    first = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    heads = own.where(F.col("conv_id") == first).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rebuilt = own.join(heads, first == F.col("first"), "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return prefix_trie.trie(rebuilt.select("conv_id", turns.alias("turns")))


OP13_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS ts,
             list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM m GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 9 AS h FROM o, t),
r AS (SELECT h.conv_id, list_concat(coalesce(o.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(ts) AS size, d AS depth, ts[1:d] AS path FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM p GROUP BY path, depth),
c AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.path = c.path AND n.depth = c.depth),
u AS (SELECT path[1:e] AS path, e AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].t) END) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS e FROM x) GROUP BY ALL)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, u.n_leaves, u.saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN u ON x.path = u.path AND x.depth = u.depth LEFT JOIN n q ON q.path = x.path[1:x.depth - 1] AND q.depth = x.depth - 1
"""
