"""Registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, id_coder, langid, lm, mixing, ngram_join, pieces_fst, quality, ranked, secret_scan, toxicity
from .common import doc_remainder, stage, vocabulary


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    held = F.coalesce(doc_remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit_languages(d.where(~held).select("doc_id", "text", "lang"))
    return langid.identify(d, model, held_out=held)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source", mixing.n_words("text").alias("size"))
    mixed = mixing.mix_sources(mixing.with_quality(d, spark.read.parquet(f"{sf_dir}/labels.parquet")), weight="quality_weight")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL_OP2 = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT d.*, -ln((('0x' || substr(md5('20:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
        / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS k FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / wt AS own, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM l WHERE own >= lev ORDER BY own, source NULLS LAST LIMIT 1) * wt, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.*, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + CASE WHEN epochs >= 2 THEN 0 ELSE least(size, greatest(floor(target + 1e-6)::BIGINT - epochs * source_size - before, 0)) END)::BIGINT AS taken
FROM r
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(sh)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest_chats(chat.read_chats(stage(chat.format_chats(turns), "chats")))


SQL_OP4 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\[\\*/?(?:INST|ROLE)\]|<\\*(?:/?s>|</?SYS>>)')) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + len(role) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    held = F.coalesce(doc_remainder("doc_id", 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    model = toxicity.fit_toxicity(d.where(~held).select("doc_id", "text").join(labels.hint("shuffle_hash"), "doc_id").select("text", "toxic"))
    return toxicity.score_toxicity(d, model, held_out=held)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = id_coder.write_ids(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=2)
    return id_coder.read_ids(files)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL_OP7 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_fst.encode_pieces(_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_docs(spark, sf_dir), doc_remainder("doc_id", 7) == 2)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_spans(secret_scan.scan_secrets(_docs(spark, sf_dir)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


SQL_OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS ws FROM d),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) x(k))),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, l.a AS l, r.a AS r, (u.a::HUGEINT * 2000000 // (l.a + r.a))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut + 1:u.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, k, ws, unnest(range(2, k)) AS m FROM c),
o AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS j FROM i) GROUP BY ALL),
e AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o USING (lang, phrase)
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM e JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL_OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), t GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_ngram_join, op4_chat_format, op5_toxicity, op6_token_ids, op7_exact_dedup, op8_sentencepiece, op9_quality_rules, op10_language_model, op11_secrets, op12_collocations, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": SQL_OP2, "op3_ngram_join": SQL_OP3, "op4_chat_format": SQL_OP4, "op7_exact_dedup": SQL_OP7, "op12_collocations": SQL_OP12, "op13_ranked_search": SQL_OP13}
