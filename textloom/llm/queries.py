"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_spans=False).drop("spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_turns, text_parts

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_turns(text_parts(rows)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest_match")


def op8_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tamper_check

    return tamper_check(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants

    return group_variants(_table(spark, sf_dir, "documents"))


def op11_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import search

    return search(_table(spark, sf_dir, "embeddings"), every=50)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""

_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<turn|</turn|###|<image|<audio|<document|<conversation)', '\\\1', 'g')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(7 + length(role) + 1 + size + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + 9), ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes)),
m AS (SELECT doc_id, item_id, p, size FROM dw JOIN iw USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN firsts USING (k) WHERE doc_id > first),
g AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS text FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (sh) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id, coalesce(first, doc_id) >= doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


# the unsigned crc32 of a string, a byte at a time and a bit at a time
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(b)::BIGINT FOR b IN {bytes}]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
         sha256({_HEAD} || {_field("t")}) AS seen
  FROM (SELECT *, CASE WHEN {_CRC.format(bytes="string_split(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3),
subs AS (SELECT source, h AS subroot, level AS height FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3),
s AS (SELECT *, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS top_at FROM subs),
steps AS (
  SELECT l.source, l.pos, x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos // p.p), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos // p.p), '') AS r
  FROM l CROSS JOIN (SELECT k AS level, CAST(pow(3, k) AS BIGINT) AS p FROM range(40) t(k)) p
  JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.level = p.level AND x.n > 1 AND x.pos // 3 = l.pos // (p.p * 3) GROUP BY ALL
  UNION ALL
  SELECT l.source, l.pos, s.height + x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < s.top_at // p.p), ''), coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > s.top_at // p.p), '')
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT k AS level, CAST(pow(3, k) AS BIGINT) AS p FROM range(40) t(k)) p
  JOIN tops x ON x.level = p.level AND x.n > 1 AND x.pos // 3 = s.top_at // (p.p * 3) GROUP BY l.source, l.pos, s.height, x.level),
proofs AS (SELECT source, pos, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM steps GROUP BY 1, 2),
fold AS (
  SELECT l.source, l.pos, 0 AS k, seen AS h, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs FROM l LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
  UNION ALL SELECT source, pos, k + 1, sha256(ls[k + 1] || h || rs[k + 1]), ls, rs FROM fold WHERE k < len(ls))
SELECT l.doc_id, leaf, subroot, t.h AS root, sha256(coalesce(list_reduce(list_prepend('', list_transform(range(1, len(ls) + 1), lambda i: ls[i] || rs[i])), lambda a, b: a || b), '')) AS proof_sha256,
       f.h AS folded_root, f.h = t.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.pos = l.pos AND f.k = len(f.ls) CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""


_RUN_CRC = _CRC.format(bytes="list_transform(range(1, octet_length(b) + 1), lambda i: instr('0123456789abcdef', substr(lower(hex(b)), 2 * i - 1, 1)) * 16 + instr('0123456789abcdef', substr(lower(hex(b)), 2 * i, 1)) - 17)").replace("ord(b)::BIGINT FOR b IN", "z::BIGINT FOR z IN")
_OP13 = f"""
WITH RECURSIVE r AS (
  SELECT d, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]{{5,}}')) AS run FROM documents)
  GROUP BY 1, 2),
h AS (SELECT *, {_RUN_CRC} AS h FROM (SELECT *, encode(d || ':' || run) AS b FROM r)),
w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.here AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.here AND e.form IS NULL
"""


_OP11 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_block_matrix_join": _OP11, "op13_spelling_variants": _OP13, "op12_merkle_manifest": _OP12, "op5_warc_round_trip": _OP5, "op6_chat_parts": _OP6, "op7_benchmark_decontamination": _OP7, "op8_level_doubling": _OP8, "op9_minhash_near_dedup": _OP9}
