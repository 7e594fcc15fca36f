"""The registered queries of the text operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenpeak.llm import (
    chat, convtrie, decontam, lexical, licenses, mainhtml, mixing, quality, sharding, simhash, toxicity, warc, weighted)
from lumenpeak.llm.common import TERM, WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
D = "SELECT row_number() OVER () AS rid, * FROM documents"

HITS_SQL = f"""
WITH d AS (SELECT rid, doc_id, regexp_extract_all({LOWER}, '{TERM}') ws FROM ({D})),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') item, regexp_extract_all({LOWER}, '{TERM}') ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i:i + 12] w FROM (
  SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) i FROM b WHERE len(ws) > 0)),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) i FROM d),
hit AS (SELECT DISTINCT rid, item, i, n FROM (
  SELECT rid, ws[i:i + n - 1] w, i, n FROM pos, (SELECT DISTINCT len(w) n FROM win) WHERE i + n - 1 <= len(ws)) p
  JOIN win USING (w)),
cov AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + n)) p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) n_items, sha256(string_agg(item, ',' ORDER BY item)) s
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  coalesce(s, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


@query("op1_decontamination", HITS_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key")


def mixing_sql(docs: str = "documents") -> str:
    """Rows of ``docs`` with their lots, their source's target and how often they are taken."""
    return f"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT size,
  md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) k FROM {docs}),
s AS (SELECT source, sum(size)::DOUBLE sz FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] w FROM s),
l AS (SELECT *, ({mixing.SHARE}::DOUBLE * (sum(sz) OVER ()) - 2e0 * coalesce(sum(sz) OVER (
    ORDER BY sz / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER (ORDER BY sz / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE lv FROM w),
t AS (SELECT source, sz, CASE WHEN 2e0 * sz <= lv * w THEN 2e0 * sz
  ELSE w * max(CASE WHEN 2e0 * sz > lv * w THEN lv END) OVER () END target FROM l),
e AS (SELECT *, CASE WHEN sz > 0 THEN floor(target / sz) ELSE 0 END whole FROM t),
c AS (SELECT d.*, sz, target, whole, target - whole * sz extra,
  sum(size) OVER (PARTITION BY d.source ORDER BY k) upto, sum(size) OVER (PARTITION BY d.source, k) same
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT *, (whole + CASE WHEN extra > 0 AND 2 * upto - same <= 2 * extra THEN 1 ELSE 0 END)::BIGINT times FROM c"""


@query("op2_mixing", f"SELECT doc_id, size, sz::BIGINT source_size, target, (times * size)::BIGINT taken "
                     f"FROM ({mixing_sql()})")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query("op8_sharding")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(table(spark, sf, "documents"))


def quality_sql(docs: str = "documents") -> str:
    """Rows of ``docs`` with measurements and verdicts."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') t FROM {docs}),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORD}')] ls FROM d),
sh AS (SELECT rid, i, ws[i:i + 4] s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) i FROM w)),
rp AS (SELECT rid, i FROM sh QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rw AS (SELECT rid, count(DISTINCT p) r FROM (SELECT rid, unnest(range(i, i + 5)) p FROM rp) GROUP BY rid),
m AS (SELECT w.*, len(ws)::BIGINT n_words, coalesce(list_sum([len(x) FOR x IN ws]), 0)::BIGINT word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(r, 0)::BIGINT n_repeat_words, len(ls) n_lines,
  coalesce(list_sum([len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')) FOR x IN ls
    IF NOT regexp_matches(x, '{quality.MARKUP}', 's')]), 0) n_noise,
  length(t) - length(regexp_replace(t, '{quality.WIDE}', '', 'g')) n_wide
  FROM w LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m)
SELECT *, NOT (base_failed OR 4 * n_noise > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
  OR word_chars - n_wide > 30 * n_words) kept,
  ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (4 * n_noise > n_words)::INT
   + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
   + 32 * (word_chars - n_wide > 30 * n_words)::INT)::BIGINT failure_bits FROM b"""


@query("op10_quality_rules", f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  base_failed, kept, failure_bits FROM ({quality_sql()})""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(table(spark, sf, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.classes(table(spark, sf, "documents"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scanned(table(spark, sf, "documents")).drop("spans")


@query("op7_chat_formatting")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role",
        f"'{same}' AS text")
    return chat.digests(chat.formatted(said.union(probe)))


ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, ''))::BIGINT n FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) m FROM p)
SELECT page_id, n payload_bytes, sha1(h) payload_digest,
  CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END refers_to FROM k"""


@query("op9_warc", ARCHIVES_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages")).drop("archive", "payload")


SAID_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '[', '[' || chr(92)), '<', '<' || chr(92)))
  + length(replace(replace(replace(r, chr(92), chr(92) || chr(92)), '[', '[' || chr(92)), '<', '<' || chr(92))) + 19 n FROM c)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
  (sum(n) + 3)::BIGINT formatted_chars FROM e GROUP BY conv_id"""
ORACLES["op7_chat_formatting"] = SAID_SQL


@query("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("spans")


@query("op5_html_extraction")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return mainhtml.extracted(pages, mainhtml.fit(mainhtml.sample(pages))).drop("blocks")


RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '{TERM}') ws FROM documents),
n AS (SELECT rid, doc_id, ws, len(ws)::BIGINT n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT big, sum(n)::BIGINT total FROM n),
q AS (SELECT q, item_id, unnest(list_distinct(ws)) t FROM (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all({LOWER}, '{TERM}') ws FROM benchmark)),
tf AS (SELECT rid, t, count(*)::BIGINT tf FROM (SELECT rid, unnest(ws) t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(big) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM tf, g GROUP BY t),
i AS (SELECT rid, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big) // total))) v
  FROM tf JOIN w USING (t) JOIN n USING (rid), g),
s AS (SELECT q, item_id, rid, doc_id, sum(v)::BIGINT score FROM q JOIN i USING (t) JOIN n USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) k FROM s WHERE score > 0)
SELECT item_id, k::INT AS "rank", doc_id, score FROM r WHERE k <= {lexical.TOP}"""


@query("op11_lexical_search", RANKED_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return weighted.fingerprinted(table(spark, sf, "documents"))


# crc32 of the decimal digits, bit by bit: 3988292384 is the reversed polynomial
CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || flatten([[(ascii(x) >> b) & 1 FOR b IN [0, 1, 2, 3, 4, 5, 6, 7]]
  FOR x IN string_split(conv_id::VARCHAR, '')])::BIGINT[],
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"""
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) k FROM conversations),
c AS (SELECT conv_id, coalesce({CRC_SQL} % 6, 0) h FROM (SELECT DISTINCT conv_id FROM conversations)),
b AS (SELECT c.conv_id, 0 part, k, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, r, x FROM c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE k > h),
p AS (SELECT c.conv_id, coalesce(list(sha256(length(r) || ':' || r || x) ORDER BY part, k) FILTER (r IS NOT NULL), []) p,
  coalesce(list(length(x)::BIGINT ORDER BY part, k) FILTER (r IS NOT NULL), []) n
  FROM c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id GROUP BY c.conv_id),
m AS (SELECT *, p[:d] AS node, d = len(p) ends FROM (SELECT *, unnest(range(0, len(p) + 1)) d FROM p)),
v AS (SELECT node, any_value(d) depth, min(conv_id) conv_id, count(*)::BIGINT n_convs, any_value(n[d]) size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) ends_sha256
  FROM m GROUP BY node),
k AS (SELECT node[:-2] AS node, count(*)::BIGINT n_children FROM v WHERE depth > 0 GROUP BY 1),
u AS (SELECT v.*, coalesce(n_children, 0)::BIGINT n_children FROM v LEFT JOIN k USING (node)),
s AS (SELECT node[:a] AS node, sum((n_convs - 1) * coalesce(size, 0))::BIGINT saved_tokens,
  count(*) FILTER (n_children = 0)::BIGINT n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) a FROM u) GROUP BY 1)
SELECT u.conv_id, u.depth::BIGINT AS depth, o.conv_id parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens,
  u.ends_sha256 FROM u JOIN s USING (node) LEFT JOIN v o ON u.depth > 0 AND o.node = u.node[:-2]"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return convtrie.nodes(table(spark, sf, "conversations"))
