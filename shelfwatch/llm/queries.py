"""The queries of this folder, each applying its operator to a whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwatch.llm import alignment, chat, classifier, decontaminate, licenses, line_dedup, mixing, near_dups, prefix_trie, rules, sharding, token_counts, warc
from shelfwatch.llm.common import pin, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, list_slice(w, i + 1, i + size) AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(len(w) - least(13, len(w)) + 1)) AS i
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, list_slice(w, i + 1, i + size) AS win
       FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT dw.r, dw.size, dw.i, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN items ON d.r = items.r"""


@query("op4_decontamination", SQL_DECONTAMINATION)
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_token_counts")
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # optional: only the two queries with tokenizers need it

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _sql_rules() -> str:
    rate = {"symbol_rate": "CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END",
            "dup_line_rate": "CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END",
            "repeat_rate": "CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END",
            "word_length": "CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END"}
    low = "(v - v % CAST(pow(2, greatest(len(bin(v)) - 6, 0)) AS BIGINT))"
    tall = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v} AS v FROM m WHERE n_words > 0" for k, v in rate.items())
    lo, hi, beyond = ("CASE rate " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in rules.FENCES.items()) + " END" for i in range(3))
    prior = f"{rules.TRUST ** 2}::DOUBLE"

    def level(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys} rate" if keys else "PARTITION BY rate"
        return f"""{name} AS (SELECT {keys} rate, total * total AS weight, CAST(hi + {beyond} * (hi - lo) AS DOUBLE) AS fence FROM (
            SELECT {keys} rate, CAST(max(total) AS DOUBLE) AS total, min(CASE WHEN upto * 100 >= total * ({lo}) THEN b END) AS lo,
                   min(CASE WHEN upto * 100 >= total * ({hi}) THEN b END) AS hi FROM (
            SELECT {keys} rate, b, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY b) AS upto FROM (
            SELECT {keys} rate, b, sum(n) AS n FROM s GROUP BY {keys} rate, b)) GROUP BY {keys} rate))"""

    within = " AND ".join(f"{v} <= max(CASE WHEN rate = '{k}' THEN fence END)" for k, v in rate.items())
    counts = "n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, i, list_slice(w, i + 1, i + 3) AS t FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(*) AS c FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) FROM twice) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words
      FROM d JOIN ln ON d.r = ln.r LEFT JOIN rep ON d.r = rep.r),
s AS (SELECT lang, source, rate, {low} AS b, count(*) AS n FROM ({tall}) GROUP BY ALL),
{level('own', 'lang, source,')}, {level('lg', 'lang,')}, {level('al', '')},
g AS (SELECT own.lang, own.source, own.rate, (own.weight * own.fence + {prior} * ((lg.weight * lg.fence + {prior} * al.fence) / (lg.weight + {prior})))
             / (own.weight + {prior}) AS fence
      FROM own JOIN lg ON own.lang IS NOT DISTINCT FROM lg.lang AND own.rate = lg.rate JOIN al ON own.rate = al.rate),
f AS (SELECT lang, source, rate, floor(fence + fence / {rules.BUCKETS}) AS fence FROM g),
v AS (SELECT m.r, doc_id, {counts}, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             coalesce({within}, false) AS ok
      FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
      GROUP BY m.r, doc_id, {counts})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND ok AS kept FROM v"""


@query("op7_quality_rules", _sql_rules())
def _quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.adaptive_rules(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OLD_SHARDS, SHARDS = 6, 8


@query("op2_resharding")
def _resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout goes by source, so its shards are uneven; eight equal ones follow."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    rows = sharding.reshard(docs, old, OLD_SHARDS, SHARDS)
    return rows.select("doc_id", sharding.row_size(F.col("text")).alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_quality_classifier")
def _quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    weights = classifier.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return classifier.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


SQL_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT *, (place - 1) % 3 + 1 AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM d GROUP BY source)),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
             coalesce(sum(source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS filled,
             coalesce(sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM p),
c AS (SELECT *, CAST(total - filled AS DOUBLE) * w > CAST(3 * source_size AS DOUBLE) * (ws - passed) AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
      CAST(total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE)
      / CAST(ws - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS DOUBLE) * w END AS target FROM c),
u AS (SELECT d.doc_id, d.source, size, source_size, target,
             CAST(CASE WHEN source_size > 0 THEN floor(target / source_size * {mixing.UNIT} + 0.5) ELSE 0 END AS BIGINT) AS units
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(source, '')), 1, 7) AS BIGINT) + CAST(coalesce(sum(units) OVER (
             PARTITION BY source ORDER BY size DESC, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u)
SELECT doc_id, size, source_size, target,
       CAST(((start + units) // {mixing.UNIT} - start // {mixing.UNIT}) * size AS BIGINT) AS taken FROM o"""


@query("op8_mixing", SQL_MIX)
def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.plan_copies(pin(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


SQL_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
c AS MATERIALIZED (SELECT w, min(r) AS c FROM d WHERE len(w) > 0 GROUP BY w),
sh AS MATERIALIZED (SELECT DISTINCT c, list_slice(w, i + 1, i + 3) AS s FROM (SELECT c, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM c)),
n AS MATERIALIZED (SELECT c, count(*) AS n FROM sh GROUP BY c),
k AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.c < b.c GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT c AS node, c AS seen FROM c UNION SELECT t.node, e.b FROM t JOIN e ON t.seen = e.a),
g AS (SELECT node, min(seen) AS root FROM t GROUP BY node),
m AS (SELECT d.r, d.doc_id, d.w, g.root FROM d LEFT JOIN c ON d.w = c.w LEFT JOIN g ON g.node = c.c),
p AS (SELECT root, min(doc_id) AS least FROM m WHERE root IS NOT NULL GROUP BY root)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN m.root IS NULL THEN m.doc_id ELSE p.least END AS component_id,
       m.root IS NULL OR m.doc_id IS NOT DISTINCT FROM p.least AS kept
FROM m LEFT JOIN p ON m.root = p.root LEFT JOIN c ON m.w = c.w LEFT JOIN n ON n.c = c.c"""


@query("op6_near_duplicates", SQL_NEAR_DUPLICATES)
def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dups.near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


SQL_CHAT = f"""
WITH t AS (SELECT row_number() OVER () AS r, conv_id, coalesce(turn, 9223372036854775807) AS turn,
                  replace(coalesce(role, ''), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS said
           FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who NOT IN ('', 'system')),
n AS (SELECT *, CAST(turn // {chat.PART_TURNS} AS BIGINT) AS part, said || '{chat.END.strip()}' || chr(10) AS body,
             row_number() OVER (PARTITION BY conv_id, turn // {chat.PART_TURNS} ORDER BY turn, who = '', who, said, r) AS k FROM t),
s AS (SELECT n.conv_id, speaker, part, CAST((k - 1) // {chat.PART_TURNS} AS BIGINT) AS piece, k, who = speaker AS mine, body,
             CASE WHEN who = 'system' THEN '<|system|>' WHEN who = speaker THEN '<|assistant|>' WHEN who = '' THEN '<|user|>'
                  ELSE '<|user|> ' || who END || chr(10) AS header
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, CAST(sum(length(header) + length(body)) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY k) AS BIGINT) AS stop FROM s)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(header || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN mine THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY k), '') AS masks
FROM o GROUP BY conv_id, speaker, part, piece"""


@query("op1_chat_perspectives", SQL_CHAT)
def _chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(table(spark, sf_dir, "conversations"))
    span = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["stop"]))
    return rows.withColumn("masks", F.array_join(span, ","))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, strlen(html) AS n, first, CAST(unhex(sha1(html)) AS BIT) AS b FROM p JOIN f USING (html))
SELECT page_id, n AS payload_bytes,
       list_reduce([substr('{_B32}', 1 + get_bit(b, CAST(5 * i AS INTEGER)) * 16 + get_bit(b, CAST(5 * i + 1 AS INTEGER)) * 8 + get_bit(b, CAST(5 * i + 2 AS INTEGER)) * 4
                           + get_bit(b, CAST(5 * i + 3 AS INTEGER)) * 2 + get_bit(b, CAST(5 * i + 4 AS INTEGER)), 1) FOR i IN range(32)], lambda x, y: x || y) AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM d"""


@query("op10_warc_histories", SQL_WARC)
def _warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no capture time; a second per page_id stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captured = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0)))
    return warc.capture_histories(pages, captured).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_line_dedup")
def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


@query("op13_alignment")
def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _sql_licenses() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    plan = licenses.Plan([(i, label, text) for i, (label, text) in enumerate(licenses.TEMPLATES)], {}, licenses.PERCENT)
    by_number = {v: k.decode() for k, v in plan.words.items()}
    rows = ", ".join(f"({i}, {quoted(label)}, {step}, {need}, {len(ids)}, {quoted(by_number[w])})"
                     for i, label, step, ids, need in plan.templates for w in ids)
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in licenses.PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
t(template, label, step, need, size, word) AS (VALUES {rows}),
p(phrase, label, size) AS (VALUES {phrases}),
k AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
base AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                list(DISTINCT label) AS held FROM (
         SELECT d.r, p.label, i FROM d, p, unnest(range(len(w) - p.size + 1)) AS x(i)
         WHERE len(w) >= p.size AND array_to_string(list_slice(w, i + 1, i + p.size), ' ') = p.phrase) GROUP BY r),
b AS (SELECT DISTINCT r, step, unnest(CASE WHEN i >= step THEN [i // step, i // step - 1] ELSE [i // step] END) AS block, word
      FROM k JOIN (SELECT DISTINCT step, word FROM t) USING (word)),
m AS (SELECT r, template, label, count(*) / any_value(size) AS score FROM b JOIN t USING (step, word)
      GROUP BY r, step, block, template, label HAVING count(*) >= any_value(need)),
own AS (SELECT r, list(DISTINCT label) AS held, max(score) AS score FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first AS first_word, last AS last_word,
       coalesce(base.labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.held, []), coalesce(own.held, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0.0) END AS score
FROM d LEFT JOIN base ON d.r = base.r LEFT JOIN own ON d.r = own.r"""


@query("op12_license_scan", _sql_licenses())
def _license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.find_licenses(docs)[0].select("doc_id", *licenses.RESULTS)


# The table of the checksum's 256 bytes, from its polynomial, bit by bit.
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) ORDER BY b)
                 FROM range(256) AS x(b))"""
SQL_TRIE = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
t AS (SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS u, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(u ORDER BY turn NULLS FIRST, sha256(strlen(u.role) || ':' || u.role || u.text)) AS l FROM t GROUP BY c),
h AS (SELECT c, l, c - c % 5 AS base, CAST(xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda acc, b: xor(acc >> 8, crc.t[1 + (xor(acc, b) & 255)]), 4294967295)) % 9 AS INTEGER) AS h FROM own, crc),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.l, []), 1, h.h), list_slice(h.l, h.h + 1, len(h.l))) AS l FROM h LEFT JOIN own b ON b.c = h.base),
p AS (SELECT c, d, list_slice(l, 1, d) AS p, d = len(l) AS ends FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n, list_slice(p, 1, d - 1) AS up, (count(*) - 1) * coalesce(strlen(p[d].text), 0) AS cost,
             sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM p GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
below AS (SELECT a AS d, list_slice(p, 1, a) AS p, sum(leaf) AS leaves, sum(cost) AS saved FROM (
          SELECT n.p, n.cost, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(n.d + 1)) AS a
          FROM n LEFT JOIN kids ON n.d = kids.d AND n.p = kids.p) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN below ON n.d = below.d AND n.p = below.p LEFT JOIN kids ON n.d = kids.d AND n.p = kids.p
LEFT JOIN n parent ON n.d > 0 AND parent.d = n.d - 1 AND parent.p = n.up"""


@query("op11_prefix_trie", SQL_TRIE)
def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = prefix_trie.rebuilt(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_nodes(convs, turns)
