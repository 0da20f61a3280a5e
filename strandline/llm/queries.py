"""Queries over the training-data tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, decontaminate, fim, fingerprint, html_text, interaction, mixing, near_dedup, packing, quality, secrets, simhash, toxicity
from strandline.session import ship, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by weak labels."""
    return quality.score(_table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, Jaccard of 0.85 or more."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by weight takes of each document."""
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the formatted text."""
    return chat.digests(chat.format_conversations(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the groups of those within two bits of each other."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every step of every order of five filters removes from each source."""
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents rearranged for fill-in-middle training, and of the texts rebuilt from them."""
    return fim.digests(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_fingerprint that SQL can express."""
    return op3_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_secrets that SQL can express."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_mixing that SQL can express; targets to a thousandth of a word."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_quality, op3_fingerprint, op4_near_dedup, op5_packing, op6_secrets, op7_mixing, op8_html, op9_chat, op10_decontamination, op11_simhash, op12_filter_audit, op13_fill_in_middle, fingerprint_edits, secret_base_counts, mixing_targets)
    return {f.__name__: f for f in found}


_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, '!\[[^\[\]\n]{0,512}\]\([^()\s]+\)' AS image, '\[[^\[\]\n]{0,512}\]\([^()\s]+\.(?:mp3|wav|ogg|flac|m4a)\)' AS audio, '\[[^\[\]\n]{0,512}\]\([^()\s]+\.(?:pdf|docx?|odt|epub)\)' AS document FROM c),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, image, chr(1), 'g'), audio, chr(2), 'g'), document, chr(3), 'g') AS held FROM r),
n AS (SELECT *, length(held) - length(replace(held, chr(1), '')) AS images, length(held) - length(replace(held, chr(2), '')) AS audios, length(held) - length(replace(held, chr(3), '')) AS documents FROM p),
e AS (SELECT *, images + audios + documents AS attached, 255 * images AS tokens, length('### ' || role || ': ' || regexp_replace(held, '(\\*)(###|</turn>|<\|)', '\1\1\\\2', 'g') || ' </turn>' || chr(10)) + 10 * images + 10 * audios + 13 * documents AS size FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars, CAST(sum(attached) AS BIGINT) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
"""

_LEAKS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
       FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, bw.item_id FROM dw d JOIN bw ON d.win = bw.win AND d.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_GROUPS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS f FROM s GROUP BY g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN df USING (g)),
p AS (SELECT r.doc_id, r.g, n.size FROM r JOIN n USING (doc_id) WHERE k <= size - ceil(0.85 * size) + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)),
i AS (SELECT x, y, count(*) AS n_both FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 85 * (a.size + b.size - n_both)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT DISTINCT x AS doc_id, x AS node FROM both_ways UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = reach.node),
comp AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id, coalesce(comp.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


_EDITS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS follows FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(follows, 1, length(t) // 2)) AS edited_sha256 FROM n
"""

_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM d
"""

_TARGETS = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, (k - 1) % 3 + 1 AS weight, 3.0 * source_size AS roof FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY roof / weight, k) AS i FROM w),
c AS (SELECT *, sum(roof) OVER (ORDER BY i) AS full_, sum(weight) OVER () - sum(weight) OVER (ORDER BY i) AS rest, sum(source_size) OVER () AS total FROM r),
l AS (SELECT 0 AS i, total / sum(weight) OVER () AS level FROM c UNION SELECT i, CASE WHEN rest > 0 THEN (total - full_) / rest END FROM c),
f AS (SELECT level FROM l LEFT JOIN r ON r.i = l.i + 1 WHERE level IS NOT NULL AND (r.i IS NULL OR level * weight <= roof) ORDER BY l.i LIMIT 1)
SELECT d.doc_id, d.size, w.source_size, round(least(w.roof, coalesce((SELECT level FROM f), 1e300) * w.weight), 3) AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
"""


_AUDIT = r"""
WITH l AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 50 AS fa, 100 * len(list_distinct(words)) < 65 * len(words) AS fb,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe FROM t LEFT JOIN l ON doc_id = id),
m AS (SELECT part, CAST(fa AS INT) + 2 * CAST(fb AS INT) + 4 * CAST(fc AS INT) + 8 * CAST(fd AS INT) + 16 * CAST(fe AS INT) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) r(k)),
c AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM c
"""

_MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": _AUDIT, "op13_fill_in_middle": _MIDDLES, "op4_near_dedup": _GROUPS, "op9_chat": _CHAT, "op10_decontamination": _LEAKS, "fingerprint_edits": _EDITS, "secret_base_counts": _BASE, "mixing_targets": _TARGETS}
