"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import decontaminate, fill_middle, fingerprints, html_extract, minhash, pii, quality_rules, resampling, sentencepiece_codec, sp_model, token_counts, toxicity, url_filter, weak_quality
from gazette.llm.common import table

#: Fixed values of the URL query: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


#: The public vocabulary that the token queries use.
SP_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sp_model.load(SP_MODEL))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), sp_model.load(SP_MODEL))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule: how many documents fail it, and how many it alone rejects, from the stored ledger's bits."""
    return quality_rules.ablations(quality_rules.stored(quality_rules.ledger(table(spark, sf_dir, "documents"))))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restored(fill_middle.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.half_edited(table(spark, sf_dir, "documents"))
    return rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_minhash": op6_minhash,
    "op7_html": op7_html,
    "op8_quality_rules": op8_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_fill_middle": op11_fill_middle,
    "op12_resampling": op12_resampling,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {
    "op6_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i+3], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON m.a = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
""",
    "op10_url_filter": """
WITH r(h, p, v) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')),
u AS (SELECT page_id, row_number() OVER () AS k,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT u.k, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
      FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.k)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
""",
    "op8_quality_rules": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM rep GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
      len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^\\p{L}]', '', 'g'))::BIGINT AS n_letters
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 20)::BIGINT + 4 * (n_symbols * 10 > n_words * 3)::BIGINT
      + 8 * (n_words > 0 AND (word_chars < n_words * 2 OR word_chars > n_words * 15))::BIGINT + 16 * (n_dup_lines * 2 > n_lines)::BIGINT
      + 32 * (n_upper * 2 > n_letters)::BIGINT + 64 * (n_letters * 2 < word_chars)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
""",
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain,
      least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:n], '') AS suf FROM c),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM o
""",
    "op12_resampling": r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT 1 AS mine, doc_id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
w AS (SELECT mine, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
x AS MATERIALIZED (SELECT mine, doc_id, word, count(*) AS c FROM (SELECT mine, doc_id, unnest(w) AS word FROM w) GROUP BY ALL),
b AS (SELECT word, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::UBIGINT) AS bytes FROM (SELECT DISTINCT word FROM x)),
h AS MATERIALIZED (SELECT word, (xor(list_reduce([4294967295::UBIGINT] || bytes, lambda a, y: xor(a // 256, tab.t[(xor(a % 256, y) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000)::BIGINT AS k FROM b, tab),
n AS (SELECT mine, k, sum(c) AS c FROM x JOIN h USING (word) GROUP BY ALL),
m AS (SELECT k, coalesce(sum(c) FILTER (mine = 1), 0) AS s, coalesce(sum(c) FILTER (mine = 0), 0) AS t FROM n GROUP BY k),
g AS (SELECT k, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM m) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM m) + 10000)::DOUBLE)))::BIGINT AS gain FROM m),
v AS (SELECT doc_id, sum(c * gain) AS weight FROM x JOIN h USING (word) JOIN g USING (k) WHERE mine = 1 GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT AS z FROM w LEFT JOIN v USING (doc_id) WHERE mine = 1),
q AS (SELECT doc_id, n_features, weight, (weight + floor(-1000.0::DOUBLE * ln(-ln((z::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_features >= 20)
SELECT q.*, CASE WHEN o.rank <= (SELECT count(*) FROM o) * 10 // 100 THEN o.rank END AS rank FROM q LEFT JOIN o USING (doc_id)
""",
    "op13_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx,
      coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS nid FROM d),
e AS (SELECT doc_id, nid, length(t) AS n, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) AS ed FROM o),
v AS (SELECT doc_id, 0 AS k, t FROM d UNION ALL SELECT doc_id, 1, ed FROM e),
l AS (SELECT doc_id, k, CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '[^
]*
|[^
]+') END AS ls FROM v),
p AS (SELECT doc_id, k, list_transform(ls, lambda x: {'d': sha256(x), 'x': x = chr(10) OR regexp_matches(sha256(x), '^[01]'),
        'n': ':' || left(sha256(x), 16) || '.' || array_to_string(list_transform(regexp_extract_all(x, '[^.,;:!?
]{0,63}[.,;:!?
]+ *|[^.,;:!?
]{1,64}'), lambda y: left(sha256(y), 8)), '.')}) AS p FROM l),
s AS (SELECT doc_id, k, p, list_filter(range(1, len(p) + 1), lambda i: i = len(p) OR p[i].x) AS ea FROM p),
c AS (SELECT doc_id, k, p, list_transform(ea, lambda z, i: p[coalesce(ea[i - 1], 0) + 1 : z]) AS c FROM s),
g AS (SELECT doc_id, k, p, list_transform(c, lambda x: sha256(array_to_string(list_transform(x, lambda y: y.d), ''))) AS sd,
        list_transform(c, lambda x: array_to_string(list_transform(x, lambda y: y.n), '')) AS sn, c FROM c),
f AS (SELECT doc_id, k, list_transform(p, lambda y: left(y.d, 16)) AS pd, list_transform(sd, lambda x, i: left(x, 16) || sn[i]) AS secs,
        list_transform(c, lambda x: list_transform(x, lambda y: left(y.d, 16))) AS inner_d,
        sha256(array_to_string(sd, '')) || array_to_string(list_transform(sd, lambda x, i: '/' || left(x, 16) || sn[i]), '') AS fp FROM g),
w AS (SELECT e.doc_id, e.n, sha256(e.ed) AS edited_sha256, a.fp AS fa, b.fp AS fb, x.fp AS fx, a.pd AS pd, a.secs AS sa, b.secs AS sb, a.inner_d AS ia, b.inner_d AS ib,
        list_distinct(regexp_split_to_array(a.fp, '[/:.]')) AS na, list_distinct(regexp_split_to_array(b.fp, '[/:.]')) AS nb, list_distinct(regexp_split_to_array(x.fp, '[/:.]')) AS nx
      FROM e JOIN f a ON a.doc_id = e.doc_id AND a.k = 0 JOIN f b ON b.doc_id = e.doc_id AND b.k = 1 JOIN f x ON x.doc_id = e.nid AND x.k = 0),
y AS (SELECT *, flatten(list_filter(list_transform(ia, lambda q, i: CASE WHEN list_contains(sb, sa[i]) THEN NULL ELSE q END), lambda q: q IS NOT NULL)) AS da,
        flatten(list_filter(list_transform(ib, lambda q, i: CASE WHEN list_contains(sa, sb[i]) THEN NULL ELSE q END), lambda q: q IS NOT NULL)) AS db FROM w),
z AS (SELECT *, list_filter(da, lambda q: NOT list_contains(db, q)) AS ch FROM y)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN left(fa, 64) = left(fb, 64) THEN 1.0 ELSE 2.0 * len(list_intersect(na, nb)) / (len(na) + len(nb)) END::DOUBLE AS near_edited,
       CASE WHEN left(fa, 64) = left(fx, 64) THEN 1.0 ELSE 2.0 * len(list_intersect(na, nx)) / (len(na) + len(nx)) END::DOUBLE AS near_next,
       len(list_distinct(ch))::BIGINT AS n_changed, (list_position(pd, ch[1]) - 1)::BIGINT AS first_changed FROM z
""",
}

#: The bits of the rules in their order, over the masks of the documents.
ORACLES["quality_rule_ablations"] = f"""WITH q AS ({ORACLES["op8_quality_rules"]}),
r(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('symbol_heavy', 4), ('mean_word_length', 8), ('duplicate_lines', 16), ('mostly_upper_case', 32), ('few_letters', 64))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only_this_rule FROM q, r GROUP BY rule"""
