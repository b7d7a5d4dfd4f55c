"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import decontamination, divergence, fim, licenses, lines, packing, pii, quality, secret_scan, simhash, substrings, urls, viterbi
from lexspark.sources.tables import read_table
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql
        return function

    return register


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("op1_substring_dedup", rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 48), lambda i: {{'i': i, 'k': array_to_string(words[i:i + 49], ' ')}}), recursive := true) FROM t),
sources AS (SELECT k, min(doc_id) AS source FROM windows GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS p FROM windows JOIN sources USING (k) WHERE source < doc_id),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM t),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS rest, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.RepeatedPassages(read_table(spark, sf_dir, "documents"), window=50).remaining()


@query("op2_secret_scan")
def secret_scan_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.report(read_table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read_table(spark, sf_dir, "documents"), size=2048)


@query("op5_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


_FAILED = " + ".join(f"CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)


@query("op6_quality_rules", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'k': words[i:i + 2]}}), recursive := true) FROM t),
twice AS (SELECT doc_id, k FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM windows JOIN twice USING (doc_id, k), range(3) r(o) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(regexp_extract_all(text, '!!')) AS n_exclaimed
  FROM t LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, ({_FAILED})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {quality.mask("base")}) <> 0 AS base_failed,
  (failed_bits & {quality.mask("v2")}) = 0 AS kept, failed_bits FROM f
""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"))


@query("op7_line_dedup", r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) AS l FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: {'i': i, 'k': l[i:i + 2]}), recursive := true) FROM t),
firsts AS (SELECT k, min(row(doc_id, i)) AS first FROM windows WHERE array_to_string(k, '') <> '' GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(3)) AS p FROM windows JOIN firsts USING (k) WHERE row(doc_id, i) > first),
line AS (SELECT doc_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS rest, count(*) AS n FROM line ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(raw), 0)::BIGINT AS n_lines, (coalesce(len(raw), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS text_sha256
FROM t LEFT JOIN kept USING (doc_id)
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), run=3)
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _rule_sql() -> str:
    cases = []
    for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host + path}|{verdict}'")
    return "CASE " + " ".join(cases) + " END"


@query("op8_url_filter", rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
ruled AS (SELECT *, {_rule_sql()} AS hit FROM p),
j AS (SELECT page_id, host, path, nullif(string_split(hit, '|')[1], '') AS rule, string_split(hit, '|')[2] AS label,
  array_to_string(list_transform(string_split(path, '/'), lambda s: CASE
    WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z]+)?$') THEN '{{n}}' || regexp_extract(s, '(\.[A-Za-z]+)?$')
    WHEN regexp_matches(s, '^[0-9a-f-]{{8,}}(\.[A-Za-z]+)?$') AND regexp_matches(s, '[0-9]') THEN '{{h}}' || regexp_extract(s, '(\.[A-Za-z]+)?$')
    ELSE s END), '/') AS lexical FROM ruled),
shapes AS (SELECT host, lexical, string_split(lexical, '/') AS parts, sum((label = 'block')::INT) FILTER (label IS NOT NULL) AS b, count(label) AS m FROM j GROUP BY ALL),
nodes AS (SELECT host, len(parts) AS length, unnest(parts) AS part, generate_subscripts(parts, 1) AS depth FROM shapes),
wide AS (SELECT host, length, list(depth) AS wide FROM (SELECT host, length, depth FROM nodes GROUP BY ALL HAVING count(DISTINCT part) > {urls.BRANCHES}) GROUP BY ALL),
named AS (SELECT s.host, lexical, coalesce(b, 0) AS b, m, list_transform(parts, lambda x, i: CASE WHEN list_contains(wide, i) THEN '*' ELSE x END) AS parts
  FROM shapes s LEFT JOIN wide w ON s.host = w.host AND len(parts) = w.length),
first AS (SELECT *, list_position(list_transform(parts, lambda x: x <> '' AND x <> '*' AND NOT starts_with(x, '{{n}}') AND NOT starts_with(x, '{{h}}')), true) AS f FROM named),
family AS (SELECT host, lexical, b, m, array_to_string(parts, '/') AS template,
  array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = f THEN '*' ELSE x END), '/') AS family FROM first),
stats AS (SELECT host, family, template, sum(b) AS b, sum(m) AS m FROM family GROUP BY ALL),
common AS (SELECT host, family, sum(b)::DOUBLE AS gb, sum(m)::DOUBLE AS gm FROM stats WHERE m >= {urls.EVIDENCE} GROUP BY ALL),
alike AS (SELECT host, family, template, b, m FROM stats JOIN common USING (host, family) WHERE m >= {urls.EVIDENCE}
  AND (b * gm - m * gb) * (b * gm - m * gb) <= 4 * m * gb * (gm - gb)),
pooled AS (SELECT host, template, sum(b) OVER w AS mb, sum(m) OVER w AS mm FROM alike WINDOW w AS (PARTITION BY host, family)),
final AS (SELECT host, template, coalesce(mb, b)::BIGINT AS n_blocked, coalesce(mm, m)::BIGINT AS n_labelled FROM stats LEFT JOIN pooled USING (host, template))
SELECT page_id, j.host, path, rule, coalesce(label, CASE WHEN (n_blocked + 1) * 10 >= (n_labelled + 2) * {urls.PURITY_TENTHS} THEN 'block' ELSE 'allow' END) AS verdict,
  template, n_labelled, n_blocked FROM j JOIN family ON j.host = family.host AND j.lexical = family.lexical JOIN final USING (host, template)
""".replace("JOIN final USING (host, template)\n", "JOIN final ON final.host = family.host AND final.template = family.template\n")
    .replace("  template, n_labelled, n_blocked FROM j", "  family.template, n_labelled, n_blocked FROM j"))
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(read_table(spark, sf_dir, "pages"))


@query("op9_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


_PLAIN = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")


@query("op10_decontamination", rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS words FROM documents),
b AS (SELECT item_id, {_PLAIN} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: {{'i': i, 'k': array_to_string(words[i:i + n - 1], ' ')}}), recursive := true) FROM d, sizes),
found AS (SELECT doc_id, item_id, dw.n AS n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM found, range(10) r(o) WHERE o < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def decontamination_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)



def _license_sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(licenses.TEMPLATES))
    span = licenses.Templates().span
    word = licenses.WORD
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
ph AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {phrases}) v(phrase, label)),
places AS (SELECT rid, label, i FROM t, ph, range(0, greatest(len(w) - len(p) + 1, 0)) r(i) WHERE w[i + 1:i + len(p)] = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY rid),
tt AS (SELECT n, label, list_distinct(regexp_extract_all(text, '{word}')) AS tw FROM (VALUES {templates}) v(n, label, text)),
blocks AS (SELECT rid, list_distinct(w[b * {span} + 1:b * {span} + {2 * span}]) AS bw FROM t, range(0, greatest(1, ceil((len(w) - {span}) / {span})::BIGINT)) r(b) WHERE len(w) > 0),
m AS (SELECT rid, list_sort(list_distinct(list(label))) AS labels, max(len(list_intersect(bw, tw)) / len(tw)) AS score FROM blocks, tt
  WHERE len(list_intersect(bw, tw)) >= (({licenses.TENTHS} * len(tw) + 9) // 10) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(coalesce(base.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels, coalesce(m.score, 0.0)::DOUBLE AS score
FROM t LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)
"""


@query("op11_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS hx,
  list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)::BIGINT) AS lens FROM documents),
k AS (SELECT *, len(lens)::BIGINT AS n, ('0x' || substr(hx, 1, 8))::UBIGINT AS h1, ('0x' || substr(hx, 9, 8))::UBIGINT AS h2,
  ('0x' || substr(hx, 17, 8))::UBIGINT AS h3, ('0x' || substr(hx, 25, 8))::UBIGINT AS h4 FROM t),
c AS (SELECT *, coalesce(list_sum(lens[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS i, coalesce(list_sum(lens[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT AS j,
  CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substring(text, 1, i) AS pre, substring(text, i + 1, j - i) AS mid, substring(text, j + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM o
""")
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(read_table(spark, sf_dir, "documents"))


@query("op13_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occ AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
gt AS (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lc FROM occ GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS V, sum(lc) AS NL FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM gt JOIN kept k USING (lang, term) WHERE gt.lang = g.lang AND gt.source = g.source), 0) AS N FROM groups g),
dense AS (SELECT gn.lang, gn.source, kept.term, coalesce(gt.c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(gt.c, 0) + 5)) // (gn.N + 5 * v.V) AS p, 1 + (1000000000::HUGEINT * (kept.lc + 5)) // (v.NL + 5 * v.V) AS q
  FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN gt ON gt.lang = gn.lang AND gt.source = gn.source AND gt.term = kept.term),
dist AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
