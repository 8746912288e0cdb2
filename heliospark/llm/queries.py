"""The operators as the driver's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as Q
from . import secrets as S
from .collocations import mine_phrases
from .common import words_column
from .decontaminate import contamination
from .divergence import source_divergence
from .jaccard_join import similar_documents
from .language_id import identify_languages
from .packing import pack_documents
from .quality_rules import quality_rules
from .secrets import find_secrets, listed
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import score_toxicity
from .url_filters import filter_urls
from .word_model import word_perplexities

#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for tokens here; any length column does."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.size(words_column(F.col("text"))).alias("n_tokens"))
    return pack_documents(docs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_refused")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _part(4) == 2
    out = identify_languages(_table(spark, sf_dir, "documents"), learn=~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _part(5) == 0
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that labels call good."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return word_perplexities(_table(spark, sf_dir, "documents"), good)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*S.BASE))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in S.BASE]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_quality_rules, op3_ngram_jaccard_join, op4_language_id, op5_toxicity, op6_url_filters, op7_token_counts, op8_substring_dedup, op9_quality_classifier, op10_benchmark_decontamination, op11_phrase_collocations, op12_secret_scans, op13_source_divergence)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_sql() -> str:
    rules = Q.RULES
    w = Q.REPEAT_WINDOW
    base = " or ".join(f"({rules[r]})" for r in Q.BASE_RULES)
    sums = ", ".join(f"sum(case when {c} then 1.0 else 0.0 end) f_{r}" for r, c in rules.items())
    totals = ", ".join(f"sum(f_{r}) tf_{r}, sum(f_{r} * f_{r} / n) tff_{r}" for r in rules)
    priors = ", ".join(
        f"tf_{r} / tn m_{r}, least(greatest(coalesce(1.0 / greatest(((tff_{r} - tf_{r} * (tf_{r} / tn)) / nullif((tf_{r} / tn) * (1 - tf_{r} / tn), 0) - (k - 1)) / nullif(tn - tn2 / tn - (k - 1), 0), 1e-4) - 1, 2.0), 2.0), 10000.0) s_{r}"
        for r in rules
    )
    rate = lambda r: f"((f_{r} + s_{r} * m_{r}) / (n + s_{r}))"
    refused = " or ".join(f"coalesce({rate(r)} - {Q.HOST_SIGMAS} * sqrt({rate(r)} * (1 - {rate(r)}) / (n + s_{r} + 1)) > {Q.HOST_RATE}, false)" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t, {_WORDS} w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) i FROM d WHERE len(w) >= {w}),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {w - 1}], ' ')) c FROM win),
gaps AS (SELECT doc_id, least({w}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {w})) g FROM marked WHERE c > 1),
rep AS (SELECT doc_id, sum(g) g FROM gaps GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT n_dup_lines,
  coalesce(g, 0)::BIGINT n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE n, {sums} FROM m WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*)::DOUBLE k, sum(n) tn, sum(n * n) tn2, {totals} FROM h),
p AS (SELECT {priors} FROM t),
v AS (SELECT source, {refused} AS refused FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({base}) AND NOT coalesce(refused, false) AS kept, coalesce(refused, false) AS host_refused
FROM m LEFT JOIN v USING (source)"""


def _jaccard_sql() -> str:
    from .jaccard_join import PERCENT, WORDS

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, m.c component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) c FROM reach GROUP BY a) m ON m.a = d.doc_id"""


def _url_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(URL_RULES, key=lambda r: (-r[0].count("."), -len(r[1])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM u"""


def _substring_sql() -> str:
    from .substring_dedup import WINDOW as w

    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {w - 1}], ' ')) c FROM (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) i FROM d WHERE len(w) >= {w})),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) j, unnest(w) x FROM d),
hit AS (SELECT word.doc_id, j, x, coalesce(max(win.i) OVER (PARTITION BY word.doc_id ORDER BY j ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM word LEFT JOIN win ON win.doc_id = word.doc_id AND win.i = j AND win.c > 1)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n, 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) n, string_agg(x, ' ' ORDER BY j) FILTER (NOT gone) kept FROM hit GROUP BY doc_id) USING (doc_id)"""


def _decontamination_sql() -> str:
    from .decontaminate import WINDOW as w

    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} w FROM documents),
b AS (SELECT item_id::VARCHAR item, {words} w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w[i:i + {w - 1}]) n, array_to_string(w[i:i + {w - 1}], ' ') p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {w - 1}, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON bw.p = dw.p AND bw.n = dw.n),
cover AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _collocations_sql() -> str:
    from .collocations import CONTAINED, LEAST, LONGEST, SCALE, TOP

    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) p FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') w, f a FROM f WHERE k > 1 AND f >= {LEAST}),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) c FROM c),
s AS (SELECT cut.lang, cut.phrase, a, c, x.f l, y.f r, ({SCALE}::HUGEINT * a) // (x.f + y.f) score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1:cut.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') phrase FROM (SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) i FROM (SELECT lang, a, k, w, unnest(range(2, k)) m FROM c WHERE k > 2))),
longer AS (SELECT lang, phrase, max(a) m FROM sub GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) rank FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase WHERE m IS NULL OR 100 * m < {CONTAINED} * a)
SELECT lang, rank::BIGINT rank, phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n, score::BIGINT score FROM r JOIN n USING (lang) WHERE rank <= {TOP}"""


def _secrets_sql() -> str:
    q = lambda x: x.replace("'", "''")

    def places(name: str, source: str, pattern: str, group: int = 0) -> str:
        """Rows of id, start, end and the group's text of each match: what lies between matches tells where they are."""
        return rf"""
{name}_m AS (SELECT id, unnest(list_zip(regexp_extract_all(t, '{q(pattern)}'), regexp_extract_all(t, '{q(pattern)}', {group}), string_split_regex(t, '{q(pattern)}')[1:len(regexp_extract_all(t, '{q(pattern)}'))])) z, generate_subscripts(regexp_extract_all(t, '{q(pattern)}'), 1) i FROM {source}),
{name} AS (SELECT id, g, e - length(m) s, e FROM (SELECT id, z[1] m, z[2] g, sum(length(z[3]) + length(z[1])) OVER (PARTITION BY id ORDER BY i) e FROM {name}_m))"""

    w = S.WINDOW
    base = ",".join(places(f"m{n}", "d", p, g) for n, (p, g, _) in enumerate(S.BASE.values()))
    kept = " UNION ALL ".join(f"SELECT id, s, e, '{k}' kind, {n} nth FROM m{n} WHERE length(g) >= {least}" for n, (k, (_, _, least)) in enumerate(S.BASE.items()))
    weights = ", ".join(str(S.weight(c)) for c in range(w + 1))
    suspect = " ".join(f"WHEN regexp_full_match(x, '[{chars}]+') THEN u <= {S.most_weight(bits, w)}" for chars, bits in S.CLASSES.values())
    allow = ",".join(places(f"a{n}", "f", p) for n, p in enumerate(S.ALLOW))
    free = " UNION ALL ".join(f"SELECT id, s, e FROM a{n}" for n in range(len(S.ALLOW)))
    count = lambda k: f"count(*) FILTER (kind = '{k}')::BIGINT n_{k}"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () id, coalesce(text, '') t FROM documents),{base},
b AS ({kept}),{places("c", "d", f"[{S.CANDIDATE}]{{{w},}}")},
win AS (SELECT id, s + i AS s, g[i + 1:i + {w}] x FROM (SELECT id, s, g, unnest(range(0, length(g) - {w - 1})) i FROM c)),
uw AS (SELECT id, s, x, list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: ([{weights}])[length(x) - length(replace(x, c, '')) + 1])) u FROM win WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')),
hot AS (SELECT id, s FROM uw WHERE CASE {suspect} END),
isl AS (SELECT id, s, sum(CASE WHEN s <= p + {w} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s) g FROM (SELECT id, s, lag(s) OVER (PARTITION BY id ORDER BY s) p FROM hot)),
n AS (SELECT id, min(s) s, max(s) + {w} e FROM isl GROUP BY id, g),
k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = n.id AND b.s <= n.s AND n.e <= b.e)),
f AS (SELECT id, t FROM d WHERE id IN (SELECT id FROM k)),{allow},
free AS ({free}),
every AS (SELECT * FROM b UNION ALL SELECT id, s, e, 'entropy', {len(S.BASE)} FROM k WHERE NOT EXISTS (SELECT 1 FROM free WHERE free.id = k.id AND free.s <= k.s AND k.e <= free.e)),
t AS (SELECT id, {", ".join(map(count, S.BASE))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (kind <> 'entropy') base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) spans FROM every GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in S.BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN t USING (id)"""


def _divergence_sql() -> str:
    from .divergence import LEAST_DOCS, TOP, UNIT

    f = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH d AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
t AS (SELECT id, lang, source, unnest(w) term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
v AS (SELECT lang, count(*) v FROM kept GROUP BY lang),
p AS (SELECT lang, source, term, c, 1 + ({UNIT}::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) p FROM full_c JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) c FROM full_c GROUP BY lang, term),
lp AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) q FROM lc JOIN v USING (lang)),
pair AS (SELECT lang, source, item, sum({f}) value FROM (SELECT a.lang, a.source, b.source item, a.p, b.p q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {f} FROM p JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _quality_sql(),
    "op3_ngram_jaccard_join": _jaccard_sql(),
    "op6_url_filters": _url_sql(),
    "op8_substring_dedup": _substring_sql(),
    "op10_benchmark_decontamination": _decontamination_sql(),
    "op11_phrase_collocations": _collocations_sql(),
    "op12_secret_scans": _secrets_sql(),
    "op13_source_divergence": _divergence_sql(),
}
