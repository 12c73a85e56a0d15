"""SQL for the registered queries, in DuckDB's dialect, on the same tables."""

from __future__ import annotations

from linkloom.functions.text import ADDRESS_WORDS, FRENCH_WORDS, LEGAL_SUFFIXES
from linkloom.operators.decide import threshold_grid
from linkloom.operators.features import FEATURES

_SUFFIXES = "|".join(LEGAL_SUFFIXES)
_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))"
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


def _core(name: str) -> str:
    return f"regexp_replace({name}, '( ({_SUFFIXES}))+$', '')"


def _set(text: str) -> str:
    return f"list_distinct({_WORDS.format(text)})"


def _grams(text: str) -> str:
    """Distinct trigrams, from a list of characters."""
    chars = f"string_split('_' || replace({text}, ' ', '_') || '_', '')"
    return f"list_transform([{chars}], lambda c: list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])))[1]"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _f05(tp: str, n: str, p: str) -> str:
    return f"CASE WHEN {n} = 0 THEN CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(1.25 AS DOUBLE) * {tp} / (CAST(0.25 AS DOUBLE) * {n} + {p}) END"


# the tables that the queries derive from documents
_BASE = f"""
records AS (
  SELECT doc_id, CAST(doc_id % 3 + 1 AS INTEGER) AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, coalesce(lang, '') AS country, nt,
    array_to_string({_WORDS.format("nt")}[1:6], ' ') AS name, coalesce(array_to_string({_WORDS.format("nt")}[7:], ' '), '') AS address
  FROM (SELECT doc_id, lang, {_NORMAL} AS nt FROM documents)),
q AS (SELECT doc_id AS qid, entity_id, country, name, address, nt FROM records WHERE src = 1),
t AS (SELECT entity_id AS tid, src AS source, doc_id AS rid, country, name, address, nt FROM records WHERE src <> 1),
truth AS (SELECT q.qid, t.tid FROM q JOIN t ON q.nt = t.nt WHERE q.nt <> '')"""
_SCORED = f"""
met AS (SELECT q.qid, t.tid, t.source, q.country, {_set("q.address")} AS x, {_set("t.address")} AS y, q.address AS a, t.address AS b FROM q JOIN t ON q.country = t.country AND q.name = t.name WHERE q.name <> ''),
scored AS (SELECT met.qid, met.tid, source, country, CASE WHEN truth.tid IS NULL THEN 0 ELSE 1 END AS label, round({_jaccard("x", "y")}, 6) AS score
  FROM met LEFT JOIN truth ON met.qid = truth.qid AND met.tid = truth.tid),
predicted AS (SELECT * FROM scored WHERE score >= 0.5)"""
_COUNTS = """
counts AS (SELECT q.qid, q.country, coalesce(n.n, 0) AS n_truth, coalesce(p.n, 0) AS n_predicted, coalesce(b.n, 0) AS tp FROM q
  LEFT JOIN (SELECT qid, count(*) AS n FROM truth GROUP BY qid) n ON q.qid = n.qid
  LEFT JOIN (SELECT qid, count(*) AS n FROM predicted GROUP BY qid) p ON q.qid = p.qid
  LEFT JOIN (SELECT p.qid, count(*) AS n FROM predicted p JOIN truth t ON p.qid = t.qid AND p.tid = t.tid GROUP BY p.qid) b ON q.qid = b.qid)"""
_EXACT = f"""
exact AS (SELECT q.qid, t.tid FROM q JOIN t ON q.country = t.country AND {_core("q.name")} = {_core("t.name")} AND q.address = t.address WHERE {_core("q.name")} <> '' AND q.address <> '')"""
_ORDERS = """
orders_scored AS (SELECT l_orderkey AS qid, l_partkey AS tid, CAST(l_partkey % 2 + 2 AS INTEGER) AS source, max(round(l_discount * 10, 6)) AS score FROM lineitem GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


_RECORDS, _PAIRS = _with(_BASE), _with(_BASE, _SCORED)
_EVAL = _with(_BASE, _SCORED, _COUNTS)


def _bucket(key: str, n: int, seed: int) -> str:
    return f"CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 8)) AS BIGINT) % {n}"


def _french(text: str) -> str:
    for english, french in FRENCH_WORDS:
        for case in (str, str.lower, str.upper):
            text = f"replace({text}, '{case(english)}', '{case(french)}')"
    return text


_ORACLES: dict[str, str] = {
    "exact_baseline": _with(_BASE, _EXACT) + "SELECT q.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT e.tid, ',' ORDER BY e.tid), '') AS matched_entity_ids FROM q LEFT JOIN exact e ON q.qid = e.qid GROUP BY q.entity_id",
    "exact_baseline_f05": _with(_BASE, _EXACT.replace("exact AS", "predicted AS"), _COUNTS) + f"SELECT count(*) AS entities, CAST(sum(n_predicted) AS BIGINT) AS pairs, round(avg({_f05('tp', 'n_truth', 'n_predicted')}), 6) AS macro_f05 FROM counts",
    "tsv_round_trip": _RECORDS + "SELECT entity_id, name AS business_name, address AS business_address, country FROM records",
    "partitioned_scan": _RECORDS + "SELECT country, count(*) AS n, count(DISTINCT src) AS sources FROM records GROUP BY country",
    "row_ids": _RECORDS + "SELECT src, entity_id, row_number() OVER (PARTITION BY src ORDER BY entity_id) AS rid FROM records",
    "unpack_truth": _RECORDS + "SELECT q.entity_id AS source1_entity_id, truth.tid FROM truth JOIN q ON q.qid = truth.qid",
    "audit_sources": _RECORDS + "SELECT src, count(*) AS n_rows, count(*) - count(DISTINCT entity_id) AS duplicate_ids, count(*) FILTER (WHERE NOT starts_with(entity_id, 'S' || src || '-')) AS bad_prefix, count(*) FILTER (WHERE name = '') AS missing_name, count(*) FILTER (WHERE address = '') AS missing_address FROM records GROUP BY src",
    "country_counts": _RECORDS + "SELECT src, country, count(*) AS n FROM records GROUP BY ALL",
    "audit_truth": _RECORDS + """
        SELECT 'missing_truth_rows' AS "check", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'unknown_truth_references', 0
        UNION ALL SELECT 'duplicate_truth_rows', count(*) - count(DISTINCT entity_id) FROM q
        UNION ALL SELECT 'duplicate_truth_pairs', count(*) FROM (SELECT qid, tid FROM truth GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'invalid_targets', count(*) FROM truth WHERE tid NOT IN (SELECT tid FROM t)
        UNION ALL SELECT 'shared_targets', count(*) FROM (SELECT tid FROM truth GROUP BY tid HAVING count(DISTINCT qid) > 1)
        UNION ALL SELECT 'cross_country_pairs', count(*) FROM truth JOIN q USING (qid) JOIN t USING (tid) WHERE q.country <> t.country""",
    "cardinality_histogram": _EVAL + "SELECT n_truth, count(*) AS n FROM counts GROUP BY n_truth",
    "validate_output": _PAIRS + """
        , checks AS (SELECT unnest(['malformed', 'duplicate_rows', 'missing_rows', 'unknown_reference', 'unknown_target']) AS c)
        SELECT 'matches_' || c AS "check", CAST(0 AS BIGINT) AS n FROM checks UNION ALL SELECT 'candidates_' || c, 0 FROM checks
        UNION ALL SELECT 'matches_not_candidates', count(*) FROM truth ANTI JOIN predicted USING (qid, tid)""",
    "core_names": _RECORDS + f"""
        , full_names AS (SELECT doc_id, concat_ws(' ', nullif(name, ''), {list(LEGAL_SUFFIXES)}[doc_id % {len(LEGAL_SUFFIXES)} + 1], 'ltd') AS full_name FROM records)
        SELECT doc_id, full_name, {_core("full_name")} AS core_name FROM full_names""",
    "expanded_addresses": _RECORDS + "SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(concat_ws(' ', nullif(address, ''), "
    + f"{list(ADDRESS_WORDS)}[doc_id % {len(ADDRESS_WORDS)} + 1], 'st'), ' '), lambda w: CASE w "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ADDRESS_WORDS.items())
    + " ELSE w END), ' '), '^ ', '')) AS address_md5 FROM records",
    "trigrams": _RECORDS + f"SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), ' ')) AS grams_md5 FROM (SELECT doc_id, {_grams('address')} AS g FROM records)",
    "numeric_tokens": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\p{Nd}+'))), ' ') AS numbers,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '\p{Nd}+'), lambda d: length(d) IN (5, 6)))), ' ') AS postal FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""",
    "acronyms": _RECORDS + f"SELECT doc_id, array_to_string(list_transform({_WORDS.format('name')}, lambda w: substr(w, 1, 1)), '') AS acronym FROM records",
    "index_terms": _RECORDS + f"SELECT doc_id, array_to_string(list_sort(list_transform({_set('name')}, lambda w: 'x' || lower(hex(encode(w))))), ' ') AS terms FROM records",
    "french_words": _RECORDS + f"SELECT doc_id, {_french(chr(39).join(['name || ', ' 5 Main Street, 7 High Rd LLC ltd', '']))} AS text FROM records",
    "token_jaccard": _PAIRS + f"""SELECT qid, tid, round({_jaccard("x", "y")}, 6) AS jaccard,
        round(CASE WHEN least(len(x), len(y)) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / least(len(x), len(y)) ELSE 0.0 END, 6) AS containment,
        round(CASE WHEN greatest(length(a), length(b)) > 0 THEN CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) ELSE 0.0 END, 6) AS length_ratio FROM met""",
    "f05_per_entity": _EVAL + f"SELECT qid, n_truth, n_predicted, tp, round({_f05('tp', 'n_truth', 'n_predicted')}, 6) AS f05 FROM counts",
    "macro_f05": _EVAL + f"""SELECT count(*) AS entities, round(avg({_f05("tp", "n_truth", "n_predicted")}), 6) AS macro_f05, round(CAST(sum(tp) AS DOUBLE) / greatest(sum(n_predicted), 1), 6) AS pair_precision,
        round(CAST(sum(tp) AS DOUBLE) / greatest(sum(n_truth), 1), 6) AS pair_recall, round(avg(CASE WHEN n_truth = 0 THEN CASE WHEN n_predicted = 0 THEN 1.0 ELSE 0.0 END END), 6) AS singleton_accuracy FROM counts""",
    "f05_by_country": _EVAL + f"SELECT country, count(*) AS entities, round(avg({_f05('tp', 'n_truth', 'n_predicted')}), 6) AS macro_f05 FROM counts GROUP BY country",
    "f05_by_cardinality": _EVAL + f"SELECT n_truth, count(*) AS entities, round(avg({_f05('tp', 'n_truth', 'n_predicted')}), 6) AS macro_f05 FROM counts GROUP BY n_truth",
    "f05_macro_pr": _EVAL + """, pr AS (SELECT avg(CASE WHEN n_truth + n_predicted = 0 THEN 1.0 WHEN n_predicted > 0 THEN CAST(tp AS DOUBLE) / n_predicted ELSE 0.0 END) AS p,
        avg(CASE WHEN n_truth + n_predicted = 0 THEN 1.0 WHEN n_truth > 0 THEN CAST(tp AS DOUBLE) / n_truth ELSE 0.0 END) AS r FROM counts)
        SELECT round(p, 6) AS macro_precision, round(r, 6) AS macro_recall, round(CAST(1.25 AS DOUBLE) * p * r / (CAST(0.25 AS DOUBLE) * p + r), 6) AS f05 FROM pr""",
    "link_errors": _PAIRS + "SELECT qid, tid, 'false_positive' AS error FROM predicted ANTI JOIN truth USING (qid, tid) UNION ALL SELECT qid, tid, 'false_negative' FROM truth ANTI JOIN predicted USING (qid, tid)",
    "recall_at_k": _PAIRS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, tid) AS rank FROM scored), ks AS (SELECT unnest([1, 2, 20]) AS k)
        SELECT CAST(k AS BIGINT) AS k, count(*) AS true_pairs, count(*) FILTER (WHERE rank <= k) AS recovered, round(CAST(count(*) FILTER (WHERE rank <= k) AS DOUBLE) / greatest(count(*), 1), 6) AS recall
        FROM ks, truth LEFT JOIN ranked ON truth.qid = ranked.qid AND truth.tid = ranked.tid GROUP BY k""",
    "conflict_margin": _with(_ORDERS) + """, ranked AS (SELECT *, row_number() OVER w AS r, first_value(score) OVER w AS best, nth_value(score, 2) OVER (PARTITION BY tid ORDER BY score DESC, qid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
        FROM orders_scored WINDOW w AS (PARTITION BY tid ORDER BY score DESC, qid)) SELECT qid, tid, source, round(CASE WHEN r = 1 AND best - coalesce(second, 0) >= CAST(0.05 AS DOUBLE) THEN score ELSE 0 END, 6) AS score FROM ranked""",
    "source_threshold_gate": _with(_ORDERS) + "SELECT qid, tid, source, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM orders_scored) WHERE score >= CASE WHEN source = 2 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AND best >= CAST(0.9 AS DOUBLE)",
    "country_guard_owner": _RECORDS + f""", pairs AS (SELECT q.qid, t.tid, q.country, q.name AS qn, t.name AS tn, round({_jaccard(_set("q.address"), _set("t.address"))}, 6) AS score
        FROM q JOIN t ON q.country = t.country AND string_split(q.name, ' ')[1] = string_split(t.name, ' ')[1] WHERE q.name <> '' AND t.name <> '')
        SELECT qid, tid, country, score FROM pairs WHERE score >= CASE country WHEN 'en' THEN CAST(0.02 AS DOUBLE) WHEN 'fr' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END AND jaro_winkler_similarity(lower(qn), lower(tn)) >= CAST(0.55 AS DOUBLE)
        QUALIFY row_number() OVER (PARTITION BY tid ORDER BY score DESC, qid) = 1""",
    "threshold_sweep": _with(_ORDERS) + """, grid AS (SELECT round(CAST(0.3 AS DOUBLE) + CAST(0.02 AS DOUBLE) * i, 6) AS threshold FROM range(33) r(i)), n AS (SELECT count(*) AS n FROM orders),
        s AS (SELECT threshold, count(tid) AS accepted_pairs, count(DISTINCT qid) AS matched_entities FROM grid LEFT JOIN orders_scored ON score >= threshold GROUP BY threshold)
        SELECT threshold, accepted_pairs, matched_entities, round((1 - CAST(matched_entities AS DOUBLE) / n) * 100, 6) AS singleton_rate_pct, round(CASE WHEN matched_entities > 0 THEN CAST(accepted_pairs AS DOUBLE) / matched_entities ELSE 0.0 END, 6) AS avg_matches_per_entity FROM s, n""",
    "threshold_grid": _PAIRS + f""", grid AS (SELECT unnest({threshold_grid()}::DOUBLE[]) AS source2), n AS (SELECT q.qid, count(truth.tid) AS n FROM q LEFT JOIN truth ON q.qid = truth.qid GROUP BY q.qid),
        s AS (SELECT source2, qid, sum(label) AS tp, count(*) AS p FROM grid JOIN scored ON score >= source2 GROUP BY ALL)
        SELECT source2, round(avg({_f05("coalesce(tp, 0)", "n", "coalesce(p, 0)")}), 6) AS macro_f05 FROM (SELECT grid.source2, n.n, s.tp, s.p FROM grid CROSS JOIN n LEFT JOIN s ON s.source2 = grid.source2 AND s.qid = n.qid) GROUP BY source2""",
    "hash_sample": _PAIRS + "SELECT qid, tid, label FROM scored ORDER BY md5(qid || ':' || tid || ':7'), qid, tid LIMIT 100",
    "stratified_sample": _PAIRS + "SELECT qid, tid, country FROM scored QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(qid || ':' || tid || ':7'), qid, tid) <= 10",
    "hard_negatives": _PAIRS + "SELECT qid, tid, score FROM scored WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) <= 5",
    "training_pairs": _PAIRS + "SELECT qid, tid, label FROM scored WHERE label = 1 UNION ALL SELECT qid, tid, label FROM (SELECT * FROM scored WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) <= 20)",
    "pilot_targets": _RECORDS + """, refs AS (SELECT qid, row_number() OVER (ORDER BY entity_id) AS rid FROM q), tg AS (SELECT tid, source, row_number() OVER (PARTITION BY source ORDER BY tid) AS rid FROM t)
        SELECT tid, source, rid FROM tg WHERE rid <= 50 OR tid IN (SELECT truth.tid FROM truth JOIN refs ON truth.qid = refs.qid WHERE refs.rid <= 100)""",
    "dense_topk": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS tid, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS s FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)
        SELECT qid, tid, s AS dense_score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, tid) AS rank FROM s WHERE s > CAST(0.1 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, tid) <= 20""",
    "hybrid_merge": """WITH n AS (SELECT l_orderkey AS qid, l_partkey AS tid, max(round(l_discount * 10, 6)) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), d AS (SELECT l_orderkey AS qid, l_partkey AS tid, max(round(l_tax * 10, 6)) AS s FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
        SELECT qid, tid, greatest(n.s, d.s) AS score, CASE WHEN n.s IS NULL THEN 'dense' WHEN d.s > n.s THEN 'dense_higher' ELSE 'neural' END AS score_origin FROM n FULL JOIN d USING (qid, tid)""",
    "cardinality_by_country": _EVAL + """SELECT country, count(*) AS total_entities, count(*) FILTER (WHERE n_predicted = 0) AS singletons, round(avg(n_predicted), 6) AS avg_matches, max(n_predicted) AS max_matches,
        round(avg(CASE WHEN n_predicted > 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_multi, round(CAST(count(*) FILTER (WHERE n_predicted = 0) AS DOUBLE) / count(*) * 100, 6) AS singleton_rate_pct FROM counts GROUP BY country""",
    "cardinality_bins": _EVAL + """, b AS (SELECT country, CASE WHEN n_predicted > 5 THEN 'k>5' ELSE 'k=' || n_predicted END AS bin, count(*) AS n FROM counts GROUP BY ALL)
        SELECT country, bin, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY country) * 100, 6) AS pct FROM b""",
    "cardinality_drift": _EVAL + """SELECT country, round(avg(n_predicted) - avg(n_truth), 6) AS avg_matches_drift, round((CAST(count(*) FILTER (WHERE n_predicted = 0) AS DOUBLE) / count(*) * 100) - (CAST(count(*) FILTER (WHERE n_truth = 0) AS DOUBLE) / count(*) * 100), 6) AS singleton_rate_pct_drift FROM counts GROUP BY country""",
    "score_profile": _with(_ORDERS) + "SELECT count(*) AS pairs, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, "
    + ", ".join(f"count(*) FILTER (WHERE score > CAST({x} AS DOUBLE)) AS over_{round(x * 100)}" for x in (0.5, 0.6, 0.7, 0.8)) + " FROM orders_scored",
    "score_histogram": "SELECT CAST(least(floor(l_quantity / 50 * 80), 79) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "country_source_pivot": _PAIRS + "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE country = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM scored GROUP BY source",
    "link_profile": _RECORDS + """, m AS (SELECT t.source, q.country AS qc, t.country AS tc, jaro_winkler_similarity(q.name, t.name) AS s FROM q JOIN t ON string_split(q.name, ' ')[1] = string_split(t.name, ' ')[1] WHERE q.name <> '' AND t.name <> '')
        SELECT count(*) AS links, count(*) FILTER (WHERE qc <> tc) AS country_violations, round(avg(s), 5) AS avg_name_sim, count(*) FILTER (WHERE s < CAST(0.7 AS DOUBLE)) AS probable_false, count(*) FILTER (WHERE s < CAST(0.5 AS DOUBLE)) AS likely_false,
        round(avg(CASE WHEN s >= CAST(0.7 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS proxy_precision, round(avg(CASE WHEN source = 2 THEN 1.0 ELSE 0.0 END), 6) AS share_s2 FROM m""",
    "event_histogram": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
    "blended_scores": _with(_ORDERS) + "SELECT qid, tid, round(CAST(CAST(CAST(score AS FLOAT) * CAST(0.75 AS DOUBLE) + CAST(1 - score / 2 AS FLOAT) * CAST(0.25 AS DOUBLE) AS FLOAT) AS DOUBLE), 5) AS score FROM orders_scored",
    "worst_errors": _PAIRS + """SELECT qid, tid, label, score, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error FROM scored
        WHERE (score >= CASE WHEN source = 2 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END) <> (label = 1) ORDER BY abs(score - CAST(0.5 AS DOUBLE)) DESC, qid, tid LIMIT 500""",
    "retrieval_misses": _PAIRS + ", pairs AS (SELECT qid, tid FROM scored WHERE score < CAST(0.999999 AS DOUBLE)) SELECT qid, tid FROM truth ANTI JOIN pairs USING (qid, tid) WHERE qid IN (SELECT qid FROM pairs)",
}

# references that share a name or a target are neighbours; the label is the smallest that can be reached
_EDGES = """edges AS (SELECT DISTINCT a.qid AS a, b.qid AS b FROM q a JOIN q b ON a.country = b.country AND a.name = b.name WHERE a.name <> ''
    UNION SELECT a.qid, b.qid FROM truth a JOIN truth b ON a.tid = b.tid),
  reach AS (SELECT qid, qid AS other FROM q UNION SELECT reach.qid, edges.b FROM reach JOIN edges ON reach.other = edges.a),
  groups AS (SELECT qid, min(other) AS group_id FROM reach GROUP BY qid) """
_ORACLES["components"] = _RECORDS + ", " + _EDGES + "SELECT qid, group_id FROM groups"
_ORACLES["group_split"] = _RECORDS + ", " + _EDGES + f""", b AS (SELECT qid, group_id, {_bucket("group_id", 100, 7)} AS bucket, {_bucket("group_id", 3, 8)} AS fold FROM groups)
    SELECT *, CASE WHEN bucket < 80 THEN 'fit' WHEN bucket < 90 THEN 'tune' ELSE 'holdout' END AS split FROM b"""

# -- retrieval: the passes as plain SQL --------------------------------------
_INDEX = f"""
docs AS (SELECT source, country, rid, n, a,
    list_concat(list_concat(list_transform({_set("n")}, lambda w: 'n:' || w), list_transform({_set("a")}, lambda w: 'a:' || w)),
      list_concat(list_transform({_grams("n")}, lambda w: 'ng:' || w),
        list_transform({_grams("a")}, lambda w: 'ag:' || w))) AS terms
  FROM (SELECT source, rid, country, strip_accents({_core("name")}) AS n, strip_accents(address) AS a, kind FROM (
    SELECT source, rid, country, name, address, 't' AS kind FROM t UNION ALL SELECT 1, qid, country, name, address, 'q' FROM q))),
term_rows AS (SELECT source, country, rid, unnest(terms) AS term FROM docs),
stats AS (SELECT source, country, term, count(*) AS df FROM term_rows WHERE source <> 1 GROUP BY ALL),
chosen AS (SELECT q.qid, s.source, i.country FROM q CROSS JOIN (SELECT unnest([2, 3]) AS source) s JOIN (SELECT DISTINCT source, country FROM docs WHERE source <> 1) i ON i.source = s.source
  WHERE CASE WHEN q.country <> '' AND EXISTS (SELECT 1 FROM docs d WHERE d.source = s.source AND d.country = q.country) THEN i.country IN (q.country, '') ELSE true END),
rare AS (SELECT c.qid, c.source, c.country, split_part(r.term, ':', 1) AS field, r.term, s.df, row_number() OVER (PARTITION BY c.qid, c.source, c.country, split_part(r.term, ':', 1) ORDER BY s.df, r.term) - 1 AS place
  FROM chosen c JOIN term_rows r ON r.source = 1 AND r.rid = c.qid JOIN stats s ON s.source = c.source AND s.country = c.country AND s.term = r.term QUALIFY place < 8)"""
_PASSES = """
lists AS (SELECT qid, source, country, field, list({'term': term, 'df': df} ORDER BY place) AS l FROM rare GROUP BY ALL),
passes AS (
  SELECT qid, source, country, field || '_any' AS pass_id, CASE field WHEN 'n' THEN 2 ELSE 4 END AS bit, 1 AS need, list_filter(l[1:3], lambda x: x.df <= 2000) AS l FROM lists WHERE field IN ('n', 'a')
  UNION ALL SELECT qid, source, country, field || '_01', CASE field WHEN 'n' THEN 2 ELSE 4 END, 2, l[1:2] FROM lists WHERE field IN ('n', 'a') AND len(l) >= 2
  UNION ALL SELECT qid, source, country, field || '_0', CASE field WHEN 'ng' THEN 8 ELSE 16 END, 2, l[1:2] FROM lists WHERE field IN ('ng', 'ag') AND len(l) >= 2
  UNION ALL SELECT qid, source, country, field || '_2', CASE field WHEN 'ng' THEN 8 ELSE 16 END, 2, l[3:4] FROM lists WHERE field IN ('ng', 'ag') AND len(l) >= 4
  UNION ALL SELECT x.qid, x.source, x.country, 'na_00', 32, 2, [x.l[1], y.l[1]] FROM lists x JOIN lists y ON x.qid = y.qid AND x.source = y.source AND x.country = y.country AND x.field = 'n' AND y.field = 'a'),
sizes AS (SELECT source, country, count(*) AS docs, avg(len(terms)) AS avg_length FROM docs WHERE source <> 1 GROUP BY ALL),
asked AS (SELECT qid, source, country, pass_id, bit, need, unnest(l).term AS term, unnest(l).df AS df FROM passes),
scores AS (SELECT a.qid, a.source, a.country, a.pass_id, a.bit, a.need, r.rid, count(*) AS held,
    round(sum(greatest(ln((s.docs - a.df + 0.5::DOUBLE) / (a.df + 0.5::DOUBLE)), 1e-6) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.terms) / s.avg_length))), 9) AS score
  FROM asked a JOIN term_rows r ON r.source = a.source AND r.country = a.country AND r.term = a.term JOIN docs d ON d.source = r.source AND d.rid = r.rid JOIN sizes s ON s.source = a.source AND s.country = a.country GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid, source, country, pass_id ORDER BY score DESC, rid) AS rank FROM scores WHERE held >= need QUALIFY rank <= 100),
exact_hits AS (SELECT c.qid, c.source, d.rid FROM chosen c JOIN docs x ON x.source = 1 AND x.rid = c.qid JOIN docs d ON d.source = c.source AND d.country = c.country AND d.n = x.n AND d.a = x.a WHERE x.n <> '' AND x.a <> ''),
fused AS (SELECT qid, source, rid, round(sum(part), 9) AS retrieval_score, bit_or(bit) AS passes, max(exact) AS exact FROM (
    SELECT qid, source, rid, 1 / (rank + 10)::DOUBLE AS part, bit, 0 AS exact FROM hits UNION ALL SELECT qid, source, rid, 2.0, 1, 1 FROM exact_hits) GROUP BY ALL),
candidates AS (SELECT qid, source, rid, retrieval_score, passes, row_number() OVER (PARTITION BY qid, source ORDER BY exact DESC, retrieval_score DESC, rid) AS rank, 'S' || source || '-' || rid AS tid FROM fused)"""
_RETRIEVED = _with(_BASE, _INDEX, _PASSES)
_ORACLES |= {
    "term_df": _with(_BASE, _INDEX) + "SELECT source, country, term, df FROM stats",
    "block_countries": _with(_BASE, _INDEX) + "SELECT qid, source, country FROM chosen",
    "rare_terms": _with(_BASE, _INDEX) + "SELECT qid, source, country, field, term, df, place FROM rare",
    "pass_hits": _RETRIEVED + "SELECT qid, source, pass_id, rid, round(score, 6) AS score, rank FROM hits",
    "rrf_fusion": _RETRIEVED + "SELECT qid, source, rid, round(retrieval_score, 6) AS retrieval_score, CAST(passes AS BIGINT) AS passes, rank FROM candidates",
    "retrieval_recall": _RETRIEVED + """, ks AS (SELECT unnest([20, 50, 100]) AS k) SELECT CAST(k AS BIGINT) AS k, count(*) AS true_pairs, count(*) FILTER (WHERE rank <= k) AS recovered,
        round(CAST(count(*) FILTER (WHERE rank <= k) AS DOUBLE) / greatest(count(*), 1), 6) AS recall FROM ks, truth LEFT JOIN candidates c ON truth.qid = c.qid AND truth.tid = c.tid GROUP BY k""",
    "name_jaro_winkler": _RETRIEVED + "SELECT c.qid, c.tid, round(jaro_winkler_similarity(q.name, t.name), 6) AS similarity FROM candidates c JOIN q ON q.qid = c.qid JOIN t ON t.tid = c.tid",
    "structural_negatives": _RETRIEVED + """, apart AS MATERIALIZED (SELECT c.qid, c.tid, q.address AS qa, t.address AS ta FROM candidates c JOIN q ON q.qid = c.qid JOIN t ON t.tid = c.tid
        WHERE (q.nt <> t.nt OR q.nt = '') AND jaro_winkler_similarity(q.name, t.name) < CAST(0.6 AS DOUBLE)) SELECT qid, tid FROM apart WHERE jaro_winkler_similarity(qa, ta) >= CAST(0.8 AS DOUBLE)""",
    "alias_tokens": _RECORDS + f""", w AS (SELECT t.source, {_WORDS.format("q.name")} AS l, {_WORDS.format("t.name")} AS r FROM q JOIN t ON q.country = t.country AND string_split(q.name, ' ')[1] = string_split(t.name, ' ')[1] WHERE q.name <> '' AND t.name <> ''),
        p AS (SELECT source, unnest(l) AS u, unnest(r) AS v FROM w WHERE len(l) = len(r)), c AS (SELECT source, u, v, count(*) AS n FROM p WHERE strlen(u) = length(u) AND strlen(v) <> length(v) AND length(u) >= 3 GROUP BY ALL),
        k AS (SELECT *, sum(n) OVER (PARTITION BY source, u) AS total, row_number() OVER (PARTITION BY source, u ORDER BY n DESC, v) AS place FROM c)
        SELECT source, u AS token, string_agg(v, ' ' ORDER BY place) AS variants FROM k WHERE total >= 2 AND place <= 6 AND n >= 1 AND n / total >= CAST(0.05 AS DOUBLE) GROUP BY source, u""",
}


# -- the 45 features of pairs of parts ----------------------------------------


def _ratio(a: str, b: str) -> str:
    """2 * LCS / both lengths. A row of the LCS table goes through the characters of b; it is the list [LCS of a's first i and what of b has gone by]."""
    chars = f"string_split({a}, '')"
    step = f"lambda row, c: list_transform(range(1, length({a}) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda i: unicode({chars}[i]) = c[1]), lambda i: CASE WHEN i = 1 THEN 1 ELSE row[i - 1] + 1 END)), 0)))"
    rows = f"list_concat([list_transform(range(1, length({a}) + 1), lambda i: CAST(0 AS BIGINT))], list_transform(string_split({b}, ''), lambda c: [CAST(unicode(c) AS BIGINT)]))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0::DOUBLE * list_reduce({rows}, {step})[length({a})] / (length({a}) + length({b})) END"


def _in_both(f: str) -> str:
    return f"list_intersect(q.{f}, t.{f})"


def _part_feature_sql() -> dict[str, str]:
    some = lambda f: f"len(q.{f}) > 0 AND len(t.{f}) > 0"
    out = {}
    for kind, f, words, g in (("name", "n", "nt", "ng"), ("address", "a", "at", "ag")):
        both = f"q.{f} <> '' AND t.{f} <> ''"
        out |= {
            f"{kind}_exact": f"CASE WHEN {both} AND q.{f} = t.{f} THEN 1 ELSE 0 END",
            f"{kind}_missing": f"CASE WHEN {both} THEN 0 ELSE 1 END",
            f"{kind}_jaccard": _jaccard(f"q.{words}", f"t.{words}"),
            f"{kind}_containment": f"CASE WHEN least(len(q.{words}), len(t.{words})) > 0 THEN len({_in_both(words)})::DOUBLE / least(len(q.{words}), len(t.{words})) ELSE 0 END",
            f"{kind}_gram_jaccard": _jaccard(f"q.{g}", f"t.{g}"),
            f"{kind}_length_ratio": f"CASE WHEN greatest(length(q.{f}), length(t.{f})) > 0 THEN least(length(q.{f}), length(t.{f}))::DOUBLE / greatest(length(q.{f}), length(t.{f})) ELSE 0 END",
            f"{kind}_tokens_log": f"ln(1 + least(len(q.{words}), len(t.{words})))",
            f"{kind}_jaro": f"CASE WHEN {both} THEN jaro_winkler_similarity(q.{f}, t.{f}) ELSE 0 END",
            f"{kind}_ratio": f"{kind[0]}_ratio",
            f"{kind}_token_sort": f"{kind[0]}_sort",
            f"{kind}_token_set": f"CASE WHEN NOT ({both}) THEN 0 WHEN {kind[0]}_shared <> '' AND ({kind[0]}_left = {kind[0]}_shared OR {kind[0]}_right = {kind[0]}_shared) THEN 1 ELSE greatest({kind[0]}_lr, {kind[0]}_sl, {kind[0]}_sr) END",
        }
    out |= {
        "name_core_exact": "CASE WHEN q.core <> '' AND q.core = t.core THEN 1 ELSE 0 END",
        "name_fold_exact": "CASE WHEN q.n <> '' AND strip_accents(q.n) = strip_accents(t.n) THEN 1 ELSE 0 END",
        "name_acronym": f"CASE WHEN {some('nt')} AND q.ac = t.ac THEN 1 ELSE 0 END",
        "number_jaccard": _jaccard("q.num", "t.num"),
        "number_shared": f"len({_in_both('num')})",
        "number_conflict": f"CASE WHEN {some('num')} AND len({_in_both('num')}) = 0 THEN 1 ELSE 0 END",
        "postal_agree": f"CASE WHEN len({_in_both('pc')}) > 0 THEN 1 ELSE 0 END",
        "postal_conflict": f"CASE WHEN {some('pc')} AND len({_in_both('pc')}) = 0 THEN 1 ELSE 0 END",
        "script_equal": "CASE WHEN regexp_matches(q.n, '[a-z]') = regexp_matches(t.n, '[a-z]') THEN 1 ELSE 0 END",
        "country_equal": "CASE WHEN q.country = t.country THEN 1 ELSE 0 END",
        "rank_inverse": "1.0::DOUBLE / greatest(rank, 1)",
        "retrieval_score": "1.0::DOUBLE / (rank + 10)",
        "pass_count": "bit_count(passes::INTEGER)",
        "candidate_count_log": "ln(1 + count(*) OVER (PARTITION BY q.k))",
    }
    out |= {f"{name}_pass": f"(passes >> {i}) & 1" for i, name in enumerate(("exact", "name", "address", "name_gram", "address_gram", "combined"))}
    return {f: out[f] for f in FEATURES if f in out}


def _part_pairs_sql() -> str:
    sides = []
    for p, f in (("n", "n"), ("a", "a")):
        ws = f"{f}t"
        joined = lambda x: f"array_to_string(list_sort({x}), ' ')"
        shared, left, right = joined(_in_both(ws)), f"list_filter(q.{ws}, lambda w: NOT list_contains(t.{ws}, w))", f"list_filter(t.{ws}, lambda w: NOT list_contains(q.{ws}, w))"
        sides.append(f"{shared} AS {p}_shared, trim({shared} || ' ' || {joined(left)}) AS {p}_left, trim({shared} || ' ' || {joined(right)}) AS {p}_right, q.{f} AS {p}_q, t.{f} AS {p}_t, {joined(_WORDS.format(f'q.{f}'))} AS {p}_qs, {joined(_WORDS.format(f't.{f}'))} AS {p}_ts")
    edits = []
    for p in "na":
        pairs = {"ratio": (f"{p}_q", f"{p}_t"), "sort": (f"{p}_qs", f"{p}_ts"), "lr": (f"{p}_left", f"{p}_right"), "sl": (f"{p}_shared", f"{p}_left"), "sr": (f"{p}_shared", f"{p}_right")}
        edits += [f"{_ratio(a, b)} AS {p}_{name}" for name, (a, b) in pairs.items()]
    spelt = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ADDRESS_WORDS.items()) + " ELSE w END), ' ')"
    normal = lambda x: _NORMAL.replace("coalesce(text, '')", x)
    return f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS country, p_type || ':' || p_brand || ':' || (p_size % 10) AS block, {normal("p_name")} AS n,
    {spelt.format(normal("p_brand || ' ' || p_type || ' ' || (p_size * 1000) || ' Rd'"))} AS a FROM part),
v AS (SELECT *, {_core("n")} AS core, {_set("n")} AS nt, {_set("a")} AS at, {_grams("n")} AS ng, {_grams("a")} AS ag, list_distinct(regexp_extract_all(a, '[0-9]+')) AS num,
    list_filter(list_distinct(regexp_extract_all(a, '[0-9]+')), lambda d: length(d) IN (5, 6)) AS pc, array_to_string(list_transform({_WORDS.format("n")}, lambda w: substr(w, 1, 1)), '') AS ac FROM p),
met AS (SELECT q, t, row_number() OVER (PARTITION BY q.k ORDER BY t.k) AS rank, (q.k + t.k) % 64 AS passes, {", ".join(sides)} FROM v q JOIN v t ON q.block = t.block WHERE q.k % 3 = 0 AND t.k % 3 <> 0),
edits AS (SELECT *, {", ".join(edits)} FROM met),
plain AS (SELECT q.k AS qid, t.k AS tid, {", ".join(f"CAST({sql} AS FLOAT) AS {name}" for name, sql in _part_feature_sql().items())} FROM edits),
f AS (SELECT *, CAST(name_ratio::DOUBLE * address_ratio::DOUBLE AS FLOAT) AS name_address_product, CAST(name_ratio::DOUBLE * (1 - address_ratio::DOUBLE) AS FLOAT) AS name_only_evidence,
    CAST(address_ratio::DOUBLE * (1 - name_ratio::DOUBLE) AS FLOAT) AS address_only_evidence FROM plain)
"""


_ORACLES["pair_features_all"] = _part_pairs_sql() + "SELECT qid, tid, " + ", ".join(f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in FEATURES) + " FROM f"
_ORACLES["rule_scores"] = _part_pairs_sql() + """SELECT qid, tid, round(CAST(greatest(name_exact * address_exact, CASE WHEN name_ratio >= 0.93::FLOAT AND address_ratio >= 0.88::FLOAT AND number_conflict = 0 THEN 0.9::FLOAT ELSE 0::FLOAT END) AS DOUBLE), 5) AS score FROM f"""


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
