"""DuckDB SQL fragments for the driver's oracle check (``oracle_sql()``).

These are independent re-statements of each operator in plain SQL over the
same parquet views, used only to cross-check the Spark plans.

RE2 (DuckDB) has an ASCII-only ``\\b``/``\\w`` while the reference's Python
regexes are Unicode-aware. ``uw(x)`` rewrites every non-ASCII letter or digit
to ``_`` (a word character that no pattern here matches), which makes RE2's
word boundaries fall exactly where Python's do; matched substrings are
unchanged because the patterns only match ASCII characters.
"""

from __future__ import annotations

from relmine.functions.text import STOP_WORDS

# Python str.split() separators in RE2 syntax (RE2's \s lacks \v and non-ASCII spaces)
WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def uw(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^\P{{L}}\x00-\x7F]', '_', 'g'), '[^\P{{N}}\x00-\x7F]', '_', 'g')"


def extract(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def tfidf_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOP_LIST}, t))"


def ws_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WS}')"


def entities(x: str) -> str:
    u = uw(x)
    return (
        f"list_distinct(list_concat({extract(u, r'\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b')}, "
        f"{extract(u, r'\$?[\d,]+(?:\.\d+)?%?')}))"
    )


def percent_numbers(x: str) -> str:
    return f"list_distinct({extract(uw(x), r'\b\d+(?:\.\d+)?%?\b')})"


def plain_numbers(x: str) -> str:
    return f"list_transform({extract(uw(x), r'\b\d+(?:\.\d+)?\b')}, lambda n: n::DOUBLE)"


def count_matches(x: str, pattern: str) -> str:
    return f"len({extract(uw(x), pattern)})"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sentences(x: str) -> str:
    """TX6 without lookbehind: mark each break with chr(1) then split."""
    marked = f"regexp_replace({py_strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {py_strip('s')}), lambda s: length(s) > 10)"


def share(inter: str, base: str, empty: str = "1.0") -> str:
    return f"CASE WHEN len({base}) = 0 THEN {empty} ELSE len({inter})::DOUBLE / len({base}) END"


def faithfulness(pairs_sql: str, keys: list[str], extra: list[str] | None = None) -> str:
    """FG1–FG7 over a ``pairs`` relation with columns keys, context, response (+ extra)."""
    extra = extra or []
    k = ", ".join(keys)
    carry = ", ".join(keys + extra)
    neg = r"\bnot\b|\bno\b|\bnever\b|\bnone\b"
    amp = r"\ball\b|\bevery\b|\balways\b"
    hed = r"\bsome\b|\bfew\b|\brarely\b"
    fw = "['the', 'a', 'an', 'is', 'are', 'was', 'were']"
    return f"""
WITH pairs AS ({pairs_sql}),
base AS (
  SELECT {carry},
    {entities('context')} AS ec, {entities('response')} AS er,
    {percent_numbers('context')} AS pc, {percent_numbers('response')} AS pr,
    list_distinct({plain_numbers('lower(context)')}) AS fc, list_distinct({plain_numbers('lower(response)')}) AS fr,
    {count_matches('lower(context)', neg)} AS negc, {count_matches('lower(response)', neg)} AS negr,
    {count_matches('lower(context)', amp)} AS ampc, {count_matches('lower(response)', hed)} AS hedr,
    list_distinct({ws_tokens('lower(context)')}) AS wc,
    list_distinct(list_filter({ws_tokens('lower(response)')}, lambda w: NOT list_contains({fw}, w))) AS claims
  FROM pairs
),
toks AS (
  SELECT {k}, 0 AS side, unnest({tfidf_tokens('context')}) AS term FROM pairs
  UNION ALL
  SELECT {k}, 1 AS side, unnest({tfidf_tokens('response')}) AS term FROM pairs
),
tf AS (
  SELECT {k}, term, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b
  FROM toks GROUP BY {k}, term
),
capped AS (
  SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY a + b DESC, term) <= 500
),
wt AS (
  SELECT {k},
    a * (ln(3.0::DOUBLE / ((a > 0)::INT + (b > 0)::INT + 1.0::DOUBLE)) + 1.0::DOUBLE) AS wa,
    b * (ln(3.0::DOUBLE / ((a > 0)::INT + (b > 0)::INT + 1.0::DOUBLE)) + 1.0::DOUBLE) AS wb
  FROM capped
),
sims AS (
  SELECT {k},
    CASE WHEN sum(wa * wa) = 0 OR sum(wb * wb) = 0 THEN 0.0::DOUBLE
         ELSE sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) END AS sim
  FROM wt GROUP BY {k}
),
m AS (
  SELECT {', '.join('base.' + c for c in keys + extra)},
    round({share('list_filter(ec, lambda x: list_contains(er, x))', 'ec')}, 3) AS entity_coverage,
    round({share('list_filter(pc, lambda x: list_contains(pr, x))', 'pc')}, 3) AS numeric_fidelity,
    round(coalesce(sims.sim, 0.5::DOUBLE), 3) AS semantic_similarity,
    round(least(
      CASE WHEN abs(negc - negr) > 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN len(fc) > 0 AND len(fr) > 0
              AND len(list_filter(fr, lambda x: NOT list_contains(fc, x))) > 0
              AND len(list_filter(fr, lambda x: NOT list_contains(fc, x))) > len(fc) * 0.5::DOUBLE
             THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN ampc > 0 AND hedr > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 3) AS contradiction_score,
    round(len(list_filter(claims, lambda x: NOT list_contains(wc, x)))::DOUBLE / greatest(len(claims), 1), 3) AS novel_word_ratio
  FROM base LEFT JOIN sims ON {' AND '.join(f'base.{c} = sims.{c}' for c in keys)}
)
SELECT *,
  0.3::DOUBLE * entity_coverage + 0.2::DOUBLE * numeric_fidelity + 0.3::DOUBLE * semantic_similarity
    + 0.2::DOUBLE * (1.0::DOUBLE - contradiction_score) AS faithfulness_score,
  (0.3::DOUBLE * entity_coverage + 0.2::DOUBLE * numeric_fidelity + 0.3::DOUBLE * semantic_similarity
    + 0.2::DOUBLE * (1.0::DOUBLE - contradiction_score)) > 0.5::DOUBLE AS predicted_faithful
FROM m
"""


CONVERSATION_PAIRS = """
SELECT r.conv_id, r.turn, c.text AS context, r.text AS response
FROM conversations r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn + 1 = r.turn
WHERE r.role = 'assistant'
"""

DOCUMENT_PAIRS = """
SELECT r.doc_id, c.text AS context, r.text AS response, (l.quality = 1) AS is_faithful
FROM documents r JOIN documents c ON c.doc_id + 1 = r.doc_id
LEFT JOIN labels l ON l.doc_id = r.doc_id
"""


def drift_events(threshold: float = 0.3) -> str:
    """DR1/DR2 over events: per user, ordered by ts; score = value / 500."""
    return f"""
WITH ev AS (
  SELECT user_id, event_id, ts, value / 500.0::DOUBLE AS trust_score, event_type = 'error' AS is_hallucination
  FROM events
),
pos AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS sentence_idx,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM ev
),
d AS (
  SELECT *, avg(trust_score) OVER (PARTITION BY user_id ORDER BY sentence_idx
                                   ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - trust_score AS drop_
  FROM pos
),
best AS (
  SELECT user_id, sentence_idx AS detected_drift_point FROM d
  WHERE sentence_idx >= 1 AND drop_ > {threshold} AND n >= 3
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY drop_ DESC, sentence_idx) = 1
),
act AS (
  SELECT user_id, min(sentence_idx) FILTER (WHERE is_hallucination)::INTEGER AS actual_drift_point FROM pos GROUP BY user_id
)
SELECT d.user_id, d.event_id, d.trust_score, d.is_hallucination, d.sentence_idx,
       best.detected_drift_point::INTEGER AS detected_drift_point, act.actual_drift_point,
       coalesce(d.sentence_idx >= best.detected_drift_point, false) AS post_drift,
       coalesce(d.sentence_idx >= best.detected_drift_point, false) = d.is_hallucination AS prediction_correct
FROM d LEFT JOIN best USING (user_id) JOIN act USING (user_id)
"""


def _search(text: str, pattern: str) -> str:
    return f"regexp_matches({uw(text)}, '{pattern}', 'i')::INTEGER"


def _cut(x: str, bins) -> str:
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{label}'" for lo, hi, label in bins)
    return f"CASE {arms} END"


def prompt_features(source_sql: str, keys: list[str]) -> str:
    """QF1–QF15 over a relation with columns keys + query."""
    from relmine.operators import features as QF

    t = "coalesce(query, '')"
    st = f"regexp_replace(lower({t}), '^\\s+|\\s+$', '', 'g')"
    qt = []
    for label, prefixes, contains in QF.QUESTION_TYPES:
        conds = [f"starts_with({st}, '{p}')" for p in prefixes] + [f"contains({st}, '{c}')" for c in contains]
        qt.append(f"WHEN {' OR '.join(conds)} THEN '{label}'")
    numeric = _search(t, "|".join(QF.NUMERIC_PATTERNS))
    temporal = _search(t, "|".join(QF.TEMPORAL_PATTERNS))
    specific = _search(t, "|".join(QF.SPECIFICITY_PATTERNS))
    listing = _search(t, QF.LIST_PATTERN)
    return f"""
WITH src AS ({source_sql}),
f AS (
  SELECT {', '.join(keys)},
    len(regexp_extract_all({t}, '{WS}'))::INTEGER AS query_word_count,
    length({t})::INTEGER AS query_char_count,
    contains({t}, '?')::INTEGER AS has_question_mark,
    CASE {' '.join(qt)} ELSE 'other' END AS question_type,
    {numeric} AS demands_numeric,
    {temporal} AS has_temporal_ref,
    {specific} AS demands_specificity,
    {_search(t, "|".join(QF.PERSON_PATTERNS))} AS asks_about_person,
    {listing} AS asks_for_list,
    {_search(t, QF.ACADEMIC_PATTERN)} AS domain_academic,
    {_search(t, QF.FINANCE_PATTERN)} AS domain_finance,
    {_search(t, QF.MEDICAL_PATTERN)} AS domain_medical
  FROM src
)
SELECT *,
  (demands_numeric + demands_specificity + asks_for_list + has_temporal_ref)::INTEGER AS specificity_demand_score,
  {_cut('query_word_count', QF.LENGTH_BINS)} AS length_bin,
  {_cut('(demands_numeric + demands_specificity + asks_for_list + has_temporal_ref)', QF.SPECIFICITY_BINS)} AS specificity_bin
FROM f
"""


def label_features(source_sql: str, keys: list[str]) -> str:
    """LF1–LF5 over a relation with columns keys + query + response."""
    from relmine.operators import features as QF

    q = "lower(coalesce(query, ''))"
    r = "coalesce(response, '')"
    person = " OR ".join(f"contains({q}, '{w}')" for w in QF.PERSON_WORDS)
    listing = " OR ".join(f"contains({q}, '{w}')" for w in QF.LIST_WORDS)
    return f"""
WITH src AS ({source_sql})
SELECT {', '.join(keys)},
  regexp_matches({r}, '\\d+') AS has_numeric_claim,
  regexp_matches({r}, '[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*') AS has_named_entity,
  ({person}) AS asks_about_person_raw,
  ({listing}) AS asks_for_list_raw,
  regexp_matches({q}, '{QF.SPECIFIC_COUNT_PATTERN}') AS asks_specific_count,
  len(regexp_extract_all(coalesce(query, ''), '{WS}'))::INTEGER AS query_length,
  len(regexp_extract_all({r}, '{WS}'))::INTEGER AS response_length
FROM src
"""


DOCUMENT_QUERIES = "SELECT doc_id, text AS query FROM documents"
CONVERSATION_QUERIES = "SELECT conv_id AS prompt_id, text AS query FROM conversations WHERE turn = 0"
CONVERSATION_QR = """
SELECT r.conv_id, r.turn, c.text AS query, r.text AS response
FROM conversations r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn + 1 = r.turn
WHERE r.role = 'assistant'
"""


CONVERSATION_PROMPTS = "SELECT conv_id AS prompt_id, text AS query, (conv_id % 3 = 0) AS is_hallucination FROM conversations WHERE turn = 0"
CONVERSATION_SAMPLES = "SELECT conv_id AS prompt_id, turn::INTEGER AS sample_idx, text AS response FROM conversations WHERE role = 'assistant'"


def consistency(queries_sql: str, samples_sql: str) -> str:
    """SC1–SC7: queries left-joined with per-prompt metrics; pairwise
    statistics over all i<j sample pairs of a prompt (brute force)."""
    return f"""
WITH q AS ({queries_sql}),
s AS (SELECT * FROM ({samples_sql}) WHERE response IS NOT NULL AND prompt_id IN (SELECT prompt_id FROM q)),
n AS (
  SELECT prompt_id, count(*) AS n,
    avg(len(regexp_extract_all(response, '{WS}'))) AS len_mean,
    stddev_pop(len(regexp_extract_all(response, '{WS}'))) AS len_std
  FROM s GROUP BY prompt_id
),
tok AS (SELECT prompt_id, sample_idx, unnest({tfidf_tokens('response')}) AS term FROM s),
tf AS (SELECT prompt_id, sample_idx, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT prompt_id, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
kept AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY total DESC, term) <= 500),
w0 AS (
  SELECT tf.prompt_id, tf.sample_idx, tf.term,
         tf.tf * (ln((n.n + 1.0::DOUBLE) / (kept.df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM tf JOIN kept USING (prompt_id, term) JOIN n USING (prompt_id)
),
w AS (SELECT prompt_id, sample_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY prompt_id, sample_idx)) AS w FROM w0),
dots AS (
  SELECT a.prompt_id, a.sample_idx AS i, b.sample_idx AS j, sum(a.w * b.w) AS c
  FROM w a JOIN w b ON a.prompt_id = b.prompt_id AND a.term = b.term AND a.sample_idx < b.sample_idx
  GROUP BY ALL
),
allpairs AS (
  SELECT a.prompt_id, coalesce(d.c, 0.0::DOUBLE) AS c
  FROM s a JOIN s b ON a.prompt_id = b.prompt_id AND a.sample_idx < b.sample_idx
  LEFT JOIN dots d ON d.prompt_id = a.prompt_id AND d.i = a.sample_idx AND d.j = b.sample_idx
),
sem AS (
  SELECT prompt_id, avg(c) AS sem_mean, min(c) AS sem_min, stddev_pop(c) AS sem_std FROM allpairs GROUP BY prompt_id
),
vocab AS (SELECT DISTINCT prompt_id FROM kept),
lw AS (SELECT DISTINCT prompt_id, sample_idx, unnest(regexp_extract_all(lower(response), '{WS}')) AS word FROM s),
lwc AS (SELECT prompt_id, word, count(*) AS c FROM lw GROUP BY ALL),
lex AS (
  SELECT lwc.prompt_id, count(*) AS n_union, count(*) FILTER (WHERE lwc.c = n.n) AS n_inter
  FROM lwc JOIN n USING (prompt_id) GROUP BY lwc.prompt_id
),
nums AS (SELECT prompt_id, sample_idx, {plain_numbers('response')} AS xs FROM s),
numv AS (SELECT prompt_id, stddev_pop(x) AS num_std FROM (SELECT prompt_id, unnest(xs) AS x FROM nums) GROUP BY prompt_id),
firsts AS (SELECT prompt_id, xs[1] AS f FROM nums WHERE len(xs) > 0),
agree AS (
  SELECT prompt_id, max(c)::DOUBLE / sum(c) AS agree
  FROM (SELECT prompt_id, f, count(*) AS c FROM firsts GROUP BY ALL) GROUP BY prompt_id
),
m AS (
  SELECT n.prompt_id,
    CASE WHEN vocab.prompt_id IS NULL THEN 1.0::DOUBLE ELSE sem.sem_mean END AS semantic_consistency,
    CASE WHEN vocab.prompt_id IS NULL THEN 1.0::DOUBLE ELSE sem.sem_min END AS semantic_consistency_min,
    CASE WHEN vocab.prompt_id IS NULL THEN 0.0::DOUBLE ELSE sem.sem_std END AS semantic_consistency_std,
    coalesce(lex.n_inter, 0)::DOUBLE / greatest(coalesce(lex.n_union, 0), 1) AS lexical_overlap,
    coalesce(numv.num_std, 0.0::DOUBLE) AS numeric_variance,
    coalesce(agree.agree, 1.0::DOUBLE) AS numeric_agreement,
    n.len_std / greatest(n.len_mean, 1.0::DOUBLE) AS length_cv
  FROM n LEFT JOIN sem USING (prompt_id) LEFT JOIN vocab USING (prompt_id) LEFT JOIN lex USING (prompt_id)
    LEFT JOIN numv USING (prompt_id) LEFT JOIN agree USING (prompt_id)
  WHERE n.n >= 2
),
mc AS (
  SELECT *, 0.4::DOUBLE * semantic_consistency + 0.2::DOUBLE * lexical_overlap + 0.2::DOUBLE * numeric_agreement
            + 0.2::DOUBLE * (1.0::DOUBLE - least(length_cv, 1.0::DOUBLE)) AS composite_consistency
  FROM m
)
SELECT q.*, {', '.join('mc.' + c for c in SC_METRICS)}
FROM q LEFT JOIN mc USING (prompt_id)
"""


def tfidf_weights(docs_sql: str) -> str:
    """TX7 by windows over a relation with columns gid, doc, text."""
    return f"""
WITH d AS (SELECT * FROM ({docs_sql}) WHERE text IS NOT NULL),
n AS (SELECT gid, count(*) AS n FROM d GROUP BY gid),
tok AS (SELECT gid, doc, unnest({tfidf_tokens('text')}) AS term FROM d),
tf AS (SELECT gid, doc, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT gid, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY total DESC, term) AS rank FROM st QUALIFY rank <= 500
),
w AS (
  SELECT tf.gid, tf.doc, tf.term, kept.rank, tf.tf * (ln((n.n + 1.0::DOUBLE) / (kept.df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM tf JOIN kept USING (gid, term) JOIN n USING (gid)
)
SELECT gid, doc, term, rank::INTEGER AS rank, w / sqrt(sum(w * w) OVER (PARTITION BY gid, doc)) AS weight FROM w
"""


SC_METRICS = [
    "semantic_consistency", "semantic_consistency_min", "semantic_consistency_std", "lexical_overlap",
    "numeric_variance", "numeric_agreement", "length_cv", "composite_consistency",
]


def histogram(src_sql: str, value: str, groups: list[str], bins: int) -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"r.{c} = st.{c}" for c in groups)

    def edge(k: str) -> str:
        return f"CASE WHEN {k} = {bins} THEN hi ELSE ({k})::DOUBLE * ((hi - lo) / {float(bins)}) + lo END"

    return f"""
WITH r AS (SELECT {g}, ({value})::DOUBLE AS x FROM ({src_sql}) WHERE {value} IS NOT NULL),
st AS (
  SELECT {g},
    CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM r GROUP BY {g}
),
b0 AS (
  SELECT {', '.join('r.' + c for c in groups)}, r.x, st.lo, st.hi,
    least(floor((r.x - st.lo) / (st.hi - st.lo) * {float(bins)})::INTEGER, {bins - 1}) AS i0
  FROM r JOIN st ON {on}
),
b1 AS (SELECT *, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT {g}, CASE WHEN x >= {edge('i1 + 1')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS i FROM b1),
cnt AS (SELECT {g}, i, count(*) AS c FROM b2 GROUP BY ALL),
allb AS (SELECT st.*, range::INTEGER AS i FROM st, range({bins}))
SELECT {', '.join('allb.' + c for c in groups)}, allb.i AS bin,
  {edge('allb.i').replace('hi', 'allb.hi').replace('lo', 'allb.lo')} AS bin_start,
  {edge('allb.i + 1').replace('hi', 'allb.hi').replace('lo', 'allb.lo')} AS bin_end,
  coalesce(cnt.c, 0)::BIGINT AS count
FROM allb LEFT JOIN cnt ON {' AND '.join(f'allb.{c} = cnt.{c}' for c in groups)} AND allb.i = cnt.i
"""


def threshold_sweep(src_sql: str, score: str, label: str, points: int = 50) -> str:
    """Brute force: every threshold against every row."""
    return f"""
WITH r AS (SELECT {label} AS y, {score} AS s FROM ({src_sql})),
t AS (SELECT range::INTEGER AS k,
             CASE WHEN range = {points - 1} THEN 1.0::DOUBLE ELSE range * (1.0::DOUBLE / {points - 1}) END AS threshold
      FROM range({points})),
c AS (
  SELECT t.k, t.threshold,
    count(*) FILTER (WHERE r.s < t.threshold AND r.y) AS tp,
    count(*) FILTER (WHERE r.s < t.threshold AND NOT r.y) AS fp,
    count(*) FILTER (WHERE NOT coalesce(r.s < t.threshold, false) AND r.y) AS fn,
    count(*) FILTER (WHERE NOT coalesce(r.s < t.threshold, false) AND NOT r.y) AS tn
  FROM t, r GROUP BY t.k, t.threshold
)
SELECT k, threshold, tp, fp, fn, tn,
  tp::DOUBLE / greatest(tp + fn, 1) AS tpr, fp::DOUBLE / greatest(fp + tn, 1) AS fpr
FROM c
"""


DOCUMENT_RESPONSES_REF = """
SELECT d.doc_id AS response_id, d.text AS response, b.text AS reference
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
"""
DOCUMENT_RESPONSES_NOREF = "SELECT doc_id AS response_id, text AS response, NULL::VARCHAR AS reference FROM documents"


def trust_map(responses_sql: str, threshold: float = 0.3) -> str:
    """DR4–DR6; the no-reference mean uses explicit sentence pairs j < i."""
    return f"""
WITH r AS (
  SELECT response_id AS rid, response, CASE WHEN length(reference) > 0 THEN reference END AS ref FROM ({responses_sql})
),
s0 AS (SELECT rid, ref IS NOT NULL AS has_ref, {sentences('response')} AS ss FROM r),
sents AS (SELECT rid, has_ref, unnest(ss) AS sentence, (generate_subscripts(ss, 1) - 1)::INTEGER AS sentence_idx FROM s0),
ns AS (SELECT rid, count(*) AS n_sent, any_value(has_ref) AS has_ref FROM sents GROUP BY rid),
docs AS (
  SELECT rid, sentence_idx AS did, sentence AS txt FROM sents
  UNION ALL
  SELECT r.rid, -1 AS did, r.ref AS txt FROM r JOIN ns USING (rid) WHERE r.ref IS NOT NULL
),
tok AS (SELECT rid, did, unnest({tfidf_tokens('txt')}) AS term FROM docs),
tf AS (SELECT rid, did, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT rid, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
kept AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY rid ORDER BY total DESC, term) <= 500),
nd AS (SELECT rid, n_sent + CASE WHEN has_ref THEN 1 ELSE 0 END AS nd FROM ns),
w0 AS (
  SELECT tf.rid, tf.did, tf.term, tf.tf * (ln((nd.nd + 1.0::DOUBLE) / (kept.df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM tf JOIN kept USING (rid, term) JOIN nd USING (rid)
),
w AS (SELECT rid, did, term, w / sqrt(sum(w * w) OVER (PARTITION BY rid, did)) AS w FROM w0),
vocab AS (SELECT DISTINCT rid FROM kept),
refcos AS (
  SELECT a.rid, a.did, sum(a.w * b.w) AS c FROM w a JOIN w b
    ON a.rid = b.rid AND a.term = b.term AND b.did = -1 AND a.did >= 0 GROUP BY ALL
),
prevdot AS (
  SELECT a.rid, a.did, sum(a.w * b.w) AS c FROM w a JOIN w b
    ON a.rid = b.rid AND a.term = b.term AND b.did >= 0 AND b.did < a.did GROUP BY ALL
),
sc AS (
  SELECT s.rid, s.sentence_idx, s.sentence,
    CASE WHEN s.has_ref THEN (CASE WHEN v.rid IS NULL THEN 0.5::DOUBLE ELSE coalesce(rc.c, 0.0::DOUBLE) END)
         ELSE (CASE WHEN ns.n_sent <= 1 THEN 0.8::DOUBLE WHEN v.rid IS NULL THEN 0.5::DOUBLE
                    WHEN s.sentence_idx = 0 THEN 0.9::DOUBLE ELSE coalesce(pd.c, 0.0::DOUBLE) / s.sentence_idx END) END AS score,
    ns.n_sent
  FROM sents s JOIN ns USING (rid) LEFT JOIN vocab v ON v.rid = s.rid
    LEFT JOIN refcos rc ON rc.rid = s.rid AND rc.did = s.sentence_idx
    LEFT JOIN prevdot pd ON pd.rid = s.rid AND pd.did = s.sentence_idx
),
d AS (
  SELECT *, avg(score) OVER (PARTITION BY rid ORDER BY sentence_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - score AS drop_
  FROM sc
),
best AS (
  SELECT rid, sentence_idx AS drift_point FROM d
  WHERE sentence_idx >= 1 AND drop_ > {threshold} AND n_sent >= 3
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY drop_ DESC, sentence_idx) = 1
)
SELECT d.rid AS response_id, d.sentence_idx, d.sentence, round(d.score, 3) AS trust_score,
  coalesce(d.sentence_idx >= best.drift_point, false) AS is_post_drift, best.drift_point::INTEGER AS drift_point
FROM d LEFT JOIN best USING (rid)
"""


LINEITEM_RISK = """
SELECT l_orderkey, l_linenumber, l_linestatus,
  (l_linenumber = 1)::INTEGER AS is_first_line,
  (l_linenumber >= 5)::INTEGER AS is_late_line,
  (l_tax > 0.04)::INTEGER AS high_tax,
  CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS quantity_bin,
  CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS discount_bin,
  (l_returnflag = 'R') AS is_returned
FROM lineitem
"""


def mined_rules(src_sql: str, features: list[tuple[str, bool]], label: str, min_support: float, min_confidence: float) -> str:
    """RR1–RR3 by brute force: one GROUP BY per feature and per feature pair."""
    from itertools import combinations

    n = "(SELECT count(*) FROM t)"
    parts = []
    for f, is_str in features:
        elig = "TRUE" if is_str else f"(SELECT count(DISTINCT {f}) FROM t) <= 5"
        parts.append(
            f"""SELECT '{f}=' || {f}::VARCHAR AS rule, avg({label}::INTEGER::DOUBLE) AS confidence,
                 count(*)::DOUBLE / {n} AS support, count(*) AS n_matches, 'single' AS kind
               FROM t WHERE {f} IS NOT NULL AND {elig} GROUP BY {f}
               HAVING count(*) >= {min_support} * {n} AND avg({label}::INTEGER::DOUBLE) >= {min_confidence}"""
        )
    numeric = [f for f, is_str in features if not is_str]
    for a, b in combinations(numeric, 2):
        parts.append(
            f"""SELECT '{a}=' || {a}::VARCHAR || ' & {b}=' || {b}::VARCHAR AS rule, avg({label}::INTEGER::DOUBLE) AS confidence,
                 count(*)::DOUBLE / {n} AS support, count(*) AS n_matches, 'pair' AS kind
               FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL
                 AND (SELECT count(DISTINCT {a}) FROM t) <= 3 AND (SELECT count(DISTINCT {b}) FROM t) <= 3
               GROUP BY {a}, {b}
               HAVING count(*) >= greatest({min_support} * {n}, 5) AND avg({label}::INTEGER::DOUBLE) >= {min_confidence}"""
        )
    body = "\nUNION ALL\n".join(parts)
    return f"WITH t AS ({src_sql})\n{body}"


def tree(src_sql: str, features: list[tuple[str, bool]], label: str, ordered: dict[str, list[str]], depth: int = 3) -> str:
    """RR5–RR8 as CTEs over one compressed row per feature vector (``cid``):
    ``enc`` (dummy-coded values in long form), one node assignment per level,
    ``leaf`` (cid, predicted_risk) and ``imp`` (rule rows of the importances)."""
    names = [f for f, _ in features]
    numeric = [f for f, is_str in features if not is_str]
    strings = [f for f, is_str in features if is_str]
    enc, cats = [], []
    for k, f in enumerate(numeric):
        enc.append(f"SELECT cid, {k * 1000} AS f, '{f}' AS fname, coalesce({f}::DOUBLE, 0.0::DOUBLE) AS v FROM comp")
    for k, f in enumerate(strings, len(numeric)):
        if f in ordered:
            values = ", ".join(f"('{c}', {r})" for r, c in enumerate(ordered[f]))
            cats.append(f"cat_{f}(c, r) AS (VALUES {values})")
        else:
            cats.append(f"cat_{f} AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS r FROM (SELECT DISTINCT {f} AS c FROM comp WHERE {f} IS NOT NULL))")
        enc.append(
            f"SELECT cid, {k * 1000} + r AS f, '{f}_' || c AS fname, coalesce(({f} = c)::INTEGER, 0)::DOUBLE AS v FROM comp, cat_{f} WHERE r > 0"
        )

    def gini(p: str, n: str) -> str:
        return f"CASE WHEN {p} + {n} > 0 THEN 1.0::DOUBLE - ({p} / ({p} + {n})) * ({p} / ({p} + {n})) - ({n} / ({p} + {n})) * ({n} / ({p} + {n})) ELSE 0.0::DOUBLE END"

    levels = ["at0 AS (SELECT cid, 1 AS node FROM comp)"]
    for d in range(depth):
        levels.append(f"""
tot{d} AS (
  SELECT node, sum(n) AS nt, sum(pos) AS post, any_value(w1) AS w1, any_value(w0) AS w0, any_value(min_leaf) AS min_leaf
  FROM at{d} JOIN comp USING (cid), params GROUP BY node
),
open{d} AS (
  SELECT *, post * w1 AS wpt, (nt - post) * w0 AS wnt FROM tot{d}
  WHERE node >= {2**d} AND nt >= 2 AND nt >= 2 * min_leaf AND {gini('(post * w1)', '((nt - post) * w0)')} > 2.220446049250313e-16
),
val{d} AS (
  SELECT node, f, any_value(fname) AS fname, v, sum(n) AS n, sum(pos) AS pos
  FROM at{d} JOIN comp USING (cid) JOIN enc USING (cid) WHERE node IN (SELECT node FROM open{d}) GROUP BY node, f, v
),
cut{d} AS (
  SELECT node, f, fname, v, lead(v) OVER w AS v_next, sum(n) OVER w AS nl, sum(pos) OVER w AS posl
  FROM val{d} WINDOW w AS (PARTITION BY node, f ORDER BY v)
),
side{d} AS (
  SELECT cut{d}.*, nt, post, wpt, wnt, posl * w1 AS wpl, (nl - posl) * w0 AS wnl,
         (post - posl) * w1 AS wpr, ((nt - nl) - (post - posl)) * w0 AS wnr
  FROM cut{d} JOIN open{d} USING (node) WHERE v_next IS NOT NULL AND nl >= min_leaf AND nt - nl >= min_leaf
),
best{d} AS (
  SELECT *, CASE WHEN v / 2.0::DOUBLE + v_next / 2.0::DOUBLE = v_next THEN v ELSE v / 2.0::DOUBLE + v_next / 2.0::DOUBLE END AS thr,
    (wpt + wnt) * ({gini('wpt', 'wnt')}) - (wpl + wnl) * ({gini('wpl', 'wnl')}) - (wpr + wnr) * ({gini('wpr', 'wnr')}) AS decrease
  FROM side{d}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY
    round({gini('wpt', 'wnt')} - ((wpl + wnl) / (wpt + wnt)) * ({gini('wpl', 'wnl')}) - ((wpr + wnr) / (wpt + wnt)) * ({gini('wpr', 'wnr')}), 12) DESC, f, v) = 1
),
at{d + 1} AS (
  SELECT a.cid, CASE WHEN b.node IS NULL THEN a.node WHEN e.v <= b.thr THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
  FROM at{d} a LEFT JOIN best{d} b ON b.node = a.node LEFT JOIN enc e ON e.cid = a.cid AND e.f = b.f
)""")
    splits = " UNION ALL ".join(f"SELECT f, fname, decrease FROM best{d}" for d in range(depth))
    return f"""
src AS MATERIALIZED ({src_sql}),
comp AS MATERIALIZED (
  SELECT row_number() OVER () AS cid, * FROM (
    SELECT {', '.join(names)}, count(*) AS n, coalesce(sum({label}::INTEGER), 0)::BIGINT AS pos FROM src GROUP BY ALL)
),
params AS (
  SELECT N / (2.0::DOUBLE * P) AS w1, N / (2.0::DOUBLE * (N - P)) AS w0, greatest(10, floor(0.05::DOUBLE * N)) AS min_leaf
  FROM (SELECT sum(n)::DOUBLE AS N, sum(pos)::DOUBLE AS P FROM comp)
),
{', '.join(cats) + ',' if cats else ''}
enc AS MATERIALIZED ({' UNION ALL '.join(enc)}),
{', '.join(levels)},
leaf AS (
  SELECT cid, wp / (wp + wn) AS predicted_risk FROM at{depth}
  JOIN (SELECT node, sum(pos) * any_value(w1) AS wp, (sum(n) - sum(pos)) * any_value(w0) AS wn
        FROM at{depth} JOIN comp USING (cid), params GROUP BY node) USING (node)
),
imp AS (
  SELECT 'tree_feature=' || fname || ' & importance=' || printf('%.2f', v) AS rule, v AS confidence,
         0.0::DOUBLE AS support, 0::BIGINT AS n_matches, 'tree' AS kind
  FROM (SELECT f, any_value(fname) AS fname, sum(decrease) / (SELECT sum(decrease) FROM ({splits})) AS v
        FROM ({splits}) GROUP BY f ORDER BY v DESC, f LIMIT 5)
  WHERE v > 0.05
)"""


def same(features: list[tuple[str, bool]], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{f} IS NOT DISTINCT FROM {b}.{f}" for f, _ in features)
