"""Registry of the queries exposed through ``__spark_entry__``.

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the
bindings in ``relmine.sources.tables`` and returns a lazy DataFrame. The
matching DuckDB statement in ``ORACLE`` re-states the same result in SQL; a
query without an entry there is checked on row counts only (and against a
brute-force fixture in ``tests/``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.operators import consistency as SC
from relmine.operators import drift as DR
from relmine.operators import evaluation as EV
from relmine.operators import faithfulness as FG
from relmine.operators import features as QF
from relmine.operators import rules as RR
from relmine.operators import tfidf as TX
from relmine.plans import sqltext as Q
from relmine.sources import tables as S

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

FG_COLS = [*FG.METRICS, "faithfulness_score", "predicted_faithful"]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ------------------------------------------------------------ faithfulness

_FG_CONV_SQL = Q.faithfulness(Q.CONVERSATION_PAIRS, ["conv_id", "turn"])
_FG_DOC_SQL = Q.faithfulness(Q.DOCUMENT_PAIRS, ["doc_id"], ["is_faithful"])


@register("faithfulness_conversations", f"SELECT * FROM ({_FG_CONV_SQL})")
def faithfulness_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """FG1–FG7: each assistant turn against the turn before it."""
    return FG.faithfulness(S.conversation_pairs(spark, sf)).select("conv_id", "turn", *FG_COLS)


@register("faithfulness_documents", f"SELECT * FROM ({_FG_DOC_SQL})")
def faithfulness_documents(spark: SparkSession, sf: str) -> DataFrame:
    """FG1–FG7 on long texts: document d+1 against document d, with quality labels."""
    return S.document_pairs(spark, sf, FG.faithfulness, FG.read).select("doc_id", "is_faithful", *FG_COLS)


@register(
    "faithfulness_accuracy",
    f"""SELECT avg((predicted_faithful = is_faithful)::DOUBLE) AS accuracy, count(*) AS n_labelled
        FROM ({_FG_DOC_SQL}) WHERE is_faithful IS NOT NULL""",
)
def faithfulness_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """FG8: detection accuracy against the document quality labels."""
    return FG.detection_accuracy(faithfulness_documents(spark, sf))


@register(
    "faithfulness_unfaithful",
    f"SELECT conv_id, turn, faithfulness_score FROM ({_FG_CONV_SQL}) WHERE faithfulness_score < 0.5",
)
def faithfulness_unfaithful(spark: SparkSession, sf: str) -> DataFrame:
    """FG9: rows scoring strictly below 0.5, lowest first."""
    return FG.unfaithful(faithfulness_conversations(spark, sf)).select("conv_id", "turn", "faithfulness_score")


@register(
    "faithfulness_summary",
    f"""SELECT count(*) AS total, sum((faithfulness_score >= 0.5)::BIGINT)::BIGINT AS faithful,
          (count(*) - sum((faithfulness_score >= 0.5)::BIGINT))::BIGINT AS unfaithful,
          sum((faithfulness_score >= 0.5)::BIGINT)::DOUBLE / count(*) AS faithful_share,
          avg(faithfulness_score) AS mean_score
        FROM ({_FG_CONV_SQL})""",
)
def faithfulness_summary(spark: SparkSession, sf: str) -> DataFrame:
    """FG10: faithful/unfaithful split and mean score."""
    return FG.summary(faithfulness_conversations(spark, sf))


# ------------------------------------------------------------------- drift

_DR_EV_SQL = Q.drift_events()
DR_COLS = [
    "user_id", "event_id", "trust_score", "is_hallucination", "sentence_idx",
    "detected_drift_point", "actual_drift_point", "post_drift", "prediction_correct",
]


@register("drift_events", f"SELECT * FROM ({_DR_EV_SQL})")
def drift_events(spark: SparkSession, sf: str) -> DataFrame:
    """DR1+DR2: drift point of every user's score sequence and per-event labels."""
    seqs = S.event_sequences(spark, sf)
    return DR.label_sequences(seqs, ["user_id"], ["ts", "event_id"]).select(*DR_COLS)


@register("drift_accuracy", f"SELECT avg(prediction_correct::DOUBLE) AS accuracy FROM ({_DR_EV_SQL})")
def drift_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """DR3: sentence-level accuracy of the post-drift flag."""
    return DR.sentence_accuracy(drift_events(spark, sf))


@register(
    "drift_summary",
    f"""SELECT count(DISTINCT user_id) AS responses,
          count(DISTINCT user_id) FILTER (WHERE detected_drift_point IS NOT NULL) AS responses_with_drift,
          avg(prediction_correct::DOUBLE) AS sentence_accuracy
        FROM ({_DR_EV_SQL})""",
)
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    """DR7: responses, responses with a drift point, accuracy."""
    return DR.drift_summary(drift_events(spark, sf), ["user_id"])


# ---------------------------------------------------------- prompt features

LF_COLS = [
    "has_numeric_claim", "has_named_entity", "asks_about_person_raw", "asks_for_list_raw",
    "asks_specific_count", "query_length", "response_length",
]


@register("prompt_features_documents", f"SELECT * FROM ({Q.prompt_features(Q.DOCUMENT_QUERIES, ['doc_id'])})")
def prompt_features_documents(spark: SparkSession, sf: str) -> DataFrame:
    """QF1–QF15 with every document text as a prompt."""
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    return QF.extract(docs).drop("query")


@register(
    "prompt_features_conversations", f"SELECT * FROM ({Q.prompt_features(Q.CONVERSATION_QUERIES, ['prompt_id'])})"
)
def prompt_features_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """QF1–QF15 on the opening turn of every conversation."""
    return QF.extract(S.conversation_prompts(spark, sf)).drop("query", "is_hallucination")


@register("label_features_conversations", f"SELECT * FROM ({Q.label_features(Q.CONVERSATION_QR, ['conv_id', 'turn'])})")
def label_features_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """LF1–LF5: query = the turn before, response = the assistant turn."""
    pairs = S.conversation_pairs(spark, sf).withColumnRenamed("context", "query")
    return QF.label_features(pairs).select("conv_id", "turn", *LF_COLS)


# --------------------------------------------------------- self-consistency

_SC_SQL = Q.consistency(Q.CONVERSATION_PROMPTS, Q.CONVERSATION_SAMPLES)
_SC_OUT = f"SELECT prompt_id, is_hallucination, {', '.join(Q.SC_METRICS)} FROM ({_SC_SQL})"


def _consistency(spark: SparkSession, sf: str) -> DataFrame:
    return SC.analyze(S.conversation_prompts(spark, sf), S.conversation_samples(spark, sf))


@register("consistency_conversations", _SC_OUT)
def consistency_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """SC1–SC7: assistant turns as sampled answers to the conversation's opening prompt."""
    return _consistency(spark, sf).select("prompt_id", "is_hallucination", *SC.METRICS)


_SC_DOC_SQL = Q.consistency(
    "SELECT DISTINCT doc_id // 5 AS prompt_id FROM documents",
    "SELECT doc_id // 5 AS prompt_id, doc_id AS sample_idx, text AS response FROM documents",
)


# numbers up to 1e15 leave the last digits of their spread to the order of
# summation: both sides keep the 24 bits that do not depend on it
@register(
    "consistency_documents",
    f"SELECT prompt_id, {', '.join(Q.SC_METRICS)} FROM (SELECT * REPLACE (numeric_variance::FLOAT::DOUBLE AS numeric_variance) FROM ({_SC_DOC_SQL}))",
)
def consistency_documents(spark: SparkSession, sf: str) -> DataFrame:
    """SC1–SC7 with long samples (numbers present, vocabulary cap active):
    five consecutive documents are the samples of a prompt."""
    docs = S.table(spark, sf, "documents").withColumn("prompt_id", F.floor(F.col("doc_id") / 5).cast("long"))
    prompts = docs.select("prompt_id").distinct()
    samples = docs.select("prompt_id", F.col("doc_id").alias("sample_idx"), F.col("text").alias("response"))
    spread = F.col("numeric_variance").cast("float").cast("double")
    return SC.analyze(prompts, samples).withColumn("numeric_variance", spread).select("prompt_id", *SC.METRICS)


@register(
    "consistency_discrimination",
    f"""SELECT avg(composite_consistency) FILTER (WHERE is_hallucination) AS hallucinated_mean,
          stddev_samp(composite_consistency) FILTER (WHERE is_hallucination) AS hallucinated_std,
          avg(composite_consistency) FILTER (WHERE NOT is_hallucination) AS reliable_mean,
          stddev_samp(composite_consistency) FILTER (WHERE NOT is_hallucination) AS reliable_std,
          avg(composite_consistency) FILTER (WHERE NOT is_hallucination)
            - avg(composite_consistency) FILTER (WHERE is_hallucination) AS gap
        FROM ({_SC_OUT})
        HAVING count(*) FILTER (WHERE is_hallucination) > 0 AND count(*) FILTER (WHERE NOT is_hallucination) > 0""",
)
def consistency_discrimination(spark: SparkSession, sf: str) -> DataFrame:
    """SC8: composite mean / sample std per label and the gap."""
    return SC.discrimination(consistency_conversations(spark, sf))


@register(
    "consistency_unreliable",
    f"SELECT prompt_id, composite_consistency FROM ({_SC_OUT}) WHERE composite_consistency < 0.6",
)
def consistency_unreliable(spark: SparkSession, sf: str) -> DataFrame:
    """SC9: prompts with composite below 0.6, lowest first."""
    return SC.unreliable(consistency_conversations(spark, sf)).select("prompt_id", "composite_consistency")


@register(
    "consistency_bands",
    f"""SELECT count(*) AS total,
          count(*) FILTER (WHERE composite_consistency >= 0.8) AS high,
          count(*) FILTER (WHERE composite_consistency >= 0.5 AND composite_consistency < 0.8) AS medium,
          count(*) FILTER (WHERE composite_consistency < 0.5) AS low,
          (count(*) FILTER (WHERE composite_consistency >= 0.8))::DOUBLE / count(*) AS high_share,
          (count(*) FILTER (WHERE composite_consistency >= 0.5 AND composite_consistency < 0.8))::DOUBLE / count(*) AS medium_share,
          (count(*) FILTER (WHERE composite_consistency < 0.5))::DOUBLE / count(*) AS low_share
        FROM ({_SC_OUT})""",
)
def consistency_bands(spark: SparkSession, sf: str) -> DataFrame:
    """SC10: high / medium / low consistency bands."""
    return SC.bands(consistency_conversations(spark, sf))


_TX_SQL = Q.tfidf_weights("SELECT doc_id // 5 AS gid, doc_id AS doc, text FROM documents")


def _grouped_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents")
    return docs.select(F.floor(F.col("doc_id") / 5).cast("long").alias("group_id"), "doc_id", "text")


@register("tfidf_weights", f"SELECT gid AS group_id, doc AS doc_id, term, rank, weight FROM ({_TX_SQL})")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """TX7: TF-IDF vectors of documents in groups of five."""
    return TX.tfidf_weights(_grouped_documents(spark, sf), "group_id", "doc_id", "text")


@register(
    "document_cosines",
    f"""WITH w AS ({_TX_SQL}),
        p AS (SELECT a.doc_id // 5 AS group_id, a.doc_id AS doc_a, b.doc_id AS doc_b
              FROM documents a JOIN documents b ON a.doc_id // 5 = b.doc_id // 5 AND a.doc_id < b.doc_id)
        SELECT p.group_id, p.doc_a, p.doc_b, coalesce(sum(a.weight * b.weight), 0.0::DOUBLE) AS cosine
        FROM p LEFT JOIN w a ON a.gid = p.group_id AND a.doc = p.doc_a
          LEFT JOIN w b ON b.gid = p.group_id AND b.doc = p.doc_b AND b.term = a.term
        GROUP BY ALL""",
)
def document_cosines(spark: SparkSession, sf: str) -> DataFrame:
    """TX8: cosine of the two documents of every pair in a group of five."""
    docs = _grouped_documents(spark, sf)
    ids = docs.select("group_id", "doc_id")
    pairs = ids.withColumnRenamed("doc_id", "doc_a").join(ids.withColumnRenamed("doc_id", "doc_b"), "group_id").filter("doc_a < doc_b")
    weights = TX.tfidf_weights(docs, "group_id", "doc_id", "text")
    return TX.cosines(weights, pairs, "group_id", "doc_id", "doc_a", "doc_b")


# -------------------------------------------------------------- trust maps


@register("trust_map_reference", f"SELECT * FROM ({Q.trust_map(Q.DOCUMENT_RESPONSES_REF)})")
def trust_map_reference(spark: SparkSession, sf: str) -> DataFrame:
    """DR4+DR6: every document's sentences scored against its benchmark reference."""
    return DR.trust_map(S.document_responses(spark, sf))


@register("trust_map_internal", f"SELECT * FROM ({Q.trust_map(Q.DOCUMENT_RESPONSES_NOREF)})")
def trust_map_internal(spark: SparkSession, sf: str) -> DataFrame:
    """DR5+DR6: every document's sentences scored by coherence with the earlier ones."""
    docs = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("response_id"), F.col("text").alias("response"), F.lit(None).cast("string").alias("reference")
    )
    return DR.trust_map(docs)


# -------------------------------------------------------------- risk rules

LINEITEM_MIN_CONFIDENCE = 0.33  # the returned-line rate is ~1/3 in every slice
_LI_FEATS = [(f, f in ("l_linestatus", "quantity_bin", "discount_bin")) for f in S.LINEITEM_FEATURES]
_RR_LI_SQL = Q.mined_rules(Q.LINEITEM_RISK, _LI_FEATS, "is_returned", RR.MIN_SUPPORT, LINEITEM_MIN_CONFIDENCE)
_DOC_RISK_SQL = f"""
SELECT f.*, (l.quality = 1) AS is_risky
FROM ({Q.prompt_features(Q.DOCUMENT_QUERIES, ['doc_id'])}) f JOIN labels l ON l.doc_id = f.doc_id"""
_RR_DOC_FEATS = [(f, f in ("question_type", "specificity_bin", "length_bin")) for f in RR.FEATURE_COLUMNS]
_RR_DOC_SQL = Q.mined_rules(_DOC_RISK_SQL, _RR_DOC_FEATS, "is_risky", RR.MIN_SUPPORT, RR.MIN_CONFIDENCE)


def _lineitem_comp(spark: SparkSession, sf: str) -> DataFrame:
    return RR.compress(S.lineitem_risk(spark, sf), S.LINEITEM_FEATURES, "is_returned")


def _document_risk(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    labels = S.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_risky"))
    return QF.extract(docs.join(labels, "doc_id"))


@register("risk_rules_lineitem", f"SELECT * FROM ({_RR_LI_SQL})")
def risk_rules_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """RR0–RR3: single and pair rules for returned line items."""
    return RR.mined_rules(_lineitem_comp(spark, sf), S.LINEITEM_FEATURES, RR.MIN_SUPPORT, LINEITEM_MIN_CONFIDENCE)


@register("risk_rules_documents", f"SELECT * FROM ({_RR_DOC_SQL})")
def risk_rules_documents(spark: SparkSession, sf: str) -> DataFrame:
    """RR0–RR3 with the reference's eleven prompt features over labelled documents."""
    comp = RR.compress(_document_risk(spark, sf), RR.FEATURE_COLUMNS, "is_risky")
    return RR.mined_rules(comp, RR.FEATURE_COLUMNS)


@register(
    "risk_rules_top",
    f"SELECT * FROM ({_RR_LI_SQL}) ORDER BY confidence DESC, support DESC, rule LIMIT {RR.SUMMARY_TOP}",
)
def risk_rules_top(spark: SparkSession, sf: str) -> DataFrame:
    """RR4: the eight highest-confidence rules (a top-k report)."""
    return RR.rank(risk_rules_lineitem(spark, sf), RR.SUMMARY_TOP)


@register(
    "risk_rule_stats",
    f"SELECT count(*) AS n_rules, max(confidence) AS best_confidence FROM ({_RR_LI_SQL})",
)
def risk_rule_stats(spark: SparkSession, sf: str) -> DataFrame:
    """RR9: number of mined rules and the best confidence."""
    return RR.rule_stats(risk_rules_lineitem(spark, sf))


_LI_TREE = Q.tree(Q.LINEITEM_RISK, _LI_FEATS, "is_returned", S.LINEITEM_ORDERED)


@register("risk_tree_rules", f"WITH {_LI_TREE} SELECT * FROM ({_RR_LI_SQL}) UNION ALL SELECT * FROM imp")
def risk_tree_rules(spark: SparkSession, sf: str) -> DataFrame:
    """RR5–RR7: all rules of the fit — mined rules plus the tree's importance rows."""
    rules, _ = RR.fit(
        S.lineitem_risk(spark, sf), S.LINEITEM_FEATURES, "is_returned",
        min_confidence=LINEITEM_MIN_CONFIDENCE, ordered=S.LINEITEM_ORDERED,
    )
    return rules


@register(
    "risk_scores",
    f"""WITH {_LI_TREE} SELECT l_orderkey, l_linenumber, predicted_risk
        FROM src JOIN comp ON {Q.same(_LI_FEATS, 'src', 'comp')} JOIN leaf USING (cid)""",
)
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """RR8: tree probability of a return for every line item."""
    rows = S.lineitem_risk(spark, sf)
    tree = RR.fit_tree(_lineitem_comp(spark, sf), S.LINEITEM_FEATURES, ordered=S.LINEITEM_ORDERED)
    return RR.score(rows, tree).select("l_orderkey", "l_linenumber", "predicted_risk")


# --------------------------------------------------------------- evaluation


@register("eval_consistency_histogram", Q.histogram(_SC_OUT, "composite_consistency", ["is_hallucination"], 25))
def eval_consistency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """EV1: composite consistency by label, 25 bins over each label's range."""
    return EV.consistency_histogram(consistency_conversations(spark, sf))


_FG_DOC_LONG = f"""
SELECT is_faithful, m.metric, m.v FROM (
  SELECT is_faithful, unnest([{{'metric': 'entity_coverage', 'v': entity_coverage}},
                              {{'metric': 'numeric_fidelity', 'v': numeric_fidelity}},
                              {{'metric': 'semantic_similarity', 'v': semantic_similarity}}]) AS m
  FROM ({_FG_DOC_SQL}) WHERE is_faithful IS NOT NULL)"""


@register("eval_faithfulness_histograms", Q.histogram(_FG_DOC_LONG, "v", ["metric", "is_faithful"], 15))
def eval_faithfulness_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """EV2: coverage / fidelity / similarity by label, 15 bins each."""
    return EV.faithfulness_histograms(faithfulness_documents(spark, sf))


_DOC_PROMPTS_SQL = f"""
SELECT f.*, (l.quality = 0) AS is_hallucination
FROM ({Q.prompt_features(Q.DOCUMENT_QUERIES, ['doc_id'])}) f JOIN labels l ON l.doc_id = f.doc_id"""


def _document_prompt_features(spark: SparkSession, sf: str) -> DataFrame:
    return QF.extract(S.document_prompts(spark, sf)).withColumnRenamed("prompt_id", "doc_id").drop("query")


@register(
    "eval_rate_by_feature",
    f"""WITH long AS (
          SELECT is_hallucination AS y, unnest([
            {{'feature': 'demands_numeric', 'value': demands_numeric::VARCHAR}},
            {{'feature': 'has_temporal_ref', 'value': has_temporal_ref::VARCHAR}},
            {{'feature': 'asks_about_person', 'value': asks_about_person::VARCHAR}},
            {{'feature': 'asks_for_list', 'value': asks_for_list::VARCHAR}}]) AS f
          FROM ({_DOC_PROMPTS_SQL})),
        g AS (SELECT f.feature AS feature, f.value AS value, count(*) FILTER (WHERE y) AS nt, count(*) FILTER (WHERE NOT y) AS nf
              FROM long WHERE f.value IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
        SELECT feature, value, nt::DOUBLE / (nt + nf) AS rate, (nt + nf) AS n FROM g
        WHERE feature IN (SELECT feature FROM g GROUP BY feature HAVING sum(nt) > 0 AND sum(nf) > 0)""",
)
def eval_rate_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    """EV3: label rate per value of the four risk features (documents as prompts, quality labels)."""
    return EV.rate_by_feature(_document_prompt_features(spark, sf))


@register(
    "eval_feature_pivot",
    f"""WITH long AS (
          SELECT is_hallucination AS y, unnest([
            {{'feature': 'demands_numeric', 'value': demands_numeric::VARCHAR}},
            {{'feature': 'has_temporal_ref', 'value': has_temporal_ref::VARCHAR}},
            {{'feature': 'asks_about_person', 'value': asks_about_person::VARCHAR}},
            {{'feature': 'asks_for_list', 'value': asks_for_list::VARCHAR}}]) AS f
          FROM ({_DOC_PROMPTS_SQL})),
        flat AS (SELECT f.feature AS feature, f.value AS value, y FROM long WHERE f.value IS NOT NULL AND y IS NOT NULL)
        SELECT feature, value, "false" AS n_false, "true" AS n_true
        FROM (PIVOT flat ON y IN (false, true) USING count(*) GROUP BY feature, value)""",
)
def eval_feature_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """EV3, wide: rows per feature value by label."""
    return EV.feature_pivot(_document_prompt_features(spark, sf))


_SWEEP_SQL = Q.threshold_sweep(_SC_OUT, "composite_consistency", "is_hallucination")


@register("eval_threshold_sweep", _SWEEP_SQL)
def eval_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """EV4: confusion counts, TPR, FPR at 50 thresholds of the composite score."""
    return EV.threshold_sweep(consistency_conversations(spark, sf))


@register(
    "eval_auc",
    f"""SELECT abs(sum(d * tpr)) AS auc FROM (
          SELECT tpr, lead(fpr) OVER (ORDER BY k) - fpr AS d FROM ({_SWEEP_SQL}))""",
)
def eval_auc(spark: SparkSession, sf: str) -> DataFrame:
    """EV5: AUC approximation of the sweep."""
    return EV.auc(eval_threshold_sweep(spark, sf))


@register(
    "eval_trajectories",
    f"""SELECT user_id, sentence_idx, trust_score, is_hallucination, detected_drift_point FROM ({_DR_EV_SQL})
        WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 4)""",
)
def eval_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """EV6: trust trajectories of the first four sequences (a top-k report)."""
    few = EV.trajectories(S.event_sequences(spark, sf), "user_id")
    labelled = DR.label_sequences(few, ["user_id"], ["ts", "event_id"])
    return labelled.select("user_id", "sentence_idx", "trust_score", "is_hallucination", "detected_drift_point")


@register(
    "eval_base_rate",
    f"SELECT avg(is_hallucination::DOUBLE) AS base_rate, count(*) AS rows FROM ({_DOC_PROMPTS_SQL})",
)
def eval_base_rate(spark: SparkSession, sf: str) -> DataFrame:
    """EV7: label base rate and row count."""
    return EV.base_rate(_document_prompt_features(spark, sf))


@register(
    "eval_consistency_gap",
    f"""SELECT avg(composite_consistency) FILTER (WHERE NOT is_hallucination)
          - avg(composite_consistency) FILTER (WHERE is_hallucination) AS consistency_gap FROM ({_SC_OUT})""",
)
def eval_consistency_gap(spark: SparkSession, sf: str) -> DataFrame:
    """EV8: reliable minus hallucinated mean composite."""
    return EV.consistency_gap(consistency_conversations(spark, sf))


# ------------------------------------------------------------- run summary


_PA_FEATS = [(f, f in ("question_type", "specificity_bin", "length_bin")) for f in RR.FEATURE_COLUMNS]
_PA_PROMPTS = f"""
SELECT f.*, p.is_hallucination FROM ({Q.prompt_features(Q.CONVERSATION_PROMPTS, ['prompt_id'])}) f
JOIN ({Q.CONVERSATION_PROMPTS}) p USING (prompt_id)"""
_PA_TREE = Q.tree(_PA_PROMPTS, _PA_FEATS, "is_hallucination", RR.ORDERED_CATEGORIES)
_PA_RULES = Q.mined_rules(_PA_PROMPTS, _PA_FEATS, "is_hallucination", RR.MIN_SUPPORT, RR.MIN_CONFIDENCE)


def _one(sql: str, section: str, metrics: dict[str, str]) -> str:
    """One-row SQL as ``(section, metric, value)`` rows."""
    return "\nUNION ALL\n".join(f"SELECT '{section}' AS section, '{m}' AS metric, ({x})::DOUBLE AS value FROM ({sql})" for m, x in metrics.items())


_PA_BANDS = f"""
SELECT avg((composite_consistency >= 0.8)::INTEGER) AS x, count(*)::DOUBLE AS total,
  count(*) FILTER (WHERE composite_consistency >= 0.8) AS high,
  count(*) FILTER (WHERE composite_consistency >= 0.5 AND composite_consistency < 0.8) AS medium,
  count(*) FILTER (WHERE composite_consistency < 0.5) AS low,
  avg(composite_consistency) FILTER (WHERE NOT is_hallucination) - avg(composite_consistency) FILTER (WHERE is_hallucination) AS gap
FROM ({_SC_OUT})"""
_PA_FG = f"""
SELECT count(*) AS total, count(*) FILTER (WHERE faithfulness_score >= 0.5) AS faithful,
  count(*) FILTER (WHERE NOT coalesce(faithfulness_score >= 0.5, false)) AS unfaithful, avg(faithfulness_score) AS mean_score,
  count(*) FILTER (WHERE is_faithful IS NOT NULL) AS n_labelled,
  avg((predicted_faithful = is_faithful)::INTEGER) FILTER (WHERE is_faithful IS NOT NULL) AS accuracy
FROM ({_FG_DOC_SQL})"""
_PA_SUMMARY = "\nUNION ALL\n".join(
    [
        _one(f"SELECT count(*) AS q, avg(is_hallucination::INTEGER) AS r FROM ({Q.CONVERSATION_PROMPTS})", "dataset", {"queries": "q", "hallucination_rate": "r"}),
        _one(
            _PA_BANDS,
            "consistency",
            {"high": "high", "medium": "medium", "low": "low", "high_share": "high / total", "medium_share": "medium / total", "low_share": "low / total"},
        ),
        _one(_PA_BANDS, "consistency_gap", {"consistency_gap": "gap"}),
        _one(f"SELECT count(*) AS n, max(confidence) AS c FROM (SELECT * FROM ({_PA_RULES}) UNION ALL SELECT * FROM imp)", "rules", {"n_rules": "n", "best_confidence": "c"}),
        _one(
            _PA_FG,
            "faithfulness",
            {"total": "total", "faithful": "faithful", "unfaithful": "unfaithful", "faithful_share": "faithful::DOUBLE / total", "mean_score": "mean_score"},
        ),
        _one(_PA_FG, "faithfulness_accuracy", {"accuracy": "accuracy", "n_labelled": "n_labelled"}),
        _one(
            f"""SELECT count(DISTINCT user_id) AS responses, count(DISTINCT user_id) FILTER (WHERE detected_drift_point IS NOT NULL) AS w,
                  avg(prediction_correct::INTEGER) AS a FROM ({_DR_EV_SQL})""",
            "drift",
            {"responses": "responses", "responses_with_drift": "w", "sentence_accuracy": "a"},
        ),
    ]
)


@register("run_summary", f"WITH {_PA_TREE} {_PA_SUMMARY}")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """EV9 / PL1: the full analysis reduced to its report values."""
    from relmine.plans.analysis import full_analysis

    return full_analysis(spark, sf)["summary"]


@register(
    "analysis_queries",
    f"""WITH {_PA_TREE}
        SELECT src.*, {', '.join('sc.' + c for c in Q.SC_METRICS)}, predicted_risk
        FROM src JOIN comp ON {Q.same(_PA_FEATS, 'src', 'comp')} JOIN leaf USING (cid) JOIN ({_SC_OUT}) sc USING (prompt_id)""",
)
def analysis_queries(spark: SparkSession, sf: str) -> DataFrame:
    """PL1: the analysed prompt table — features, consistency metrics and the
    tree's predicted risk per conversation prompt (prompt text omitted)."""
    from relmine.plans.analysis import full_analysis

    return full_analysis(spark, sf)["query_analysis"].drop("query")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The query behind ``entry()``: faithfulness of every assistant turn."""
    return faithfulness_conversations(spark, sf)


__all__ = ["QUERIES", "ORACLE", "flagship"]
