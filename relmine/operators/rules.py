"""Risk rules.

Every rule count depends only on (feature vector, label) counts, so the big
table is scanned once into a compressed table (RR0: one partially aggregated
``groupBy`` over the feature columns, a few thousand rows at most for
low-cardinality features) that is checkpointed; rules, tree levels and the
importance table all run on it.

The shallow tree (RR6) is grown level by level as aggregations over the
compressed table: for every open node and encoded feature, class-weighted
counts per distinct value, cumulative sums give every threshold's
children, the best gini decrease wins. Counts stay whole numbers up to that
point and gains are rounded before they are compared, so equal gains tie on
every run and the first feature wins. Only the chosen splits (at most
2^depth - 1) and leaf probabilities are brought to the driver — they are
the model, which is then applied as one nested ``CASE`` expression (RR8).
Unlike ``pyspark.ml``'s tree, sibling leaves with the same class are kept,
so leaf probabilities and importances follow the reference's library.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relmine.session import cut_lineage
from relmine.sources.schemas import require

# Fixed values of the reference (risk_profiler config and tree settings).
MIN_SUPPORT = 0.05
MIN_CONFIDENCE = 0.5
PAIR_MIN_COUNT = 5
SINGLE_MAX_DISTINCT = 5
PAIR_MAX_DISTINCT = 3
MAX_DEPTH = 3
MIN_LEAF_FLOOR = 10
MIN_LEAF_FRACTION = 0.05
TOP_IMPORTANCES = 5
MIN_IMPORTANCE = 0.05
SUMMARY_TOP = 8
EPSILON = 2.220446049250313e-16  # machine epsilon for doubles
GAIN_DIGITS = 12  # gains are compared to so many decimals (not a fixed value of the reference)
MAX_CATEGORIES = 1000  # a string feature with more values is no category (likewise)
FEATURE_COLUMNS = [
    "demands_numeric", "has_temporal_ref", "demands_specificity", "asks_about_person", "asks_for_list",
    "domain_academic", "domain_finance", "domain_medical", "question_type", "specificity_bin", "length_bin",
]
ORDERED_CATEGORIES = {
    "length_bin": ["short", "medium", "long"],
    "specificity_bin": ["low", "medium", "high"],
}


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def compress(df: DataFrame, features: list[str], label: str, checkpoint: bool = True) -> DataFrame:
    """RR0: ``features + [n, pos]`` — one row per distinct feature vector."""
    require(df, [*features, label], "risk rules")
    c = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    return cut_lineage(c) if checkpoint else c


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _render(df: DataFrame, c: str) -> Column:
    """A value as rule text; booleans as ``True`` and ``False``."""
    text = F.col(c).cast("string")
    return F.initcap(text) if isinstance(df.schema[c].dataType, T.BooleanType) else text


def mined_rules(
    comp: DataFrame,
    features: list[str],
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """RR1–RR3: single-item and pair rules: ``rule, confidence, support, n_matches, kind``.

    One aggregation over grouping sets of the typed columns (each feature, and
    each pair of numeric ones); ``grouping_id`` names a row's set."""
    total = comp.select(F.sum("n")).scalar()
    strings = {f for f in features if _is_string(comp, f)}
    pairs = list(combinations([f for f in features if _is_number(comp, f)], 2))
    sets = [(f,) for f in features] + pairs
    # one bit per feature, set where the feature is not grouped by
    at = {s: sum(1 << (len(features) - 1 - i) for i, f in enumerate(features) if f not in s) for s in sets}
    counts = comp.groupingSets([list(s) for s in sets], *features).agg(
        F.grouping_id().alias("_set"), F.sum("n").alias("cnt"), F.sum("pos").alias("npos")
    )

    def case(of, among=sets):
        """By grouping set, what ``of`` says of its features."""
        out = F.when(F.lit(False), of(among[0]))
        for s in among:
            out = out.when(F.col("_set") == at[s], of(s))
        return out

    known = case(lambda s: reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in s)))
    counts = counts.filter(known)
    # a row per feature: bounded by their number
    singles = [(f,) for f in features]
    distinct = counts.filter(F.col("_set").isin(*[at[s] for s in singles])).groupBy("_set").agg(F.count(F.lit(1)).alias("values"))
    n_values = {r["_set"]: r["values"] for r in distinct.collect()}

    def eligible(s):
        most = SINGLE_MAX_DISTINCT if len(s) == 1 else PAIR_MAX_DISTINCT
        return F.lit(s[0] in strings or all(n_values.get(at[(f,)], 0) <= most for f in s))

    def text(s):
        return F.concat(*[x for i, f in enumerate(s) for x in (F.lit(f"{' & ' * bool(i)}{f}="), _render(comp, f))])

    least = F.when(case(lambda s: F.lit(len(s) == 2)), F.greatest(total * F.lit(min_support), F.lit(float(PAIR_MIN_COUNT))))
    return counts.filter(
        case(eligible) & (F.col("cnt") >= least.otherwise(total * F.lit(min_support))) & (F.col("npos") / F.col("cnt") >= min_confidence)
    ).select(
        case(text).alias("rule"),
        (F.col("npos") / F.col("cnt")).alias("confidence"),
        (F.col("cnt") / total).alias("support"),
        F.col("cnt").alias("n_matches"),
        case(lambda s: F.lit("single" if len(s) == 1 else "pair")).alias("kind"),
    )


def rank(rules: DataFrame, top: int | None = None) -> DataFrame:
    """RR4: confidence descending; ties by support then rule text."""
    r = rules.orderBy(F.col("confidence").desc(), F.col("support").desc(), F.col("rule").asc())
    return r.limit(top) if top else r


# ------------------------------------------------------------------- tree


@dataclass
class Encoding:
    """RR5: one-hot layout fixed from the training data."""

    numeric: list[str]
    categories: dict[str, list[str]]  # string feature -> kept categories (first dropped)

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{f}_{c}" for f, cats in self.categories.items() for c in cats]

    def columns(self) -> list[Column]:
        cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.numeric]
        for f, cats in self.categories.items():
            cols += [F.coalesce((F.col(f) == c).cast("double"), F.lit(0.0)) for c in cats]
        return cols


def fit_encoding(comp: DataFrame, features: list[str], ordered: dict[str, list[str]] | None = None) -> Encoding:
    """Numeric features pass through; string features become dummies of their
    categories (declared order for binned ones, else alphabetical), first
    category dropped. Category lists come from the compressed table; a string
    feature of more than ``MAX_CATEGORIES`` values is an error, found by
    counting before any list is made."""
    ordered = ORDERED_CATEGORIES if ordered is None else ordered
    numeric = [f for f in features if not _is_string(comp, f)]
    cats: dict[str, list[str]] = {}
    strings = [f for f in features if _is_string(comp, f)]
    if strings:
        counts = comp.select(*[F.count_distinct(f).alias(f) for f in strings]).first()
        free = [f for f in strings if counts[f] > MAX_CATEGORIES]
        if free:
            raise ValueError(f"not categorical (more than {MAX_CATEGORIES} values): {free}")
        found = comp.select(*[F.sort_array(F.collect_set(f)).alias(f) for f in strings]).first()
        for f in strings:
            values = ordered.get(f) or list(found[f] or [])
            cats[f] = values[1:]
    return Encoding(numeric, cats)


@dataclass
class Tree:
    encoding: Encoding
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)  # node -> (feature index, threshold)
    leaves: dict[int, float] = field(default_factory=dict)  # node -> P(class 1)
    importances: list[float] = field(default_factory=list)

    def predict(self) -> Column:
        """RR8: probability of class 1 as a nested CASE over the encoded features."""
        enc = self.encoding.columns()

        def node(i: int) -> Column:
            if i in self.splits:
                f, thr = self.splits[i]
                return F.when(enc[f] <= F.lit(thr), node(2 * i)).otherwise(node(2 * i + 1))
            return F.lit(self.leaves.get(i, 0.5))

        return node(1)


def _gini(wp: Column, wn: Column) -> Column:
    w = wp + wn
    return F.when(w > 0, F.lit(1.0) - (wp / w) * (wp / w) - (wn / w) * (wn / w)).otherwise(F.lit(0.0))


def fit_tree(
    comp: DataFrame,
    features: list[str],
    max_depth: int = MAX_DEPTH,
    ordered: dict[str, list[str]] | None = None,
) -> Tree:
    """RR5+RR6: gini tree with balanced class weights, min leaf
    max(10, floor(0.05 n)); ties between equal gains go to the first feature
    in encoded order, then the lowest threshold."""
    enc = fit_encoding(comp, features, ordered)
    names = enc.names
    values = [F.approx_count_distinct(c).alias(f"v{i}") for i, c in enumerate(enc.columns()[: len(enc.numeric)])]
    stats = comp.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), *values).first()
    most = max((stats[f"v{i}"] for i in range(len(enc.numeric))), default=0)
    ranges = -(-most * len(names) // VALUES_PER_TASK) if most > VALUES_PER_TASK else None
    n_total, n_pos = int(stats["n"]), int(stats["pos"] or 0)
    n_neg = n_total - n_pos
    tree = Tree(enc, importances=[0.0] * len(names))
    if n_total == 0 or not names:
        return tree
    w1 = n_total / (2.0 * n_pos) if n_pos else 0.0
    w0 = n_total / (2.0 * n_neg) if n_neg else 0.0
    min_leaf = max(MIN_LEAF_FLOOR, int(MIN_LEAF_FRACTION * n_total))

    x = comp.select(
        F.array(*enc.columns()).alias("x"),
        "n",
        "pos",
        F.lit(1).alias("node"),
    )
    x = cut_lineage(x)
    node_info: dict[int, tuple[float, float, bool]] = {}
    for depth in range(max_depth + 1):
        node_stats = x.groupBy("node").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        for r in node_stats.collect():  # at most 2^depth rows
            wp, wn = r["pos"] * w1, (r["n"] - r["pos"]) * w0
            w = wp + wn
            imp = 1.0 - (wp / w) ** 2 - (wn / w) ** 2 if w > 0 else 0.0
            can_split = depth < max_depth and r["n"] >= 2 and r["n"] >= 2 * min_leaf and imp > EPSILON
            node_info[r["node"]] = (w, imp, can_split)
            tree.leaves[r["node"]] = wp / w if w > 0 else 0.5
        open_nodes = [k for k, (_, _, ok) in node_info.items() if ok and 2**depth <= k < 2 ** (depth + 1)]
        if not open_nodes:
            break
        best = _best_splits(x.filter(F.col("node").isin(open_nodes)), min_leaf, w1, w0, ranges)
        if not best:
            break
        for b in best:
            nd = b["node"]
            tree.splits[nd] = (b["f"], b["thr"])
            tree.leaves.pop(nd, None)
            w, imp, _ = node_info[nd]
            tree.importances[b["f"]] += w * imp - b["wl"] * b["imp_l"] - b["wr"] * b["imp_r"]
        route = None
        for nd, (f, thr) in tree.splits.items():
            cond = F.col("node") == nd
            nxt = F.when(F.col("x")[f] <= F.lit(thr), F.lit(2 * nd)).otherwise(F.lit(2 * nd + 1))
            route = F.when(cond, nxt) if route is None else route.when(cond, nxt)
        x = cut_lineage(x.withColumn("node", route.otherwise(F.col("node"))))
    total_imp = sum(tree.importances)
    if total_imp > 0:
        tree.importances = [v / total_imp for v in tree.importances]
    return tree


VALUES_PER_TASK = 50_000  # distinct values of a feature that one window takes


def running_counts(g: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (``node, f, v, n, pos``; one per distinct value) with the counts
    up to and including the value (``nl, posl``), those of the node (``nt,
    post``) and the next value (``v_next``).

    With ``ranges``, rows are dealt by ranges of (node, feature, value), cut
    where a sample says they are equal, so that no task holds more than one
    range: sums run inside each range, and what precedes a range is carried
    over from one row per range. The ranges are fixed by a checkpoint.
    """
    key = ["node", "f"] if ranges is None else ["node", "f", "_range"]
    if ranges is not None:
        g = cut_lineage(g.repartitionByRange(ranges, "node", "f", "v").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*key).orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = g.withColumn("nl", F.sum("n").over(upto)).withColumn("posl", F.sum("pos").over(upto)).withColumn("v_next", F.lead("v").over(inside))
    whole = Window.partitionBy("node", "f")
    if ranges is None:
        return out.withColumn("nt", F.sum("n").over(whole)).withColumn("post", F.sum("pos").over(whole))
    sums = g.groupBy(*key).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"), F.min("v").alias("_first"))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *key,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"),
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_posb"),
        F.sum("_n").over(whole).alias("nt"),
        F.sum("_pos").over(whole).alias("post"),
        F.lead("_first").over(whole.orderBy("_range")).alias("_after"),
    )
    # a row per range, node and feature that meet in it
    out = out.join(carried, key).withColumn("nl", F.col("nl") + F.col("_nb")).withColumn("posl", F.col("posl") + F.col("_posb"))
    return out.withColumn("v_next", F.coalesce("v_next", "_after")).drop("_range", "_nb", "_posb", "_after")


def _best_splits(x: DataFrame, min_leaf: int, w1: float, w0: float, ranges: int | None = None) -> list:
    """Best (feature, threshold) per open node, as a small aggregation."""
    long = x.select("node", "n", "pos", F.posexplode("x").alias("f", "v"))
    g = long.groupBy("node", "f", "v").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    g = running_counts(g, ranges).filter(F.col("v_next").isNotNull())

    def weighted(n: Column, pos: Column) -> tuple[Column, Column]:
        return pos * F.lit(w1), (n - pos) * F.lit(w0)

    wpl, wnl = weighted(F.col("nl"), F.col("posl"))
    wpr, wnr = weighted(F.col("nt") - F.col("nl"), F.col("post") - F.col("posl"))
    wpt, wnt = weighted(F.col("nt"), F.col("post"))
    wl, wr, wt = wpl + wnl, wpr + wnr, wpt + wnt
    imp_l, imp_r = _gini(wpl, wnl), _gini(wpr, wnr)
    gain = F.round(_gini(wpt, wnt) - (wl / wt) * imp_l - (wr / wt) * imp_r, GAIN_DIGITS)
    mid = F.col("v") / 2.0 + F.col("v_next") / 2.0
    thr = F.when(mid == F.col("v_next"), F.col("v")).otherwise(mid)
    cand = g.filter((F.col("nl") >= min_leaf) & ((F.col("nt") - F.col("nl")) >= min_leaf)).select(
        "node", "f", thr.alias("thr"), gain.alias("gain"), wl.alias("wl"), wr.alias("wr"), imp_l.alias("imp_l"), imp_r.alias("imp_r")
    )
    # the greatest gain, then the first feature, then the lowest threshold
    order = F.struct(F.col("gain"), (-F.col("f")).alias("f"), (-F.col("thr")).alias("thr"))
    best = cand.groupBy("node").agg(F.max(F.struct(order.alias("o"), "thr", "wl", "wr", "imp_l", "imp_r", "f")).alias("b"))
    return best.select("node", "b.*").drop("o").collect()


def importance_rules(tree: Tree) -> list[tuple[str, float]]:
    """RR7: top features by importance above the floor, as rule rows."""
    ranked = sorted(enumerate(tree.importances), key=lambda t: -t[1])[:TOP_IMPORTANCES]
    names = tree.encoding.names
    return [(f"tree_feature={names[i]} & importance={v:.2f}", v) for i, v in ranked if v > MIN_IMPORTANCE]


def importance_frame(spark, tree: Tree) -> DataFrame:
    rows = [(r, float(v), 0.0, 0, "tree") for r, v in importance_rules(tree)]
    schema = "rule string, confidence double, support double, n_matches bigint, kind string"
    return spark.createDataFrame(rows, schema)


def fit(
    df: DataFrame,
    features: list[str],
    label: str,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_depth: int = MAX_DEPTH,
    ordered: dict[str, list[str]] | None = None,
):
    """RR0–RR7: ``(rules DataFrame, tree)``; rules ranked like RR4."""
    comp = compress(df, features, label)
    mined = mined_rules(comp, features, min_support, min_confidence)
    tree = fit_tree(comp, features, max_depth, ordered)
    rules = mined.unionByName(importance_frame(df.sparkSession, tree))
    return rank(rules), tree


def rule_stats(rules: DataFrame) -> DataFrame:
    """RR9: number of rules and best confidence."""
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("best_confidence"))


def score(df: DataFrame, tree: Tree | None, out: str = "predicted_risk") -> DataFrame:
    """RR8: tree probability per row (0.5 when no tree was fitted)."""
    if tree is None or (not tree.splits and not tree.leaves):
        return df.withColumn(out, F.lit(0.5))
    return df.withColumn(out, tree.predict())


