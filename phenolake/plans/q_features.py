"""Queries: the feature matrix of hidden rows and the models that are trained on it."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from phenolake.functions import constants as C
from phenolake.functions import expr as E
from phenolake.operators import drivers as D
from phenolake.operators import frames
from phenolake.operators import gapfill as G
from phenolake.operators import model as M
from phenolake.operators import pairs
from phenolake.operators.features import biases, masked, merged, raw_neighbors
from phenolake.plans.ctes import cte
from phenolake.plans.q_aggregate import PAIRS
from phenolake.plans.q_gap import AN, CL, CY, DE, FITS, SP, analogs, donors
from phenolake.plans.q_join import KNN, SAME, knn_sql, same_source
from phenolake.plans.q_scan import folds
from phenolake.plans.q_window import FB, composite_windows, filled
from phenolake.plans.registry import BODIES, query
from phenolake.sources.io import cut_lineage, shared_dir

# ---------------------------------------------------------------- raw sources
for _i in (1, 2, 3):
    cte(f"raw{_i}", knn_sql(f"raw_s{_i}", 2, [f"s{_i}"], f"k.s{_i} IS NOT NULL"))
RAW = [f"raw_s{i}_{s}{k}_{c}" for i in (1, 2, 3) for s in "pn" for k in (1, 2) for c in ("days", "value")]


def _raw_sql():
    cols = []
    for i in (1, 2, 3):
        cols += [f"r{i}.raw_s{i}_{s}{k}_days, r{i}.raw_s{i}_{s}{k}_s{i} AS raw_s{i}_{s}{k}_value" for s in "pn" for k in (1, 2)]
        vp, vn, dp, dn = (f"raw_s{i}_{c}" for c in (f"p1_s{i}", f"n1_s{i}", "p1_days", "n1_days"))
        cols.append(f"coalesce({vp} + ({vn} - {vp}) * {dp} / ({dp} + {dn}), {vp}, {vn}) AS raw_s{i}_interp")
    return f"SELECT r1.pid, r1.date, {', '.join(cols)} FROM {{raw1}} r1 JOIN {{raw2}} r2 ON r2.pid = r1.pid AND r2.day = r1.day JOIN {{raw3}} r3 ON r3.pid = r1.pid AND r3.day = r1.day"


@query("raw_source_neighbors", "pid:i date:d " + " ".join(f"{c}:{'i' if c.endswith('days') else 'f9'}" for c in RAW) + " " + " ".join(f"raw_s{i}_interp:f6" for i in (1, 2, 3)), _raw_sql())
def _(t):
    return raw_neighbors(t.marked, parts=t.parts).join(t.targets.select("pid", "day", "date"), ["pid", "day"])


# ---------------------------------------------------------------- the matrix
BIAS = [f"pb_{k}" for k in PAIRS] + [f"pb_res_s{s}" for s in (1, 2, 3)]
DEW = [f"dew_s{s}_{c}" for s in (1, 2, 3) for c in ("effect", "wsum", "lowest", "low_share")]
DRIVERS = ["precip", "temp", "amount_7", "level_7"]
kinds = lambda spec: dict(x.split(":") for x in spec.split())
#: columns of the matrix and their kinds, block by block
BASE = ({"guess": "i", "n15": "i", "n30": "i", "n60": "i", "res5": "i", "res8": "i", "n_ctx": "i", "n_years": "i", "mean_h": "f6"}
        | {c: k for c, k in kinds(KNN).items() if c not in ("pid", "date")}
        | {f"{c}_{x}": k for c in SAME for x, k in (("days", "i"), ("value", "f9"))} | {f"s{i}_{x}": k for i in (1, 2, 3) for x, k in (("interp", "f6"), ("n30", "i"))}
        | {f"{n}_{x}": k for n in FB for x, k in (("mean", "f6"), ("n", "i"), ("max", "f6"))} | kinds(CL) | dict.fromkeys(CY, "i")
        | {f"{n}{x}": k for n in FITS for x, k in (("", "f4"), ("_slope", "f4"), ("_weight", "f6"))} | {"sl_minus_md": "f4"}
        | {f"{c}{x}": k for c in BIAS for x, k in (("", "f4"), ("_n", "i"), ("_y", "f4"), ("_y_n", "i"))}
        | {f"de_s{s}_{o}{x}": k for s, o in DE for x, k in (("", "f4"), ("_n", "i"))} | {f"xp_s{s}_{x}": k for s in (1, 2, 3) for x, k in (("n", "i"), ("share", "f6"))} | {"active": "i"}
        | {c: "f4" for c in DEW} | dict.fromkeys(DRIVERS, "f6") | {f"hyp_s{s}": "f4" for s in (1, 2, 3)})
SPATIAL = ({c: "i" if c.endswith("days") else "f9" for c in RAW} | {f"raw_s{i}_interp": "f6" for i in (1, 2, 3)}
           | {f"{c}{x}": k for c in (*SP, *AN) for x, k in (("", "f5"), ("_w", "f6"))})


def own_blocks(m, cycles: bool = True):
    """What the entity's own stream tells, in narrow pieces of hidden rows: a window's sort carries the columns of its piece alone, not those of all
    pieces before it, and rows that only feed windows are left behind in each. ``cycles``: also the cycle features."""
    h, out = G.with_h(G.guess_source(m)).withColumns({"res5": G.residue(5), "res8": G.residue(8)}), []
    h = h.withColumns({f"n{w}": frames.count_in_window(G.known(), w, ["pid"]) for w in (15, 30, 60)})
    for d in (composite_windows(h, ["pid"], G.known() & (F.col("source") != 2), F.col("h")), G.climatology_features(m), *([G.cycle_features(m)] if cycles else []),
              same_source(m, every=True), frames.k_neighbors(G.with_h(m), ["pid"], G.gap(), G.known(), C.N_NEIGHBORS, C.MAX_NEIGHBOR_DAYS, ["value", "source", "h"])):
        out.append(d.filter(G.gap()).select("pid", "day", *[c for c in BASE if c in d.columns]))
    return out


def weights_block(res, targets):
    """Weighted day effects of the three sources side by side."""
    part = F.col("mask").cast("long").alias("part")
    asked = targets.select("pid", part, F.explode(F.array(*[(F.col("day") * 4 + s).cast("long") for s in range(3)])).alias("key"))
    known = res.select("pid", part, (F.col("day") * 4 + F.col("source")).cast("long").alias("key"), F.col("res").alias("v"))
    d = pairs.weighted_day_effects(known, asked).withColumns({"day": F.expr("CAST(floor(key / 4) AS INT)"), "source": F.pmod("key", F.lit(4))})
    return d.groupBy("pid", "day").agg(*[F.max(F.when(F.col("source") == s - 1, F.col(c))).alias(f"dew_s{s}_{c}") for s in (1, 2, 3) for c in ("effect", "wsum", "lowest", "low_share")])


def build_features(t, m=None, spatial: bool = True, cycles: bool = True):
    """One row a hidden row of the marked panel ``m`` (with ``entity`` and ``mask`` if it holds several masks), with every block's columns. ``spatial``: also
    raw sources, donors and analogues; ``cycles``: also the cycle features, which the models don't read."""
    m = t.marked if m is None else m
    m = m if "mask" in m.columns else m.withColumns({"mask": F.lit(0), "entity": F.col("pid")})
    m = cut_lineage(m)
    known, targets, p = m.filter(G.known()), m.filter(G.gap()), t.by_entity(m)
    res = cut_lineage(G.loo_residuals(t.by_entity(known)))
    windows = D.driver_windows(filled(t), ["region"], "precip", "temp").select(F.col("region").alias("category"), "day", *DRIVERS)
    driven = targets.select("pid", "day", "entity").join(t.categories.withColumnRenamed("pid", "entity"), "entity").join(windows, ["category", "day"], "left")
    effects = G.day_effects(targets.select("pid", "day", "year", "mask"), G.day_tables(res, ["mask"]), ["mask"])
    # what the known rows tell of an entity and its years: while its rows are narrow, so that no known row is carried beside the blocks of the hidden ones
    d = merged([m.select("pid", "day", "entity", "mask", "date", "year", "doy", "value", "source", "is_gap", *[F.when(G.known(), F.col(c)).alias(c) for c in C.SOURCES]),
                res.select("pid", "day", "res", "h")])
    values = {f"pb_{k}": F.col(a) - F.col(b) for k, (a, b) in PAIRS.items()} | {f"pb_res_s{s}": F.when(F.col("source") == s - 1, F.col("res")) for s in (1, 2, 3)}
    whole = E.over_entity()
    d = d.withColumns(biases(values) | {"n_ctx": F.count(F.when(G.known(), 1)).over(whole), "mean_h": F.avg("h").over(whole),
                                        "n_years": F.size(F.collect_set(F.when(G.known(), F.col("year"))).over(whole))})
    blocks = [d.filter(G.gap()).drop("res", "h", "is_gap", *C.SOURCES), *own_blocks(p, cycles), G.curve_features(p), effects.drop("year", "mask"),
              weights_block(res, targets), driven.select("pid", "day", *DRIVERS)]
    if spatial:
        blocks += [raw_neighbors(m, parts=t.parts), donors(known, targets), analogs(known, targets)]
    return G.source_hypotheses(merged(blocks))


def _matrix_sql():
    """Every block's own SQL beside the hidden rows."""
    joins = {n: f"LEFT JOIN ({BODIES[n]}) {n} ON {n}.pid = t.pid AND {n}.{k} = t.{k}" for n, k in (
        ("guess_source", "date"), ("k_neighbors", "date"), ("same_source_neighbors", "day"), ("count_in_window", "date"), ("window_stats_fwd_bwd", "date"),
        ("climatology_features", "date"), ("cycle_features", "date"), ("curve_features", "day"), ("day_effects", "date"), ("driver_features", "date"),
        ("raw_source_neighbors", "date"), ("donor_transfer", "day"), ("donor_analog", "day"))}
    cols = [c for c in (*BASE, *SPATIAL) if not c.startswith(("pb_", "dew_", "hyp_")) and c not in ("res5", "res8", "n_ctx", "n_years", "mean_h")]
    bias = {f"pb_{k}": f"{a} - {b}" for k, (a, b) in PAIRS.items()} | {f"pb_res_s{s}": f"CASE WHEN source = {s - 1} THEN res END" for s in (1, 2, 3)}
    both = "(SELECT k.*, g.res FROM {known} k JOIN {gres} g ON g.pid = k.pid AND g.day = k.day)"
    of = lambda y: ", ".join(f"avg({v}) AS {n}{y}, count({v}) AS {n}{y}_n" for n, v in bias.items())
    dew = ", ".join(f"max({c}) FILTER (key % 4 = {s - 1} OR key % 4 = {s - 5}) AS dew_s{s}_{c}" for s in (1, 2, 3) for c in ("effect", "wsum", "lowest", "low_share"))
    own = [f"{n}{x}" for n in bias for x in ("", "_n")]
    per = [f"{n}_y{x}" for n in bias for x in ("", "_n")]
    hyp = {1: "sl_6", 2: "sl_6", 3: "coalesce(fwd_mean, sl_15)"}
    return ("SELECT *, " + ", ".join(f"{e} + {C.SOURCE_OFFSET[s - 1]}e0 + coalesce(pb_res_s{s}, 0) AS hyp_s{s}" for s, e in hyp.items()) +
            " FROM (SELECT t.pid, t.date, " + ", ".join(cols) + ", ((t.day % 5) + 5) % 5 AS res5, ((t.day % 8) + 8) % 8 AS res8, coalesce(n_ctx, 0) AS n_ctx, coalesce(n_years, 0) AS n_years, mean_h, " +
            ", ".join(f"coalesce({c}, 0) AS {c}" if c.endswith("_n") else c for c in (*own, *per)) + ", " + ", ".join(DEW) +
            " FROM {targets} t " + " ".join(joins.values()) +
            f" LEFT JOIN (SELECT pid, count(*) AS n_ctx, count(DISTINCT year) AS n_years, avg(h) AS mean_h FROM {{known_h}} GROUP BY pid) c ON c.pid = t.pid"
            f" LEFT JOIN (SELECT pid, {of('')} FROM {both} GROUP BY pid) pa ON pa.pid = t.pid"
            f" LEFT JOIN (SELECT pid, year, {of('_y')} FROM {both} GROUP BY pid, year) py ON py.pid = t.pid AND py.year = t.year"
            f" LEFT JOIN (SELECT pid, CAST(floor(key / 4.0) AS INT) AS day, {dew} FROM ({BODIES['weighted_day_effects']}) GROUP BY ALL) w ON w.pid = t.pid AND w.day = t.day)")


@query("build_features", "pid:i date:d " + " ".join(f"{c}:{k}" for c, k in (BASE | SPATIAL).items()), _matrix_sql())
def _(t):
    return build_features(t)


@query("source_hypotheses", "pid:i date:d hyp_s1:f4 hyp_s2:f4 hyp_s3:f4", f"SELECT pid, date, hyp_s1, hyp_s2, hyp_s3 FROM ({_matrix_sql()})")
def _(t):
    return build_features(t, spatial=False)


# ---------------------------------------------------------------- training
SEEDS = ("train1", "train2")
FEATURES = [c for c in BASE if not c.startswith("cy_")]


def training_examples(t, seeds=SEEDS):
    """Known rows hidden again by several masks at once; the outer hidden rows never enter."""
    return build_features(t, masked(t.known, seeds), spatial=False, cycles=False)


def _train_sql(k, seed):
    w = "OVER (PARTITION BY pid ORDER BY day RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)"
    return f"""SELECT {k} AS mask, * FROM (SELECT *, count(*) FILTER (NOT g) {w} AS n30, avg(CASE WHEN NOT g AND source <> 2 THEN value - CASE source WHEN 0 THEN 0.0e0 ELSE 0.037e0 END END) OVER (
PARTITION BY pid ORDER BY day RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS fwd_mean FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', pid, date))) <= round(count(*) OVER () * 0.15) AS g
FROM {{known}})) WHERE g"""


@query("training_examples", "mask:i n:i entities:i mean_truth:f6 n30:i fwd_mean:f6", "SELECT mask, count(*) AS n, count(DISTINCT pid) AS entities, avg(value) AS mean_truth, sum(n30) AS n30, avg(fwd_mean) AS fwd_mean FROM (" +
       " UNION ALL ".join(_train_sql(k, s) for k, s in enumerate(SEEDS)) + ") GROUP BY mask")
def _(t):
    return training_examples(t).groupBy("mask").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.avg("value").alias("mean_truth"),
                                                    F.sum("n30").alias("n30"), F.avg("fwd_mean").alias("fwd_mean"))


_SAVED: dict[tuple[str, str], str] = {}  # folder of the fitted models of a session and data folder


class Fitted:
    """Models of one data folder, fitted once and saved below the shared folder: the regressor, its error scale, and the source's forest.

    Groups of (entity, year) in inner fold 0 are kept from the regressor; its error on them teaches the scale."""

    def __init__(self, t):
        self.t, at = t, (t.spark.sparkContext.applicationId, t.path)
        try:
            self.load(_SAVED[at])
        except (KeyError, AnalysisException):
            _SAVED[at] = self.fit(shared_dir(t.spark))

    def load(self, path: str) -> None:
        read = self.t.spark.read.schema(self.NAMES).json(f"{path}/used").collect()  # three rows
        self.fits = {r["what"]: M.Fit(r["features"], r["at"], r["means"], PipelineModel.load(f"{path}/{r['what']}")) for r in read}

    NAMES = "what string, features array<string>, at array<int>, means array<double>"

    @property
    def used(self) -> dict[str, list[str]]:
        return {what: f.used for what, f in self.fits.items()}

    def fit(self, path: str) -> str:
        # written, so that the join knows its real size: broadcast while small, shuffled when not
        groups = cut_lineage(folds(self.t.panel.select(F.concat_ws("_", "pid", "year").alias("grp")), "grp", 10, "inner"))
        ex = M.packed(training_examples(self.t), FEATURES, ["entity", "year", "value", "source"]).withColumn("grp", F.concat_ws("_", "entity", "year"))
        ex = cut_lineage(ex.join(groups, "grp").select("value", "source", "fold", "x"))
        fit, kept = ex.filter("fold > 0"), ex.filter("fold = 0")
        self.fits = {"value": M.fit_gap_model(fit, FEATURES, "value")}
        inner = M.score_gaps(self.fits["value"], kept).withColumnRenamed("pred", "first")
        self.fits["scale"] = M.error_scale(inner, FEATURES, "value", "first")
        self.fits["source"] = M.fit_source_model(ex, FEATURES, "source")
        for what, f in self.fits.items():
            f.model.write().overwrite().save(f"{path}/{what}")
        self.t.spark.createDataFrame([(what, f.used, f.at, f.means) for what, f in self.fits.items()], self.NAMES).write.json(f"{path}/used")
        return path

    def scored(self):
        """Hidden rows with prediction, error scale and source probabilities; written once beside the models, by the first that reads them."""
        path = f"{_SAVED[self.t.spark.sparkContext.applicationId, self.t.path]}/scored"
        try:
            return self.t.spark.read.parquet(path)
        except AnalysisException:
            self.score().select("pid", "date", "value", "pred", "scale", "probs").write.parquet(path)
            return self.t.spark.read.parquet(path)

    def score(self):
        d = cut_lineage(M.packed(build_features(self.t, spatial=False, cycles=False), FEATURES, ["pid", "date", "value"]))
        d = M.with_scale(self.fits["scale"], M.score_gaps(self.fits["value"], d))
        return M.with_probabilities(self.fits["source"], d)


@query("score_gaps", "pid:i date:d pred:f4 scale:f4")
def _(t):
    return Fitted(t).scored()


@query("gap_source_probabilities", "pid:i date:d p1:f4 p2:f4 p3:f4")
def _(t):
    return Fitted(t).scored().select("pid", "date", *[F.col("probs")[i].alias(f"p{i + 1}") for i in range(3)])


@query("model_report", "feature:s importance:f4")
def _(t):
    return t.spark.createDataFrame(M.feature_importances(Fitted(t).fits["value"]), "feature string, importance double")


@query("source_probabilities", "fold:i source:i n:i p1:f4 p2:f4 p3:f4")
def _(t):
    """Out of fold, by groups of (entity, year): what the first stage hands to training rows."""
    groups = folds(t.panel.select(F.concat_ws("_", "pid", "year").alias("grp")), "grp", 3, "prob")
    d = G.guess_source(t.marked, loo=True).filter(G.known()).withColumn("grp", F.concat_ws("_", "pid", "year")).join(groups, "grp").withColumn("label", F.col("source").cast("double"))
    features = ["doy", "n_s1", "n_s2", "guess", "year"]
    d = cut_lineage(M.packed(d, features, ["fold", "source", "label"]))  # every fold's fit reads it several times
    p = M.source_probabilities(d, features, "label", "fold", 3)
    return p.groupBy("fold", "source").agg(F.count("*").alias("n"), *[F.avg(F.col("probs")[i]).alias(f"p{i + 1}") for i in range(3)])
