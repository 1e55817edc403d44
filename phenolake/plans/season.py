"""The season batch: harmonise -> curves -> norms -> z -> episodes -> context -> cause."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolake.operators import context as X
from phenolake.operators import drivers as D
from phenolake.operators import season as S
from phenolake.sources.io import cut_lineage


class SeasonPlan:
    """Lazy stages over one season panel (pid, date, day, year, doy, s1..s3, value, source, ...)."""

    def __init__(self, panel: DataFrame, categories: DataFrame, strict: bool = True, as_of=None, parts: int | None = None):
        """``parts``: tasks that entities are dealt to (none: the session's)."""
        self.panel, self.categories, self.strict, self.as_of, self.parts = panel, categories, strict, as_of, parts

    def by_entity(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.parts, "pid") if self.parts else df.repartition("pid")

    @cached_property
    def series(self) -> DataFrame:
        return S.harmonize(self.by_entity(S.split_unknown(self.panel)[0]))

    @cached_property
    def curves(self) -> DataFrame:
        """Dealt by entity while they are points: all windows by entity that follow need no other exchange. Worked out again by each reader, as a
        season's points are a small part of its days."""
        return S.daily_curve(self.by_entity(self.saved_series.select("pid", "year", "day", "h", "artifact")), self.as_of)

    @cached_property
    def saved_curves(self) -> DataFrame:
        return cut_lineage(self.curves)

    @cached_property
    def saved_category_norm(self) -> DataFrame:
        """Written, so that the join below knows its real size: broadcast while small, shuffled when not."""
        return cut_lineage(S.category_norm(self.curves, self.categories))

    @cached_property
    def normed(self) -> DataFrame:
        return S.choose_norm(S.curve_norm(self.curves), self.saved_category_norm, self.categories)

    @cached_property
    def z(self) -> DataFrame:
        return S.z_series(self.normed)

    @cached_property
    def saved_z(self) -> DataFrame:
        """Daily z of all entities: the barrier before episodes, phenology and regional context. Written are the columns that others follow from, and
        each day's island, while the season's rows are together."""
        d = S.with_islands(self.z).select("pid", "year", "day", "doy", "value", "norm_mean", "norm_std", "norm_source", S.sure().alias("sure"), "island")
        return S.with_z(cut_lineage(d), F.col("sure"))

    @cached_property
    def saved_series(self) -> DataFrame:
        return cut_lineage(self.series)

    @cached_property
    def phenology(self) -> DataFrame:
        """Phenology of each season beside its deviation from the norm's. Both curves are one shuffle of the days: a day becomes its two values after it,
        and what is left, two rows a season, is written."""
        z, keys = self.saved_z, ["pid", "year"]
        d = z.select(*keys, "doy", F.when(F.col("sure"), F.col("value")).alias("own"), F.col("norm_mean").alias("norm")).repartition(*keys)
        curve = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("own", "norm")])
        facts = cut_lineage(S.phenology(d.select(*keys, "doy", F.inline(curve)), ok=F.col("value").isNotNull(), keys=(*keys, "kind")))
        own, norm = (facts.filter(F.col("kind") == kind).drop("kind") for kind in ("own", "norm"))
        return S.phenology_deviation(own, norm)

    @property
    def episodes(self) -> DataFrame:
        """Episodes alone: where nothing else reads z, it isn't written."""
        return S.find_episodes(self.z, self.saved_series, self.strict)

    @cached_property
    def saved_episodes(self) -> DataFrame:
        """Episodes of the saved z: the one path that the batch and every query of it take."""
        return cut_lineage(S.find_episodes(self.saved_z, self.saved_series, self.strict))

    @cached_property
    def seasons(self) -> DataFrame:
        return X.season_table(self.saved_series, self.saved_z, self.phenology)

    def driver_facts(self, grid: DataFrame, cols=("precip", "temp")) -> DataFrame:
        """Driver facts of an episode's windows. An entity reads the series of its category; one without a series, or without a category, reads the median of
        all series (``region`` is then ``REGION_KEY``), which is laid on the calendar once and never copied to entities."""
        kinds = self.categories.withColumnRenamed("category", "region")
        mapping, series = D.with_fallback(kinds.filter("region IS NOT NULL"), grid, D.regional_grid(grid, cols), "region", cols)
        ep = self.saved_episodes.join(kinds, "pid", "left").join(mapping, "region", "left").select(
            F.coalesce("driver_key", F.lit(D.REGION_KEY)).alias("region"), "pid", "year", F.col("start").alias("ep"), "start", "end")
        d = D.episode_drivers(ep, cut_lineage(D.with_calendar(series.withColumnRenamed("driver_key", "region"))), "region", ["pid", "year", "ep"])
        return d.withColumn("driver_source", F.when(F.col("region") == D.REGION_KEY, "region").otherwise("own"))

    def facts(self, grid: DataFrame) -> DataFrame:
        """All facts of an episode in one row: the input of the cause rules."""
        ep = X.region_context(self.saved_episodes, self.saved_z)
        ep = ep.join(self.phenology.drop("covered_days", "base", "amplitude", "integral", "peak_doy", "sos_doy", "half_decline_doy"),
                     ["pid", "year"], "left")
        ep = ep.join(X.index_anomaly(self.saved_episodes, self.saved_series), X.EPISODE_KEY, "left")
        of = lambda win, c: F.max(F.when(F.col("win") == win, F.col(c)))
        drivers = self.driver_facts(grid).groupBy("pid", "year", F.col("ep").alias("start")).agg(F.max("driver_source").alias("driver_source"), *[
            of("combined", c).alias(f"c_{c}") for c in ("n_days", "amount", "amount_norm", "deficit_pct", "level", "level_anomaly", "hot_days", "max_dry_spell")], *[
            of(win, c).alias(f"{win[0]}_{c}") for win in ("before", "during") for c in ("amount", "amount_norm", "deficit_pct")])
        return ep.join(drivers, X.EPISODE_KEY, "left")

    def run(self, grid: DataFrame) -> DataFrame:
        """The whole batch: episodes with context, severity, cause, confidence, arguments and text."""
        d = X.classify(self.facts(grid))
        d = d.withColumn("severity", X.severity(F.col("min_z"), F.col("critical_days")))
        return d.withColumn("text", X.describe())
