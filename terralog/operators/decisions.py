"""Rule-based decisions over all entity, crop and month combinations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of risks and severities, thresholds of the index, and the labels that decide.
RANK = {"moderate": 1, "severe": 2}
SEVERE, MODERATE = -1.5, -1.0
DECISIVE, CORROBORATING, NO_SKILL = "validated", "weak/directional", "no skill"
NONE, INSUFFICIENT = "none dominant", "insufficient data"


def _rank(c: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col(c)], F.lit(0))


def drought_signal(forecasts: DataFrame) -> DataFrame:
    """``forecasts``: ``entity_id, horizon, predicted, label``. Adds nothing to a missing forecast but its reason.

    ``drought_available``: there is a prediction. ``drought_severity``: by the index, null for none. Only a validated
    horizon is decisive, a weak one corroborates, and one without skill is reported but not usable.
    """
    here = F.col("predicted").isNotNull() & F.col("label").isNotNull()
    flag = lambda c: here & F.coalesce(c, F.lit(False))
    sev = F.when(F.col("predicted") < SEVERE, "severe").when(F.col("predicted") < MODERATE, "moderate")
    return forecasts.select(
        "entity_id", "horizon", here.alias("drought_available"), F.when(here, sev).alias("drought_severity"), flag(F.col("label") == DECISIVE).alias("decisive"), flag(F.col("label") == CORROBORATING).alias("corroborating"),
        flag(F.startswith("label", F.lit(NO_SKILL))).alias("no_skill"), F.when(~here, "no forecast").alias("drought_reason"),
    )


def heat_signal(counts: DataFrame, days: int = 3, moderate: float = 3.0, severe: float = 4.0) -> DataFrame:
    """``heat_severity`` (null for none) by heat days or by mean departure, whichever is higher, and ``heat_basis``."""
    by_days = F.when((F.col("heat_days") >= days) & (F.col("severe_days") > 0), "severe").when(F.col("heat_days") >= days, "moderate")
    by_dep = F.when(F.col("mean_departure") >= severe, "severe").when(F.col("mean_departure") >= moderate, "moderate")
    both = counts.withColumns({"by_days": by_days, "by_departure": by_dep})
    higher = _rank("by_departure") > _rank("by_days")
    basis = F.when(higher, "departure").when(F.col("by_days").isNotNull(), "days")
    return both.select("entity_id", "month", F.lit(True).alias("heat_available"), F.when(higher, F.col("by_departure")).otherwise(F.col("by_days")).alias("heat_severity"), basis.alias("heat_basis"))


def dominant(rows: DataFrame) -> DataFrame:
    """Adds ``dominant, severity, confidence, reason``. First rule that holds: out of season; no usable signal; both, the
    higher one or heat; drought; heat; none.

    ``rows``: ``in_season`` and the columns of both signals; those of a missing signal are null.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = F.when(is_("drought_available") & is_("decisive"), _rank("drought_severity")).otherwise(0)
    h = F.when(is_("heat_available"), _rank("heat_severity")).otherwise(0)
    usable = (is_("drought_available") & ~is_("no_skill")) | is_("heat_available")
    name = F.when(~F.col("in_season"), NONE).when(~usable, INSUFFICIENT).when(d > h, "drought").when(h > 0, "heat").otherwise(NONE)
    both = F.when(d > h, "both, drought is higher").when(d == h, "both are equal, the observed one counts").otherwise("both, heat is higher")
    unusable = F.when(is_("no_skill"), "the forecast has no skill, and heat was not observed").otherwise("no forecast, and heat was not observed")
    why = F.when(~F.col("in_season"), "outside the sensitive months").when(~usable, unusable).when((d > 0) & (h > 0), both).when(d > 0, "drought alone").when(h > 0, "heat alone").otherwise("no risk reaches the threshold")
    sure = F.when(~F.col("in_season"), "not applicable").when(~usable, INSUFFICIENT).when(F.col("dominant") == "drought", DECISIVE).when(F.col("dominant") == "heat", "observed, not a forecast").otherwise("no risk reaches the threshold")
    severity = F.when(F.col("dominant") == "drought", F.col("drought_severity")).when(F.col("dominant") == "heat", F.col("heat_severity"))
    return rows.withColumn("dominant", name).withColumns({"severity": severity, "confidence": sure, "reason": why})


def yield_impact(rows: DataFrame, table: DataFrame, gaps: DataFrame) -> DataFrame:
    """The first entry of the crop and risk, of the severity or of any, decides by its band; else why there is no figure.

    ``rows``: ``row_id, crop, risk, severity, metric``; ``table``: ``entry, crop, risk, severity, lo, hi, impact`` (a null
    severity stands for all, null bounds are open); ``gaps``: ``crop, risk``. Both are reference tables of some hundreds
    of rows; an entry is chosen from the crop's and risk's own list, in order of ``entry``.
    """
    listed = table.groupBy("crop", "risk").agg(F.array_sort(F.collect_list(F.struct("entry", "severity", "lo", "hi", "impact"))).alias("entries"))
    j = rows.join(listed, ["crop", "risk"], "left").join(gaps.select("crop", "risk").distinct().withColumn("gap", F.lit(True)), ["crop", "risk"], "left")
    e = F.get(F.filter("entries", lambda e: e["severity"].isNull() | (e["severity"] == F.col("severity"))), F.lit(0))
    j, e, m = j.withColumn("e", e), F.col("e"), F.col("metric")
    unbound = F.col("risk").isNull() | F.col("risk").isin(NONE, INSUFFICIENT) | F.col("severity").isNull()
    entry = F.when(m.isNull(), "not available: not measured").when(m < e["lo"], "not available: below the band").when(m > e["hi"], "not available: above the band").otherwise("available")
    rest = F.when(F.col("entries").isNotNull(), "not available: other severity only").when(F.col("gap"), "recorded gap").otherwise("out of scope")
    status = F.when(unbound, "not available: no binding risk").when(e.isNotNull(), entry).otherwise(rest)
    return j.withColumn("status", status).select("row_id", "crop", "risk", "severity", "metric", "status", F.when(F.col("status") == "available", e["impact"]).alias("impact"))


def target_month(anchors: DataFrame, crops: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``anchors``: ``entity_id, anchor``; ``crops``: ``crop, sensitive_months``, a small table; ``given``: ``entity_id, crop, month``.

    The month that is given for entity and crop; else the first of the next three months in season; else the latest
    sensitive month up to the anchor. ``horizon`` is its distance in months.
    """
    j = anchors.crossJoin(crops)
    if given is not None:
        j = j.join(given.select("entity_id", "crop", F.trunc("month", "MM").alias("given")), ["entity_id", "crop"], "left")
    steps = lambda lo, hi, sign: F.filter(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.add_months("anchor", sign * k)), lambda m: F.array_contains("sensitive_months", F.month(m)))
    found = [F.get(steps(1, 3, 1), F.lit(0)), F.get(steps(0, 11, -1), F.lit(0))]
    out = j.withColumn("target", F.coalesce(*([F.col("given")] if given is not None else []), *found))
    return out.select("entity_id", "crop", "anchor", "target", ((F.year("target") - F.year("anchor")) * 12 + F.month("target") - F.month("anchor")).alias("horizon"))


#: Months ahead that a forecast reaches.
REACH = 3


def assessed(targets: DataFrame, scope: DataFrame, drought: DataFrame, heat: DataFrame, crops: DataFrame) -> DataFrame:
    """The assessment of every entity and crop at its target month: which signals apply, the dominant risk, the reason.

    ``targets``: of ``target_month``; ``scope``: ``crop, entity_id`` of the combinations that are assessed; ``drought``:
    of ``drought_signal``, by horizon 1 to ``REACH``; ``heat``: of ``heat_signal``, by month. A forecast applies to a month
    ahead within reach, an observation to its own month.
    """
    t = targets.join(scope.select("crop", "entity_id").distinct().withColumn("in_scope", F.lit(True)), ["crop", "entity_id"], "left")
    t = t.join(drought, ["entity_id", "horizon"], "left").join(heat.withColumnRenamed("month", "target"), ["entity_id", "target"], "left")
    t = t.join(crops.select("crop", "sensitive_months"), "crop").withColumn("in_season", F.array_contains("sensitive_months", F.month("target")))
    past = F.when(F.col("horizon") <= 0, "the month is past, so no forecast applies").when(F.col("horizon") > REACH, "the month is beyond the forecast's reach")
    out = dominant(t)
    decline = ~F.coalesce("in_scope", F.lit(False))
    choose = lambda no, yes: F.when(decline, no).otherwise(F.col(yes))
    return out.select(
        "entity_id", "crop", "target", "horizon", choose(F.lit(INSUFFICIENT), "dominant").alias("dominant"), choose(F.lit(None).cast("string"), "severity").alias("severity"),
        choose(F.lit("not applicable: crop out of scope for the entity"), "confidence").alias("confidence"), choose(F.lit("crop not assessed for the entity"), "reason").alias("reason"), F.when(~decline, F.coalesce("drought_reason", past)).alias("drought_reason"),
    )


def with_impact(assessments: DataFrame, measured: DataFrame, table: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds ``metric, impact_status, impact`` to ``assessed``: the dominant risk's figure from the reference tables.

    ``measured``: ``entity_id, target, risk, metric``, what was measured or forecast of each risk in a month.
    """
    m = measured.withColumnRenamed("risk", "dominant")
    a = assessments.join(m, ["entity_id", "target", "dominant"], "left")
    rows = a.select(F.struct("entity_id", "crop").alias("row_id"), "crop", F.col("dominant").alias("risk"), "severity", "metric")
    found = yield_impact(rows, table, gaps).select("row_id.*", F.col("status").alias("impact_status"), "impact")
    return a.join(found, ["entity_id", "crop"])


def missing(*parts: tuple[DataFrame, Column, str]) -> DataFrame:
    """``entity_id, what, reason`` of everything that is not available, from several tables."""
    out = None
    for df, unavailable, what in parts:
        part = df.where(unavailable).select("entity_id", F.lit(what).alias("what"), F.col("reason"))
        out = part if out is None else out.unionByName(part)
    return out
