"""What results say in words: trends, silences, influence, and what a number means.

A sentence never says more than its row; what is missing or weak is said as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.parameters import resolve

# Plain words and modern practice for what is measured most.
GLOSSARY = {
    "bod": ("BOD (biochemical oxygen demand)", "How much oxygen the waste will consume as it rots. High BOD in a river starves fish of oxygen, so it is the single most-watched number in sewage treatment.", "mg/L", 25.0, "modern Ontario effluent is commonly held near 25 mg/L or lower", "the modern 25 mg/L benchmark", "lower is better"),
    "suspended solids": ("suspended solids", "The solid matter still floating in the water. It clouds the river, smothers riverbed habitat, and carries other pollutants with it.", "mg/L", 25.0, "modern Ontario effluent is commonly held near 25 mg/L or lower", "the modern 25 mg/L benchmark", "lower is better"),
    "phosphorus": ("phosphorus", "A nutrient. Too much of it makes algae bloom, which then rots and removes the oxygen -- the main cause of the Great Lakes algae problems of the era.", "mg/L", 1.0, "commonly limited near 1 mg/L", "the modern 1 mg/L benchmark", "lower is better"),
    "chlorine residual": ("chlorine residual", "Chlorine still left in the water after disinfection. Some is needed to kill bacteria; too much is itself toxic to river life.", "mg/L", 0.5, "often kept below ~0.5 mg/L where discharged to a river", "the modern 0.5 mg/L benchmark", "a balance, not a minimum"),
    "flow": ("flow", "How much sewage passed through the plant.", "gal/day", None, "compare against the plant's design capacity, not a fixed number", None, "context, not quality"),
}
CAVEAT = "This compares a historical measurement against a MODERN benchmark. It does not mean the plant broke the rules of its own time -- those rules were different, and often did not exist."
REMOVED = " was removed before discharge. Primary treatment of this era typically removed 30-40%; a modern plant with secondary treatment removes upward of 85%."
ENTRY = "substance string, name string, plain string, units string, modern double, modern_note string, modern_phrase string, direction string"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short(x) -> Column:
    """A number with its needless zeros left out."""
    return F.regexp_replace(F.regexp_replace(F.round(_col(x).cast("double"), 6).cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def signed(x) -> Column:
    """A number to three significant digits, with its sign."""
    v = _col(x).cast("double")
    size = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
    scale = F.pow(F.lit(10.0), (F.lit(2) - size).cast("double"))
    return F.concat(F.when(v < 0, "-").otherwise("+"), short(F.abs(F.round(v * scale) / scale)))


def trend_sentence() -> Column:
    """Of a row of series.trend(): ok, reason, direction, slope, low, high, n, p_value, significant, stability."""
    told = F.concat(
        F.col("direction"), F.lit(" "), signed("slope"), F.lit("/yr (90% CI "), signed("low"), F.lit(" to "), signed("high"), F.lit(", n="), F.col("n").cast("string"), F.lit(", p="), F.format_number("p_value", 3), F.lit(")"),
        F.when(~F.col("significant"), " -- not significant").otherwise(""),
        F.when(F.col("stability") < 0.9, F.concat(F.lit(" -- UNSTABLE: only "), F.round(F.col("stability") * 100).cast("int").cast("string"), F.lit("% of replicates agree on direction once reading confidence is accounted for"))).otherwise(""),
    )
    return F.when(F.col("ok"), told).otherwise(F.concat(F.lit("no trend computed: "), F.col("reason")))


def silence_sentence(place) -> Column:
    """Of a row of series.silence()."""
    share = F.round(F.col("continuity") * 100).cast("int").cast("string")
    return F.concat(
        _col(place), F.lit(": "), F.size("reported").cast("string"), F.lit(" reports "), F.col("first_year").cast("string"), F.lit("-"), F.col("last_year").cast("string"), F.lit(" ("), share, F.lit("% continuity)"),
        F.when(F.col("longest_gap") > 1, F.concat(F.lit(", longest interior gap "), F.col("longest_gap").cast("string"), F.lit(" yr"))).otherwise(""),
        F.when(F.col("silent_since").isNotNull(), F.concat(F.lit(", SILENT since "), F.col("silent_since").cast("string"))).otherwise(""),
    )


def influence_sentence(upstream, downstream, parameter) -> Column:
    """Of a row of network.influence()."""
    up, down, name = _col(upstream), _col(downstream), _col(parameter)
    weak = F.concat(up, F.lit(" -> "), down, F.lit(" ("), name, F.lit("): not reportable — "), F.col("reason"))
    strong = F.concat(
        up, F.lit(" effluent vs "), down, F.lit(" influent ("), name, F.lit(", "), F.col("n").cast("string"), F.lit(" shared years): rank correlation "), F.when(F.col("r") < 0, "-").otherwise("+"), F.format_number(F.abs("r"), 2),
        F.lit(" — they "), F.when(F.col("r") > 0, "move together").otherwise("move oppositely"), F.lit(". This is association in a very short series, not evidence of effect."),
    )
    return F.when(F.col("reportable"), strong).otherwise(weak)


def plant_confidence(km) -> Column:
    """Trust in a plant's river by the distance of its nearest gauge."""
    d = _col(km)
    return F.when(d.isNull(), "not placed").when(d <= 5, "likely").when(d <= 20, "possible").otherwise("weak")


def explain(readings: DataFrame) -> DataFrame:
    """readings (parameter, value, unit, and era_standard, era_low, era_high, era_year of the limits then in force, or null) with resolved_key, name, explanation, direction, compared_against, verdict, caveat.

    One limit of the time gives the verdict, a range says inside or outside; only
    without either is modern practice the measure, and then that is said.
    """
    spark = readings.sparkSession
    glossary = F.broadcast(spark.createDataFrame([(k, *v) for k, v in GLOSSARY.items()], ENTRY))
    x = readings.withColumn("_p", resolve("parameter", "unit"))
    x = x.withColumn("_key", F.coalesce("_p.substance", F.lower("parameter"))).join(glossary, F.col("_key") == F.col("substance"), "left")
    v, known = F.col("value"), F.col("name").isNotNull()
    removal, era, modern = F.col("_p.measure") == "removal", F.col("era_standard").isNotNull(), F.col("modern").isNotNull()
    in_range, given = v.between(F.col("era_low"), F.col("era_high")), F.col("era_low").isNotNull() & F.col("era_high").isNotNull()
    of_range = F.concat(short("value"), F.lit(" "), F.coalesce("unit", F.lit("")), F.when(F.coalesce("unit", F.lit("")) == "", "").otherwise(" "), F.lit("is "), F.when(in_range, "within").otherwise("outside"), F.lit(" the "), short("era_low"), F.lit("-"), short("era_high"), F.lit(" range that applied in "), F.col("era_year").cast("string"), F.lit("."))
    of_removal = F.concat(short("value"), F.lit("% of the "), F.col("name"), F.lit(REMOVED))
    of_era = F.concat(short("value"), F.lit(" "), F.col("units"), F.lit(" is "), F.when(v > F.col("era_standard"), "above").otherwise("within"), F.lit(" the "), short("era_standard"), F.lit(" "), F.col("units"), F.lit(" limit that applied then."))
    ratio = v / F.col("modern")
    note = F.concat(F.col("modern_phrase"), F.lit(" ("), F.col("modern_note"), F.lit(")."))
    of_modern = F.concat(short("value"), F.lit(" "), F.col("units"), F.when(ratio >= 1, F.concat(F.lit(" is about "), F.regexp_replace(F.format_number(ratio, 1), ",", ""), F.lit(" times "))).otherwise(" is below "), note)
    against = F.when(era, F.concat(F.lit("the standard in force at the time ("), short("era_standard"), F.lit(" "), F.col("units"), F.lit(")"))).when(modern, F.concat(F.lit("modern practice ("), F.col("modern_note"), F.lit(")")))
    asked = known & v.isNotNull()
    nothing = F.concat(F.lit("No plain-language entry for '"), F.coalesce("parameter", F.lit("")), F.lit("' yet. The measurement is recorded as-is; it has not been interpreted."))
    verdict = F.when(given & v.isNotNull(), of_range).when(asked & removal, of_removal).when(asked & era, of_era).when(asked & modern, of_modern)
    caveat = F.when(asked & ~F.coalesce(removal, F.lit(False)) & ~era & modern & ~given, F.lit(CAVEAT))
    return x.select(*(readings[c] for c in readings.columns), F.col("_p.key").alias("resolved_key"), "name", F.when(known, F.col("plain")).otherwise(nothing).alias("explanation"), "direction", F.when(asked & ~F.coalesce(removal, F.lit(False)), against).alias("compared_against"), verdict.alias("verdict"), caveat.alias("caveat"))
