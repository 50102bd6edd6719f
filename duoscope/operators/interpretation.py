"""Rule-based interpretation of profiled rows: mixture, geometry role, overlay, relation, complexity and label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip01, number_or
from ..functions.text import contains_any

# Names of regions 0 to 3, and terms of labels that tell a direction.
AFFECTS = ["Subdued Melancholy", "Gentle Warmth", "Volatile Intensity", "Playful Vitality"]
DIRECTIONAL_TERMS = ["lyric", "lyrical", "valence-reframed", "undercurrent", "amplified tension", "cross-modal tension"]
OPPOSITION = 0.25
PREFIXES = {"prototype": "Prototype", "representative": "Representative", "peripheral_representative": "Peripheral Representative", "peripheral_extreme": "Peripheral Extreme", "ambiguous_boundary": "Ambiguous Boundary", "boundary": "Boundary"}


def affect(number: Column) -> Column:
    return reduce(lambda a, r: a.when(number == r, AFFECTS[r]), range(len(AFFECTS)), F.when(F.lit(False), "")).otherwise("Unknown")


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that the value is below."""
    out = F.when(value < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(value < bound, name)
    return out.otherwise(last)


def mixture(margin: Column, blend: Column) -> Column:
    return F.when((margin < 0) | (blend >= 0.80), "boundary_blend").when(blend >= 0.45, "strong_secondary_affect").when(blend >= 0.20, "mild_secondary_undertone").otherwise("clear_primary_region")


def geometry_role(mix: Column, typicality: Column, confidence: Column, margin: Column) -> Column:
    out = F.when(mix == "boundary_blend", "boundary").when(typicality >= 0.80, "prototype").when(typicality >= 0.60, "representative").when(typicality >= 0.30, "peripheral_representative")
    return out.when((confidence >= 0.75) & (margin > 0), "peripheral_extreme").otherwise("ambiguous_boundary")


def relation(level: Column, percentile: Column, name: Column, dv: Column, da: Column) -> Column:
    agreeing = contains_any(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "_", "-"), ["modality-consistent", "modality consistent"])
    prefix = F.when(level == "mild", "mild_").otherwise("")
    parts = F.concat_ws(
        "; ",
        F.when(dv > 0, F.concat(prefix, F.lit("lyric_valence_uplift"))).when(dv < 0, F.concat(prefix, F.lit("lyric_valence_tempering"))),
        F.when(da > 0, F.concat(prefix, F.lit("lyric_arousal_intensification"))).when(da < 0, F.concat(prefix, F.lit("lyric_arousal_softening"))),
    )
    return F.when((percentile < 0.25) | agreeing | (parts == ""), "affective_concordance").otherwise(parts)


def overlay(cluster: Column, role: Column, p: Column, dv: Column, da: Column) -> Column:
    return (
        F.when((cluster == 3) & (p < 0.40) & role.isin("prototype", "representative"), "Concordant Vitality")
        .when(p < 0.25, "Low Tension Concordance")
        .when(p < 0.60, "Mild Cross-modal Inflection")
        .when((cluster == 0) & (dv > 0), "Bittersweet Lyrical Lift")
        .when((cluster == 1) & ((dv > 0) | (da > 0)), "Warm Elegiac / Lyrical Warmth Lift")
        .when((cluster == 2) & (p >= 0.70) & (da > 0), "Lyrically Amplified Tension")
        .when((cluster == 2) & (dv > 0) & (da <= 0), "Valence-Reframed Intensity")
        .when((cluster == 3) & ((dv < 0) | (da < 0)), "Audio-led Exuberance with Dark Lyrical Undercurrent")
        .when(p >= 0.80, "High Cross-modal Tension")
        .otherwise("Moderate Cross-modal Tension")
    )


def opposition(cluster: Column, p: Column, dv: Column, da: Column) -> Column:
    holds = ((cluster == 0) & (dv > 0)) | ((cluster == 1) & (F.greatest(F.abs(dv), F.abs(da)) >= OPPOSITION)) | ((cluster == 2) & (dv > 0)) | ((cluster == 3) & ((dv < 0) | (da < 0)))
    return F.when((p >= 0.60) & F.coalesce(holds, F.lit(False)), 1).otherwise(0)


def final_label(primary: Column, alt: Column, role: Column, mix: Column, p: Column, level: Column, over: Column) -> Column:
    named = reduce(lambda a, kv: a.when(role == kv[0], kv[1]), PREFIXES.items(), F.when(F.lit(False), "")).otherwise("Post-hoc")
    lit = F.lit
    return (
        F.when(mix == "boundary_blend", F.concat(primary, lit(" / "), alt, lit(" Boundary Blend")))
        .when(mix == "mild_secondary_undertone", F.concat(primary, lit(" with mild "), alt, lit(" undertone")))
        .when(mix == "strong_secondary_affect", F.concat(primary, lit(" with strong "), alt, lit(" undertone")))
        .when((role == "prototype") & (level == "low"), F.concat(lit("Concordant "), primary))
        .when((role == "prototype") & (p >= 0.60), F.concat(primary, lit(" with "), over))
        .when((role == "peripheral_extreme") & (p >= 0.70), F.concat(lit("Peripheral high-tension "), primary))
        .when((p >= 0.60) & ~over.isin("Moderate Cross-modal Tension", "High Cross-modal Tension"), F.concat(primary, lit(" with "), over))
        .when(level.isin("moderate", "high"), F.concat(named, lit(" "), primary, lit(" with "), level, lit(" tension")))
        .otherwise(F.concat(named, lit(" "), primary))
    )


def interpret(df: DataFrame) -> DataFrame:
    """Adds all derived fields to a profile (cluster_id, w_0..3, nearest_alt, margin, typicality, confidence, tension)."""
    own = reduce(lambda a, r: a.when(F.col("cluster_id") == r, F.col(f"w_{r}")), range(4), F.when(F.lit(False), 0.0))
    alt = reduce(lambda a, r: a.when(F.col("nearest_alt") == r, F.col(f"w_{r}")), range(4), F.when(F.lit(False), 0.0))
    p, dv, da = clip01("tension_percentile"), number_or("dv"), number_or("da")
    out = df.withColumns({"primary_affect": affect(F.col("cluster_id")), "alt_affect": affect(F.col("nearest_alt")), "blend_ratio": number_or(alt) / F.greatest(number_or(own), F.lit(1e-8))})
    out = out.withColumn("mixture_type", mixture(number_or("region_margin"), F.col("blend_ratio")))
    out = out.withColumn("geometry_role", geometry_role(F.col("mixture_type"), number_or("region_typicality"), number_or("region_confidence"), number_or("region_margin")))
    out = out.withColumn("tension_level", ladder(p, [(0.25, "low"), (0.60, "mild"), (0.80, "moderate")], "high"))
    secondary = (
        F.when(F.col("mixture_type") == "mild_secondary_undertone", F.concat(F.lit("with a mild "), "alt_affect", F.lit(" undertone")))
        .when(F.col("mixture_type") == "strong_secondary_affect", F.concat(F.lit("with a strong "), "alt_affect", F.lit(" undertone")))
        .when(F.col("mixture_type") == "boundary_blend", F.concat("primary_affect", F.lit(" / "), "alt_affect", F.lit(" boundary blend")))
        .otherwise("")
    )
    out = out.withColumns({
        "secondary_affect": secondary, "cross_modal_relation": relation(F.col("tension_level"), p, F.col("tension_name"), dv, da),
        "tension_overlay": overlay(F.col("cluster_id"), F.col("geometry_role"), p, dv, da), "opposition": opposition(F.col("cluster_id"), p, dv, da),
    })
    score = 0.35 * clip("blend_ratio", 0, 1) + 0.35 * p + 0.15 * (1 - clip01("region_typicality")) + 0.15 * F.col("opposition")
    out = out.withColumn("complexity", clip(score, 0, 1))
    out = out.withColumn("complexity_level", ladder(F.col("complexity"), [(0.25, "simple / concordant"), (0.50, "mildly complex"), (0.70, "complex")], "highly complex / ambivalent"))
    label = final_label(F.col("primary_affect"), F.col("alt_affect"), F.col("geometry_role"), F.col("mixture_type"), p, F.col("tension_level"), F.col("tension_overlay"))
    return out.withColumn("final_label", label)


def explanation() -> Column:
    """One sentence on an interpreted row."""
    secondary = F.when(F.col("secondary_affect") == "", "without a substantive secondary affective undertone").otherwise(F.col("secondary_affect"))
    lit = F.lit
    return (
        F.when(F.col("mixture_type") == "boundary_blend", F.concat(lit("boundary mixture; the "), "primary_affect", lit(" center is qualified by "), secondary))
        .when(F.col("cross_modal_relation") == "affective_concordance", F.concat("primary_affect", lit(" remains the main frame, "), secondary, lit("; audio and lyrics agree")))
        .otherwise(F.concat("primary_affect", lit(" is the main frame, "), secondary, lit(", with "), "tension_level", lit(" audio-lyric contrast ("), "cross_modal_relation", lit(") and "), "complexity_level", lit(" structure")))
    )


def eligible() -> Column:
    """Whether an interpreted, flagged row is fit for the main text."""
    told = contains_any("final_label", DIRECTIONAL_TERMS)
    flagged = F.col("encoding_issue") | F.col("explicit_title") | F.col("descriptor_conflict")
    blend = (F.col("mixture_type") == "boundary_blend") & (F.col("selected_role") != "boundary_case")
    return (F.trim("final_label") != "") & ~flagged & ~blend & ~((F.col("tension_level") == "low") & told)
