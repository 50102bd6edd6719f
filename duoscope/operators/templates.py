"""Template texts on a profiled row, in English and in Chinese."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import consistent, percent_text
from ..schema import REGIONS
from .profiles import directional
from .statistics import EPS

# Phrases in (Chinese, English); {0} is the nearest alternative region. Margins are lower bounds.
MARGINS = [
    (1.0, "该样本与最近替代区域 {0} 明显分离", "it is clearly separated from the nearest alternative region, {0}"),
    (0.30, "该样本与最近替代区域 {0} 有一定接近性，但仍保留正 margin", "it is moderately close to the nearest alternative region, {0}, while retaining a positive margin"),
    (0.0, "该样本靠近 {0} 的边界，适合作为边界邻近样本讨论", "it is boundary-adjacent to {0}"),
]
NEGATIVE = ("该样本在 post-hoc prototype 距离下更接近 {0}，只能作为边界/歧义案例使用", "post-hoc prototype distance places it closer to {0}; use it only as a boundary or ambiguity case")
ROLES = {
    "prototype": ("高度原型样本", "highly prototypical"),
    "representative": ("有代表性但并非最中心的样本", "representative but not central"),
    "peripheral": ("所属区域内的外围样本", "peripheral within the assigned region"),
    "boundary": ("边界样本，不应用作主区域证据", "a boundary case, not used as main region evidence"),
}
WEAK = ("张力强度较低，因此不把小的音频-歌词方向差解释为主要证据", "tension strength is low, so small audio-lyric directional differences are not used as primary evidence")
AGREEING = ("该样本标记为 modality-consistent，方向差未达到门控阈值，因此解释为音频与歌词基本一致", "the sample is modality-consistent and directional deltas do not pass the gate, so it is interpreted as broad audio-lyric agreement")
VALENCE = (("歌词侧相对音频侧更明亮/更正向", "the lyrics are brighter or more positive than the audio"), ("歌词侧相对音频侧更暗/更负向", "the lyrics darken the affect relative to the audio"), ("歌词与音频在效价方向上基本一致", "lyrics and audio are closely aligned in valence"))
AROUSAL = (("歌词侧更激活", "the lyrics are more activating"), ("歌词侧更柔和/低唤醒", "the lyrics soften the arousal profile"), ("唤醒度方向差异很小", "the arousal contrast is small"))
NONE = "no dominant descriptor"
CHINESE = "该歌曲属于 %s 区域，是%s；region typicality 为 %s，其 balanced VA 位置相对该区域原型的 soft confidence 为 %s。%s（region margin=%.3f）。其 calibrated cross-modal tension / audio-lyric contrast profile 被标注为 %s，tension strength percentile 为 %s；%s。综合 descriptor profile 的高权重词包括：%s。"
ENGLISH = "The song is assigned to %s and is %s, with region typicality %s and assigned-region soft confidence %s; %s (region margin=%.3f). The calibrated cross-modal tension / audio-lyric contrast profile is %s, with tension strength percentile %s; %s. The top descriptor profile is: %s."
BETWEEN = ("；", "; ")
LISTED = ("、", ", ")


def region_text(number: Column) -> Column:
    """C<n> and the region's name."""
    return F.concat(F.lit("C"), number.cast("string"), F.lit(" "), F.get(F.array(*map(F.lit, REGIONS)), number))


def _margin(language: int) -> Column:
    said = lambda text: F.replace(F.lit(text), F.lit("{0}"), region_text(F.col("nearest_alt")))
    out = F.when(F.lit(False), "")
    for bound, *texts in MARGINS:
        out = out.when(F.col("region_margin") >= bound, said(texts[language]))
    return out.otherwise(said(NEGATIVE[language]))


def _role(language: int) -> Column:
    out = F.when(F.lit(False), "")
    for name, texts in ROLES.items():
        out = out.when(F.col("region_role") == name, texts[language])
    return out.otherwise(ROLES["peripheral"][language])


def _direction(language: int) -> Column:
    signed = lambda c, texts: F.when(F.col(c) > EPS, texts[0][language]).when(F.col(c) < -EPS, texts[1][language]).otherwise(texts[2][language])
    allowed = directional(F.col("tension_percentile"), consistent("tension_label", "tension_name"), F.greatest("abs_dv_percentile", "abs_da_percentile"))
    told = F.concat(signed("dv", VALENCE), F.lit(BETWEEN[language]), signed("da", AROUSAL))
    return F.when(allowed, told).when(F.col("tension_percentile") < 0.35, WEAK[language]).otherwise(AGREEING[language])


def interpretations(df: DataFrame, descriptors: DataFrame, key: str = "idx", limit: int = 5) -> DataFrame:
    """df (profiles with roles and flags) with english_interpretation and chinese_interpretation; descriptors: (key, descriptor, place)."""
    listed = descriptors.filter(F.col("place") <= limit).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "descriptor"))).alias("_d"))  # `limit` a row
    met = df.join(listed, key, "left")
    tension = F.concat("tension_label", F.lit(" / "), "tension_name")
    for language, (name, template) in enumerate((("chinese_interpretation", CHINESE), ("english_interpretation", ENGLISH))):
        words = F.array_join(F.transform("_d", lambda d: d["descriptor"]), LISTED[language])
        parts = [
            F.get(F.array(*map(F.lit, REGIONS)), F.col("cluster_id")), _role(language), percent_text("region_typicality"), percent_text("region_confidence"), _margin(language), F.col("region_margin"),
            tension, percent_text("tension_percentile"), _direction(language), F.coalesce(F.nullif(words, F.lit("")), F.lit(NONE)),
        ]
        met = met.withColumn(name, F.format_string(template, *parts))
    return met.drop("_d")
