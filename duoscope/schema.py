"""Resolution of logical columns to physical ones at plan time: no data is read.

Three dialects are in use; in each, of two columns with one normal form the last is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

# Names under which a logical column may come, the first that is there wins.
ALIASES = {
    "song_id": ["song_id", "identifier", "track_id", "lyric_identifier", "song", "id"],
    "title": ["title", "Title", "track_title", "song_title", "name"],
    "artist": ["artist", "Artist", "performer", "artists"],
    "cluster_id": ["cluster_id", "cluster", "label", "region_id"],
    "cluster_name": ["cluster_name", "region_name", "primary_affect"],
    "balanced_valence": ["balanced_valence", "balanced_v", "c_valence"],
    "balanced_arousal": ["balanced_arousal", "balanced_a", "c_arousal"],
    "region_typicality": ["region_typicality", "typicality"],
    "region_confidence": ["region_confidence", "assigned_region_weight", "region_weight"],
    "region_margin": ["region_margin", "margin"],
    "nearest_alt_cluster": ["nearest_alt_cluster", "nearest_alternative_cluster", "alt_cluster"],
    "tension_label": ["tension_label", "tension_subtype", "subtype"],
    "tension_name": ["tension_name", "paper_tension_name", "tension_subtype_label", "subtype_name"],
    "tension_dv": ["tension_dv", "dv", "delta_v", "lyrics_minus_audio_valence"],
    "tension_da": ["tension_da", "da", "delta_a", "lyrics_minus_audio_arousal"],
    "tension_norm": ["tension_norm", "norm", "delta_norm"],
    "tension_strength_percentile": ["tension_strength_percentile", "tension_percentile", "strength_percentile", "p_tension"],
    "affective_complexity_score": ["affective_complexity_score", "acs", "complexity_score"],
    "complexity_level": ["complexity_level", "complexity_label"],
    "final_interpretation_label": ["final_interpretation_label", "interpretation_label"],
    "external_summary": ["external_summary", "external_review_summary", "summary", "review_summary"],
    "source_url": ["source_url", "external_source_url", "url", "review_url"],
    "source_name": ["source_name", "external_source_name", "publication", "source"],
    "evidence_strength": ["evidence_strength"],
    "region_agreement": ["region_agreement"],
    "tension_agreement": ["tension_agreement"],
}
# Columns of the retrieval features, in order.
FEATURES = [
    "song_id", "title", "artist", "cluster_id", "cluster_name", "balanced_valence", "balanced_arousal", "region_typicality", "region_confidence", "region_margin",
    "nearest_alt_cluster", "w_region_C0", "w_region_C1", "w_region_C2", "w_region_C3", "tension_label", "tension_name", "tension_dv", "tension_da", "tension_norm",
    "tension_strength_percentile", "affective_complexity_score", "complexity_level", "final_interpretation_label",
]
REGIONS = ["Subdued Melancholy", "Gentle Warmth", "Volatile Intensity", "Playful Vitality"]
TEXTS = {"song_id", "title", "artist", "cluster_name", "nearest_alt_cluster", "tension_label", "tension_name", "complexity_level", "final_interpretation_label"}


def package_form(name: str) -> str:
    return re.sub(r"[ \-/]", "_", name.strip().lower())


def script_form(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def audit_form(name: str) -> str:
    return name.strip().lower()


def find_column(columns: Iterable[str], candidates: Iterable[str], form: Callable[[str], str] = package_form, required: bool = False) -> str | None:
    """The physical column of the first candidate that is there, else None or ValueError."""
    found = {form(c): c for c in columns}
    for c in candidates:
        if (key := c if form is package_form else form(c)) in found:
            return found[key]
    if required:
        raise ValueError(f"none of {list(candidates)} is among {list(columns)}")
    return None


def canonical(df: DataFrame, logical: Iterable[str], form: Callable[[str], str] = script_form) -> DataFrame:
    """Those logical columns that df has, under their logical names; required ids raise."""
    chosen = {name: find_column(df.columns, ALIASES.get(name, [name]), form, name == "song_id") for name in logical}
    return df.select(*(df[physical].alias(name) for name, physical in chosen.items() if physical))
