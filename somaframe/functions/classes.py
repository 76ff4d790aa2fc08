"""Classification rules: ordered CASE chains, recodes and ordered categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from .nulls import at_least, col, if_else, in_set

# Class labels, their recodes and their order of priority.
CN_CLASSES = ["Deep Deletion", "Shallow Deletion", "Normal", "Gain", "Amplification"]
CN_THREE_CLASSES = ["Deep Deletion", "Normal", "Amplification"]
CN_TO_THREE = {"Shallow Deletion": "Normal", "Gain": "Normal"}

SNV_PRIORITY = [
    "Nonsense", "Start Loss", "Frameshift", "Stop Loss",
    "Inframe InDel", "Missense", "Splice Site",
]
EXONIC_TO_SNV = {
    "frameshift deletion": "Frameshift",
    "frameshift insertion": "Frameshift",
    "nonframeshift deletion": "Inframe InDel",
    "nonframeshift insertion": "Inframe InDel",
    "nonframeshift substitution": "Inframe InDel",
    "nonsynonymous SNV": "Missense",
    "startloss": "Start Loss",
    "stopgain": "Nonsense",
    "stoploss": "Stop Loss",
    "splicing": "Splice Site",
}
MAF_TO_SNV = {
    "Missense_Mutation": "Missense",
    "Splice_Site": "Splice Site",
    "Frame_Shift_Del": "Frameshift",
    "Frame_Shift_Ins": "Frameshift",
    "In_Frame_Del": "Inframe InDel",
    "In_Frame_Ins": "Inframe InDel",
    "Nonstop_Mutation": "Stop Loss",
    "Nonsense_Mutation": "Nonsense",
    "Translation_Start_Site": "Start Loss",
}
MAF_SILENT = [
    "Silent", "RNA", "Intron", "3'Flank", "3'UTR", "5'Flank", "5'UTR", "Splice_Region",
]
FUNC_TO_SNV = {
    "frameshift": "Frameshift",
    "inframe indel": "Inframe",
    "missense": "Missense",
    "splice site": "Splice site",
    "stop gain": "Nonsense",
    "start loss": "Other non-synonymous mutations",
    "stop loss": "Other non-synonymous mutations",
}
DISCRETE_TO_CN = {-2: "Deep Deletion", 2: "Amplification"}
SEGMENT_TYPES = {"duplication": "copy gain", "deletion": "copy loss"}
SEGMENT_TO_CN = {
    "copy gain": "Amplification",
    "copy loss": "Shallow Deletion",
    "large deletion": "Deep Deletion",
}
TRACK_TO_CN = {
    "amp_rec": "Amplification",
    "homdel_rec": "Deep Deletion",
    "hetloss_rec": "Shallow Deletion",
}
TRACK_TO_SNV = {
    "splice_rec": "Splice site (putative driver)",
    "splice": "Splice site",
}
TRACK_TO_SNV_RANKED = {"splice_rec": "Splice Mutation (putative driver)"}
DRIVER_PRIORITY = [
    "Truncating mutation (putative driver)",
    "Inframe Mutation (putative driver)",
    "Splice Mutation (putative driver)",
    "Missense Mutation (putative driver)",
    "Truncating mutation (putative passenger)",
    "Inframe Mutation (putative passenger)",
    "Missense Mutation (putative passenger)",
]
TWO_LAYERS = [
    ["Deep Deletion", "Amplification", "Shallow Deletion", "Gain"],
    ["Nonsense", "Frameshift", "Start Loss", "Stop Loss",
     "Inframe InDel", "Missense", "Splice Site"],
]
THREE_LAYERS = [
    ["Deep Deletion", "Amplification"],
    ["Nonsense", "Frameshift", "Inframe", "Splice site", "Missense",
     "Other non-synonymous mutations"],
    ["Shallow Deletion"],
]


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value, NULL where the key is not listed or NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.try_element_at(literal_map(mapping), c))


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value, unlisted values unchanged."""
    c = col(c)
    return F.coalesce(lookup(c, mapping), c)


def ordinal(c: Column | str, levels: Sequence[str]) -> Column:
    """Place (from 0) in an ordered list, NULL outside the list."""
    return lookup(c, {level: i for i, level in enumerate(levels)})


def level(c: Column | str, levels: Sequence[str]) -> Column:
    """The class itself, NULL outside the list."""
    c = col(c)
    return F.when(c.isin(list(levels)), c)


def level_of(place: Column | str, levels: Sequence[str]) -> Column:
    """Class at an ordinal place, NULL on NULL."""
    return F.get(F.array(*[F.lit(x) for x in levels]), col(place))


def absolute_cn_class(cn: Column | str, gain_from: float = 4) -> Column:
    """Class of an absolute copy number; fractions between whole deletions and
    the gain threshold are Normal, NULL stays NULL."""
    cn = col(cn)
    return (
        F.when(cn == 0, "Deep Deletion")
        .when(cn == 1, "Shallow Deletion")
        .when(cn >= 5, "Amplification")
        .when(cn >= gain_from, "Gain")
        .when(cn.isNotNull(), "Normal")
    )


def scaled_cn_class(cn: Column | str) -> Column:
    """Class of a copy number already scaled to a diploid background."""
    return absolute_cn_class(cn, gain_from=3)


def three_cn_class(cn_class: Column | str) -> Column:
    """Five classes merged to three; weak losses and gains count as Normal."""
    return level(recode(cn_class, CN_TO_THREE), CN_THREE_CLASSES)


def called_cn_class(cn: Column | str) -> Column:
    """Class of a caller's whole copy number; other fractions below 3 are NULL."""
    cn = col(cn)
    return (
        F.when(cn >= 5, "Amplification")
        .when(cn >= 3, "Gain")
        .when(cn == 2, "Normal")
        .when(cn == 1, "Shallow Deletion")
        .when(cn == 0, "Deep Deletion")
    )


def log2_call(log2: Column | str, p: Column | str, shift: float = 0.5, alpha: float = 0.05) -> Column:
    """Loss or Gain when the ratio is beyond the shift and significant; anything
    else, missing input included, is Normal."""
    log2, p = col(log2), col(p)
    return (
        F.when((log2 < -shift) & (p < alpha), "Loss")
        .when((log2 > shift) & (p < alpha), "Gain")
        .otherwise("Normal")
    )


def consensus_cn(a: Column | str, b: Column | str, neutral: float = 2) -> Column:
    """Of two copy numbers the one nearer to neutral, their mean when equally
    near, the present one when the other is missing."""
    a, b = col(a), col(b)
    da, db = F.abs(a - neutral), F.abs(b - neutral)
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .when(da < db, a)
        .when(da > db, b)
        .otherwise((a + b) / 2)
    )


def shifted_cn(cn: Column | str, sample: Column | str, triploid: Sequence[str]) -> Column:
    """Copy number of the named samples lowered by one, not below 0."""
    cn = col(cn)
    return F.when(in_set(sample, triploid), at_least(cn - 1, 0.0)).otherwise(cn)


def above(c: Column | str, cutoff: float, yes: str = "Positive", no: str = "Negative") -> Column:
    """Label by threshold (strictly above), NULL on NULL."""
    return if_else(col(c) > cutoff, F.lit(yes), F.lit(no))


def effect_class(region: Column | str, effect: Column | str) -> Column:
    """Effect, overridden by ``splicing`` where the region is exactly that;
    NULL where the region is NULL."""
    return if_else(col(region) == "splicing", F.lit("splicing"), col(effect))


def first_in_layer(alterations: Column | str, layer: Sequence[str]) -> Column:
    """First token of a ``;`` list that belongs to the layer, NULL if none."""
    tokens = F.split(col(alterations), ";")
    return F.get(F.filter(tokens, lambda t: t.isin(list(layer))), 0)


def present_classes(alterations: Column | str) -> Column:
    """Distinct non-blank classes of a ``;`` list, as an array."""
    tokens = F.split(col(alterations), ";")
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))
