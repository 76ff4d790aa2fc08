"""Labels, recodes and orders as the SQL of the queries states them, apart from the library's."""

# Class labels, their recodes and their order of priority.
SNV_PRIORITY = ["Nonsense", "Start Loss", "Frameshift", "Stop Loss", "Inframe InDel", "Missense", "Splice Site"]
EXONIC_TO_SNV = {
    "frameshift deletion": "Frameshift", "frameshift insertion": "Frameshift",
    "nonframeshift deletion": "Inframe InDel", "nonframeshift insertion": "Inframe InDel",
    "nonframeshift substitution": "Inframe InDel", "nonsynonymous SNV": "Missense", "startloss": "Start Loss",
    "stopgain": "Nonsense", "stoploss": "Stop Loss", "splicing": "Splice Site",
}
MAF_TO_SNV = {
    "Missense_Mutation": "Missense", "Splice_Site": "Splice Site", "Frame_Shift_Del": "Frameshift",
    "Frame_Shift_Ins": "Frameshift", "In_Frame_Del": "Inframe InDel", "In_Frame_Ins": "Inframe InDel",
    "Nonstop_Mutation": "Stop Loss", "Nonsense_Mutation": "Nonsense", "Translation_Start_Site": "Start Loss",
}
FUNC_TO_SNV = {
    "frameshift": "Frameshift", "inframe indel": "Inframe", "missense": "Missense", "splice site": "Splice site",
    "stop gain": "Nonsense", "start loss": "Other non-synonymous mutations",
    "stop loss": "Other non-synonymous mutations",
}
TRACK_TO_CN = {"amp_rec": "Amplification", "homdel_rec": "Deep Deletion", "hetloss_rec": "Shallow Deletion"}
TRACK_TO_SNV = {"splice_rec": "Splice site (putative driver)", "splice": "Splice site"}
TRACK_TO_SNV_RANKED = {"splice_rec": "Splice Mutation (putative driver)"}
DRIVER_PRIORITY = [
    "Truncating mutation (putative driver)", "Inframe Mutation (putative driver)",
    "Splice Mutation (putative driver)", "Missense Mutation (putative driver)",
    "Truncating mutation (putative passenger)", "Inframe Mutation (putative passenger)",
    "Missense Mutation (putative passenger)",
]
TWO_LAYERS = [
    ["Deep Deletion", "Amplification", "Shallow Deletion", "Gain"],
    ["Nonsense", "Frameshift", "Start Loss", "Stop Loss", "Inframe InDel", "Missense", "Splice Site"],
]
COMPARED_PAIRS = [
    ("cn", "cn_b"), ("cn", "cn_a"), ("cn", "log2_a"), ("cn", "cn_mean"), ("cn", "cn_min_dev"),
    ("cn_as_diploid", "cn_b"), ("cn_as_diploid", "cn_a"), ("cn_as_diploid", "log2_a"),
    ("cn_as_diploid", "cn_mean"), ("cn_as_diploid", "cn_min_dev"),
]
