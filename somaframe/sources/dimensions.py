"""Gene panels, sample lists and caller layouts used as small dimensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Gene panels, display orders, sample names.
COMPLEX_PANEL = [
    "CHD3", "CHD4", "CHD5", "HDAC1", "HDAC2", "MTA1", "MTA2", "MTA3", "GATAD2A",
    "GATAD2B", "PWWP2A", "PWWP2B", "MBD2", "MBD3", "RBBP4", "RBBP7", "CDK2AP1",
]
COMPLEX_ORDER = [
    "CHD4", "CHD3", "RBBP7", "MTA1", "MTA2", "CHD5", "MBD2", "GATAD2B", "HDAC2",
    "PWWP2B", "RBBP4", "MBD3", "MTA3", "GATAD2A", "HDAC1", "CDK2AP1", "PWWP2A",
]
DRIVER_PANEL = [
    "CDKN2A", "FAT1", "TP53", "CASP8", "NOTCH1", "PIK3CA", "AJUBA", "KMT2D", "KRT5",
    "TGFBR2", "CTCF", "HLA-A", "HRAS", "EPHA2", "H1-5", "HRNR", "NECAB1", "PSIP1", "FOSL2",
]
DRIVER_ORDER = [
    "TP53", "CDKN2A", "PIK3CA", "FAT1", "NOTCH1", "KMT2D", "CASP8", "AJUBA", "HRAS",
    "TGFBR2", "HLA-A", "HRNR", "NECAB1", "EPHA2", "PSIP1", "CTCF", "FOSL2", "H1-5", "KRT5",
]
SHORT_COMPLEX_PANEL = ["CDK2AP1"]
SHORT_DRIVER_PANEL = ["CDKN2A", "FAT1", "TP53", "CASP8", "NOTCH1"]
SHORT_ORDER = ["TP53", "CDKN2A", "FAT1", "NOTCH1", "CASP8", "CDK2AP1"]
CELL_LINES = ["CA1", "LM", "LUC4", "SCC4", "SCC9", "SCC15", "SCC25"]
TRIPLOID_LINES = ["SCC4", "SCC9", "SCC15"]
COMPLEX_LABEL = "NuRD Complex"
DRIVER_LABEL = "Recurrent mutations in OSCC"


def distinct_list(values: Iterable[str]) -> list[str]:
    """The values once each, in first-seen order."""
    return list(dict.fromkeys(values))


def dimension(spark: SparkSession, values: Iterable[str], name: str) -> DataFrame:
    """A one-column table of an in-code list, deduplicated, with its position."""
    rows = [(v, i) for i, v in enumerate(distinct_list(values))]
    return spark.createDataFrame(rows, f"{name} string, position int")
