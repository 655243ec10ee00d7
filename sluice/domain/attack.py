"""ATT&CK techniques and tactics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.domain.indicators import BLANKS

# Tactics in their order, each with its techniques.
TECHNIQUES = {
    "reconnaissance": "T1595 T1592 T1589 T1590 T1591 T1598 T1597 T1596 T1593 T1594",
    "resource-development": "T1583 T1586 T1584 T1587 T1588 T1608 T1585 T1650",
    "initial-access": "T1189 T1190 T1133 T1200 T1566 T1091 T1195 T1199 T1078",
    "execution": "T1059 T1203 T1204 T1559 T1053 T1129 T1106 T1072 T1569 T1610 T1648 T1651",
    "persistence": "T1098 T1197 T1547 T1037 T1543 T1546 T1136 T1554 T1525 T1556 T1137 T1542 T1505 T1205 T1176",
    "privilege-escalation": "T1548 T1134 T1484 T1611 T1055 T1068 T1574",
    "defense-evasion": "T1562 T1070 T1036 T1027 T1218 T1140 T1112 T1497 T1620 T1211 T1222 T1564 T1553 T1656 T1006 T1014 T1202 T1207 T1216 T1221 T1480 T1600 T1601",
    "credential-access": "T1110 T1552 T1555 T1003 T1056 T1558 T1557 T1212 T1187 T1539 T1606 T1621 T1649 T1040",
    "discovery": "T1046 T1087 T1082 T1083 T1057 T1018 T1016 T1049 T1033 T1069 T1518 T1201 T1007 T1010 T1124 T1120 T1135 T1613 T1580 T1526 T1538 T1619 T1622",
    "lateral-movement": "T1021 T1210 T1550 T1080 T1563 T1570 T1534",
    "collection": "T1560 T1213 T1005 T1039 T1025 T1074 T1114 T1115 T1119 T1123 T1125 T1113 T1602 T1530 T1185",
    "command-and-control": "T1071 T1105 T1573 T1090 T1095 T1132 T1568 T1571 T1102 T1104 T1008 T1092 T1219 T1572 T1001 T1659",
    "exfiltration": "T1041 T1048 T1567 T1029 T1030 T1011 T1052 T1020 T1537",
    "impact": "T1485 T1486 T1490 T1489 T1498 T1499 T1491 T1561 T1565 T1529 T1496 T1531 T1495 T1657 T1488",
}
TACTICS = tuple(TECHNIQUES)
CATALOG = tuple((t, tactic) for tactic, listed in TECHNIQUES.items() for t in listed.split())
_TACTIC = dict(CATALOG)


def normalize_technique(text: str | None) -> str | None:
    """The parent of a well-formed technique id (T1059 or T1059.001), else None."""
    m = re.fullmatch(r"(T[0-9]{4})(\.[0-9]{3})?", (text or "").strip(BLANKS).upper(), re.ASCII)
    return m[1] if m else None


def parent_technique(text: str) -> str | None:
    """T and digits before the first dot, in capitals, else None."""
    m = re.fullmatch(r"T[0-9]+", text.strip(BLANKS).upper().split(".")[0].strip(BLANKS), re.ASCII)
    return m[0] if m else None


def tactic_for_technique(text: str) -> str | None:
    return _TACTIC.get(parent_technique(text) or "")


def techniques_for_tactic(tactic: str) -> list[str]:
    return [t for t, found in CATALOG if found == tactic]


def _trimmed(c: Column) -> Column:
    return F.upper(F.btrim(c, F.lit(BLANKS)))


def parent(c: Column) -> Column:
    """parent_technique as a column."""
    found = F.btrim(F.substring_index(_trimmed(c), ".", 1), F.lit(BLANKS))
    return F.when(found.rlike(r"\AT[0-9]+\z"), found)


def normalized(c: Column) -> Column:
    """normalize_technique as a column."""
    found = F.regexp_extract(_trimmed(c), r"\A(T[0-9]{4})(\.[0-9]{3})?\z", 1)
    return F.when(found != "", found)


def with_tactic(df: DataFrame, technique: str, name: str = "tactic") -> DataFrame:
    """df with the primary tactic of its technique column, null if unknown.

    The catalog is a fixed small table, broadcast.
    """
    known = catalog(df.sparkSession).select(F.col("technique").alias("#t"), F.col("tactic").alias("#tactic"))
    return df.join(F.broadcast(known), parent(F.col(technique)) == F.col("`#t`"), "left").drop("#t").withColumnRenamed("#tactic", name)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "technique string, tactic string")
