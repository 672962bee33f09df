"""The identifiers of the Safe Harbor rule and how far the detectors cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.dialect import SPARK, Dialect
from textwarden.functions.patterns import HIPAA, MEDIUM, STRONG

# The identifiers by number, and their coverage.
SAFE_HARBOR = (
    (1, "Names", "existing"),
    (2, "Geographic subdivisions smaller than a state", "existing"),
    (3, "All elements of dates except year directly related to an individual", "partial"),
    (4, "Telephone numbers", "existing"),
    (5, "Fax numbers", "partial"),
    (6, "Email addresses", "existing"),
    (7, "Social Security numbers", "existing"),
    (8, "Medical record numbers", "new_regex"),
    (9, "Health plan beneficiary numbers", "new_regex"),
    (10, "Account numbers", "partial"),
    (11, "Certificate or license numbers", "new_regex"),
    (12, "Vehicle identifiers and serial numbers, including license plate numbers", "missing"),
    (13, "Device identifiers and serial numbers", "partial"),
    (14, "Web URLs", "missing"),
    (15, "Internet Protocol (IP) address numbers", "existing"),
    (16, "Biometric identifiers, including finger and voice prints", "missing"),
    (17, "Full-face photographic images and comparable images", "missing"),
    (18, "Any other unique identifying number, characteristic, or code", "partial"),
)


def coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAFE_HARBOR, "id int, identifier string, coverage string")


#: Identifiers (by number) to the detectors that look for them.
DETECTORS = {
    2: ("street address", "Street address"), 3: ("Age over 89",), 4: ("phone number", "international phone"), 6: ("email address",), 7: ("SSN pattern",), 8: ("Medical Record Number (MRN)",), 9: ("Health Plan ID",),
    10: ("credit card pattern", "IBAN", "bank routing number"), 11: ("DEA number", "NPI"), 15: ("IP address (IPv4)", "IP address (IPv6)"),
}


def found(d: Dialect, x: str, number: int) -> str:
    """SQL: whether a detector of the identifier finds anything in x."""
    table = [p for p in (*STRONG, *MEDIUM, *HIPAA) if p.name in DETECTORS.get(number, ())]
    return "(" + " OR ".join(d.rx(d.ascii_bounds(x), p.test) for p in table) + ")" if table else "false"


def coverage_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, coverage, n): the identifiers and the rows in which their detectors find something; one scan, one row of sums."""
    sums = [F.expr(f"coalesce(sum(cast({found(SPARK, text_col, i)} AS int)), 0L)").alias(f"n{i}") for i, _, _ in SAFE_HARBOR]
    rows = ", ".join(f"named_struct('id', {i}, 'coverage', '{c}', 'n', n{i})" for i, _, c in SAFE_HARBOR)
    return df.agg(*sums).select(F.explode(F.expr(f"array({rows})")).alias("r")).select("r.*")
