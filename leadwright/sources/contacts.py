"""Contact files: upload with rejects, template, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadwright.functions.text import nonblank
from leadwright.policy import CSV_EMAIL

FIELDS = ("name", "email", "designation", "department", "phone")
# Other headers of the fields.
ALIASES = {
    "email": ("email", "e-mail", "email address", "mail"),
    "name": ("name", "full name", "person name", "person_name", "contact name"),
    "designation": ("designation", "title", "job title", "role"),
    "department": ("department", "dept"),
    "phone": ("phone", "phone number", "mobile", "mobile number", "contact number"),
}
#: Rows of a file that are accepted at most: a limit of the upload.
MOST_ROWS = 2000


def field_of(header: str) -> str | None:
    """The field that a header means, in any case and with any spaces around it."""
    key = header.strip().lstrip("﻿").strip().lower()
    return next((f for f, names in ALIASES.items() if key in names), None)


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(row, name, email, designation, department, phone) of a CSV file; unknown columns go, missing ones are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    found: dict[str, str] = {}
    for c in raw.columns:
        if (f := field_of(c)) and f not in found:
            found[f] = c
    numbered = raw.withColumn("row", F.monotonically_increasing_id() + 2)  # an uploaded file is one partition
    return numbered.select("row", *((F.trim(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast("string")).alias(f) for f in FIELDS))


def judged_contacts(rows: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Accepted contacts and rejects (row, email, reason): beyond the limit of accepted rows, without an address, with a bad one, or with one that stood before."""
    email = F.lower(F.trim("email"))
    rows = rows.withColumn("email", email)
    bad = F.when(~nonblank(F.col("email")), "missing e-mail").when(~F.col("email").rlike(CSV_EMAIL), "invalid e-mail")
    rows = rows.withColumn("bad", bad)
    seen = F.row_number().over(Window.partitionBy("email", F.col("bad").isNull()).orderBy("row"))
    rows = rows.withColumn("again", F.col("bad").isNull() & (seen > 1))
    good = F.col("bad").isNull() & ~F.col("again")
    last = rows.where(good).orderBy("row").limit(most).agg(F.when(F.count("*") == most, F.max("row")).alias("last"))  # one row
    rows = rows.join(F.broadcast(last))
    rows = rows.withColumn("reason", F.when(F.col("row") > F.col("last"), "row limit").otherwise(F.coalesce("bad", F.when(F.col("again"), "duplicate in file"))))
    accepted = rows.where("reason is null").select("row", "email", F.nullif("name", F.lit("")).alias("person_name"), *(F.nullif(f, F.lit("")).alias(f) for f in ("designation", "department", "phone")))
    return accepted, rows.where("reason is not null").select("row", "email", "reason")


def template(spark: SparkSession) -> DataFrame:
    """One example row with the upload's headers."""
    return spark.createDataFrame([("Jane Doe", "jane@example.org", "Director", "Health", "+10000000000")], ", ".join(f"{f} string" for f in FIELDS))


def write_export(rows: DataFrame, path: str, fields: Sequence[str] = ()) -> None:
    """CSV files with headers; an empty result is an error."""
    if rows.isEmpty():
        raise LookupError("no leads match")
    (rows.select(*fields) if fields else rows).write.csv(path, header=True, escape='"')
