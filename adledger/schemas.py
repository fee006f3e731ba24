"""Explicit schemas. Every column is nullable: unknown is a normal value."""

from pyspark.sql.types import (BooleanType, DateType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType)

_TYPES = {"STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "DATE": DateType(),
          "BOOLEAN": BooleanType()}


def _ddl(columns: str) -> StructType:
    """Flat DDL; Spark's own parser needs a session, and these are read without one."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(","))])


# fixed values: the columns that inputs and results must have
AD = _ddl("""
 url STRING, title STRING, platform STRING, type STRING, area STRING, postcode STRING,
 price_pcm INT, bills_included STRING, available_from DATE, furnished STRING, bed_count INT,
 bathrooms INT, size_sqft INT, flatmates INT, contact STRING, notes STRING,
 bathrooms_verified_by_search BOOLEAN, area_trusted BOOLEAN, region_district STRING,
 region_name STRING, retry BOOLEAN, floor_level STRING, floor_number INT, lift STRING,
 concierge STRING, condition STRING, size_sqft_plan INT, size_plan_basis STRING,
 size_plan_confident BOOLEAN""")

PAGE = _ddl("url STRING, fetched_at DATE, source STRING, text STRING")

RECORD = _ddl("""
 url STRING, title STRING, platform STRING, area STRING, postcode STRING, price_pcm INT,
 bills_included STRING, available_from DATE, furnished STRING, bedrooms INT, bathrooms INT,
 size_sqft INT, size_sqft_plan INT, floor_level STRING, floor_number INT, lift STRING,
 concierge STRING, condition STRING, contact STRING, aircon STRING, aircon_scope STRING,
 aircon_evidence STRING, aircon_checked DATE, notes STRING, priority STRING, status STRING,
 decision_note STRING, found_on DATE, last_seen DATE, reported_on DATE""")

PENDING = StructType([
    *_ddl("url STRING, first_seen DATE, attempts INT, last_tried DATE, last_seen DATE").fields,
    StructField("row", AD)])

FLAT_VERDICT = _ddl("url STRING, verdict STRING, scope STRING, evidence STRING, text_sha STRING")

VERDICT = StructType([
    StructField("url", StringType()),
    StructField("aircon", _ddl("verdict STRING, scope STRING, evidence STRING")),
    *FLAT_VERDICT.fields[1:],
    StructField("seq", LongType())])  # which of several verdicts came later

DECISION = _ddl("url STRING, status STRING, note STRING")

BASELINE = StructType([
    *_ddl("taken_on DATE, tracked BIGINT, live BIGINT, ruled_out BIGINT").fields,
    StructField("aircon_live", MapType(StringType(), LongType())),
    *_ddl("aircon_in_unit BIGINT, unreported BIGINT").fields])
