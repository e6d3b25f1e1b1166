"""Audit logs: one gzipped JSON envelope ``{"Records": [...]}`` per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as x
from logloom.sources.lines import Parsed, no_rows, read_contents, salvage_contents, unreadable_of
from logloom.sources.scope import is_audit_file

# Payloads stay raw JSON text: a string field over an object keeps the subtree.
ENVELOPE = """
Records array<struct<eventVersion:string, eventTime:string, eventSource:string, eventName:string, awsRegion:string,
sourceIPAddress:string, userAgent:string, errorCode:string, errorMessage:string, eventID:string, eventType:string,
readOnly:boolean, managementEvent:boolean, eventCategory:string, recipientAccountId:string,
userIdentity:struct<type:string, principalId:string, arn:string, accountId:string, accessKeyId:string,
userName:string, invokedBy:string, sessionContext:struct<attributes:struct<mfaAuthenticated:string,
creationDate:string>, sessionIssuer:struct<type:string, arn:string, userName:string, accountId:string>>>,
resources:array<struct<ARN:string, accountId:string, type:string>>, requestParameters:string,
responseElements:string, additionalEventData:string>>, _broken string
"""


def _identity(u: Column) -> Column:
    context, issuer = u["sessionContext"], u["sessionContext"]["sessionIssuer"]
    return F.struct(
        x.present(u["type"]).alias("type"), x.present(u["principalId"]).alias("principal_id"),
        x.present(u["arn"]).alias("arn"), x.present(u["accountId"]).alias("account_id"),
        x.present(u["accessKeyId"]).alias("access_key_id"), x.present(u["userName"]).alias("user_name"),
        x.present(u["invokedBy"]).alias("invoked_by"),
        F.when(
            context.isNotNull(),
            F.struct(
                F.struct(
                    context["attributes"]["mfaAuthenticated"].alias("mfa_authenticated"),
                    context["attributes"]["creationDate"].alias("creation_date"),
                ).alias("attributes"),
                F.when(
                    issuer.isNotNull(),
                    F.struct(
                        issuer["type"].alias("type"), issuer["arn"].alias("arn"),
                        issuer["userName"].alias("user_name"), issuer["accountId"].alias("account_id"),
                    ),
                ).alias("session_issuer"),
            ),
        ).alias("session_context"),
    )


def parse_audit(contents: DataFrame) -> Parsed:
    """Envelopes ``(file, content)`` to audit events; a malformed envelope makes its file unreadable."""
    doc = F.from_json("content", ENVELOPE, {"columnNameOfCorruptRecord": "_broken"})
    rows = contents.select("file", doc.alias("doc"))
    readable = F.col("doc._broken").isNull() & F.col("doc").isNotNull()
    records = rows.select("file", F.inline(F.when(readable, F.col("doc.Records"))))
    resources = F.transform(
        "resources",
        lambda r: F.struct(r["ARN"].alias("arn"), r["accountId"].alias("account_id"), r["type"].alias("type")),
    )
    good = records.select(
        "file",
        x.present(F.col("eventVersion")).alias("event_version"), x.rfc3339(F.col("eventTime")).alias("event_time"),
        x.present(F.col("eventSource")).alias("event_source"), x.present(F.col("eventName")).alias("event_name"),
        x.present(F.col("awsRegion")).alias("aws_region"), x.present(F.col("sourceIPAddress")).alias("source_ip"),
        x.present(F.col("userAgent")).alias("user_agent"), x.present(F.col("errorCode")).alias("error_code"),
        x.present(F.col("errorMessage")).alias("error_message"), x.present(F.col("eventID")).alias("event_id"),
        x.present(F.col("eventType")).alias("event_type"), F.col("readOnly").alias("read_only"),
        F.col("managementEvent").alias("management_event"), x.present(F.col("eventCategory")).alias("event_category"),
        x.present(F.col("recipientAccountId")).alias("recipient_account_id"),
        _identity(F.col("userIdentity")).alias("user_identity"), resources.alias("resources"),
        F.col("requestParameters").alias("request_parameters"), F.col("responseElements").alias("response_elements"),
        F.col("additionalEventData").alias("additional_event_data"),
    )
    unreadable = rows.where(~readable).select("file", F.lit("malformed envelope").alias("err"))
    return Parsed(good, no_rows(contents.sparkSession, "file string, pos bigint, err string"), unreadable)


def read_audit(spark: SparkSession, paths, strict_files: bool = True) -> Parsed:
    if strict_files:
        return parse_audit(read_contents(spark, paths, is_audit_file))
    found = salvage_contents(spark, paths, is_audit_file)
    out = parse_audit(found.where(F.col("err").isNull()).select("file", "content"))
    return Parsed(out.good, out.bad, out.unreadable.unionByName(unreadable_of(found)))
