"""Schemas of the stored tables and of the wire shapes, as DDL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

STRINGS = "map<string,string>"

TRACES = (
    "project_id string, id string, timestamp timestamp, name string, user_id string, session_id string, environment string, release string,"
    f" version string, tags array<string>, metadata {STRINGS}, input string, output string, event_ts timestamp, is_deleted boolean, seq bigint"
)
OBSERVATIONS = (
    "project_id string, id string, trace_id string, parent_observation_id string, type string, name string, start_time timestamp, end_time timestamp,"
    f" level string, status_message string, model string, model_parameters {STRINGS}, input string, output string, usage_details map<string,decimal(20,0)>,"
    f" cost_details map<string,decimal(18,9)>, completion_start_time timestamp, metadata {STRINGS}, event_ts timestamp, is_deleted boolean, seq bigint"
)
SCORES = (
    "project_id string, id string, trace_id string, observation_id string, name string, data_type string, value double, string_value string, source string,"
    f" import_source string, comment string, metadata {STRINGS}, timestamp timestamp, event_ts timestamp, is_deleted boolean, seq bigint"
)
RAW_REFS = "project_id string, trace_id string, object_key string, received_at timestamp, event_ts timestamp, applied tinyint"
TABLES = {"traces": TRACES, "observations": OBSERVATIONS, "scores": SCORES}

#: The column whose UTC day is part of the key and whose month is the partition.
SORT_TIME = {"traces": "timestamp", "observations": "start_time", "scores": "timestamp"}
#: The key beside the project and the day.
RECORD = {"traces": ("id",), "observations": ("trace_id", "id"), "scores": ("trace_id", "id")}

INGEST_EVENT = "id string, type string, source string, schemaVersion int, idempotencyKey string, body string"
INGEST_BATCH = f"batchId string, projectId string, receivedAt string, events array<struct<{INGEST_EVENT.replace(' string', ':string').replace(' int', ':int')}>>"

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
OTLP_REQUEST = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string>,spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRIBUTES},status:struct<code:int,message:string>>>>>>>"
)
COMPAT_REQUEST = "batch array<struct<id:string,timestamp:string,type:string,body:string>>, metadata string"


def struct_of(ddl: str) -> StructType:
    """Needs a session."""
    return StructType.fromDDL(ddl)


def utc(spark: SparkSession) -> SparkSession:
    """Days, months and text forms of times are UTC's."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; days in keys are UTC days")
