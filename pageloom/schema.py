"""Fixed schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
}


def _table(columns: str) -> T.StructType:
    """A schema from ``name TYPE, name TYPE``; unlike Spark's own parser it needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_BOOKMARK = _table("pos BIGINT, ts TIMESTAMP, url STRING, title STRING, folder STRING, source STRING")

STORE = _table(
    "key BIGINT, url STRING, name STRING, title STRING, type STRING, folder STRING, guid STRING, id STRING, "
    "date_added STRING, description STRING, content STRING, content_length INT, content_hash STRING, "
    "url_hash STRING, crawl_time TIMESTAMP, crawl_method STRING, error STRING, summary STRING, "
    "summary_model STRING, summary_time TIMESTAMP, domain STRING, date DATE"
)

FAILURE = _table("pos BIGINT, url STRING, title STRING, reason STRING, timestamp STRING")

PAGE = _table("page_id BIGINT, url STRING, html STRING, content_type STRING, status INT")

SUMMARY = _table(
    "url STRING, url_hash STRING, summary STRING, summary_model STRING, summary_time TIMESTAMP"
)

# The marker for a missing value in bookmark exports, the title
# of an untitled page, and the texts of the failure reasons.
MISSING = "N/A"
NO_TITLE = "No Title"
REASON_EMPTY = "Extracted content is empty and no HTML title available"
REASON_NON_TEXT = "Non-text content (Content-Type: %s)"
REASON_RENDERED_SITE = "Zhihu content crawl failed"
REASON_REQUEST = "Request failed: %s"
SUMMARY_FAILED = "Summary generation failed"
