"""Schemas of the tables this package reads and writes."""

from pyspark.sql.types import (
    ArrayType, BinaryType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

_text = StringType()
_texts = ArrayType(_text)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


PAGES = _schema(page_id=LongType(), url=_text, html=_text)

# The content table: the record with its key, and JSON text for structured data.
CONTENT = _schema(
    url_hash=_text, url=_text, title=_text, content=_text, meta_description=_text, meta_keywords=_text, language=_text,
    author=_text, canonical_url=_text, word_count=IntegerType(), links=_texts, images=_texts,
    headings=MapType(_text, _texts), schema_org_data=_text, stored_at=TimestampType(), storage_version=_text,
    write_seq=LongType(), row_hash=LongType(), hash_prefix=_text,
)

FRONTIER = _schema(
    url=_text, domain=_text, depth=IntegerType(), priority=IntegerType(), parent_url=_text,
    discovered_time=TimestampType(), retry_count=IntegerType(), seq=LongType(),
)

FETCH_LOG = _schema(
    url=_text, ts=TimestampType(), status_code=IntegerType(), headers=MapType(_text, _text), content_type=_text,
    charset=_text, body=BinaryType(), error=_text, fetch_time=DoubleType(), retry_count=IntegerType(),
)

SEEN_KEYS = _schema(key_type=_text, key=_text, first_seen=TimestampType())

ROBOTS = _schema(origin=_text, fetched_at=TimestampType(), status=IntegerType(), body=_text)

METRIC_POINTS = _schema(
    name=_text, type=_text, ts=TimestampType(), seq=LongType(), value=DoubleType(), labels=MapType(_text, _text)
)

LOG_RECORDS = _schema(
    timestamp=_text, level=_text, logger=_text, message=_text, module=_text, function=_text, line=IntegerType(),
    exception=_text, url=_text, event_type=_text, stat_name=_text, stat_value=DoubleType(),
)
