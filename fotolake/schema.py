"""Table schemas and their evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the tables, and generation of the extracted metadata.
SCHEMA_VERSION, META_VERSION = 4, 2


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "TINYINT": T.ByteType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType()}


def _struct(ddl: str) -> T.StructType:
    """A schema from `name TYPE [NOT NULL], ...`; needs no session."""
    return T.StructType([T.StructField(p[0], _TYPES[p[1]], len(p) == 2) for p in (x.split() for x in ddl.split(","))])


MEDIA = _struct(
    "id BIGINT NOT NULL, path STRING NOT NULL, file_name STRING NOT NULL, ext STRING NOT NULL, size BIGINT, mtime BIGINT, date_taken BIGINT, "
    "camera_make STRING, camera_model STRING, lens STRING, iso STRING, width INT, height INT, content_hash STRING, phash BIGINT, missing BOOLEAN, "
    "dom_color INT, lat DOUBLE, lon DOUBLE, meta_version BIGINT"
)
USER_META = _struct("content_hash STRING NOT NULL, hidden BOOLEAN, rating TINYINT, kind STRING, updated_at BIGINT")
LEDGER = _struct("id BIGINT NOT NULL, batch BIGINT, original_path STRING, quarantine_path STRING, moved_at BIGINT, restored BOOLEAN")
FILE_META = _struct(
    "name STRING, ext STRING, parent STRING, size BIGINT, date_taken TIMESTAMP, date_created TIMESTAMP, date_modified TIMESTAMP, date_accessed TIMESTAMP, "
    "camera_make STRING, camera_model STRING, lens STRING, iso STRING, width STRING, height STRING, lat DOUBLE, lon DOUBLE"
)
#: What a row of an older table gets in a column that did not exist yet.
DEFAULTS = {"missing": False, "meta_version": 0, "hidden": False, "rating": 0, "restored": False}


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a table of any earlier version to `schema`: absent columns are added with their default or null, types are cast, other columns dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])
