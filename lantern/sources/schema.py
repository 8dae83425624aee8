"""Declared schemas of the catalogue's tables, and readers that never infer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USERS = "id INT NOT NULL, email STRING NOT NULL, passwordHash STRING NOT NULL, displayName STRING NOT NULL, role STRING NOT NULL, createdAt TIMESTAMP NOT NULL"
API_KEYS = "id INT NOT NULL, name STRING NOT NULL, keyHash STRING NOT NULL, createdAt TIMESTAMP NOT NULL, lastUsedAt TIMESTAMP, revokedAt TIMESTAMP, userId INT NOT NULL"
CATEGORIES = "id INT NOT NULL, name STRING NOT NULL, createdAt TIMESTAMP NOT NULL"
VENUES = "id INT NOT NULL, name STRING NOT NULL, address STRING NOT NULL, city STRING NOT NULL, postalCode STRING NOT NULL, lat DECIMAL(9,6) NOT NULL, lng DECIMAL(9,6) NOT NULL"
EVENTS = (
    "id INT NOT NULL, title STRING NOT NULL, description STRING NOT NULL, sourceUrl STRING, isFree BOOLEAN NOT NULL, price DECIMAL(8,2), photoUrl STRING, "
    "ageMin INT, ageMax INT, isPermanent BOOLEAN NOT NULL, dateStart DATE, dateEnd DATE, openTime STRING, closeTime STRING, setting STRING, status STRING NOT NULL, "
    "rejectionReason STRING, createdAt TIMESTAMP NOT NULL, venueId INT NOT NULL, categoryId INT NOT NULL, createdById INT NOT NULL, moderatedById INT"
)
OPENING_HOURS = "id INT NOT NULL, dayOfWeek INT NOT NULL, openTime STRING NOT NULL, closeTime STRING NOT NULL, eventId INT NOT NULL"

#: Events as the first version had them.
FIRST_EVENTS = (
    "id INT NOT NULL, title STRING NOT NULL, description STRING NOT NULL, isFree BOOLEAN NOT NULL, price DECIMAL(8,2), photoUrl STRING, ageMin INT NOT NULL, ageMax INT NOT NULL, "
    "dateStart DATE NOT NULL, dateEnd DATE NOT NULL, setting STRING NOT NULL, status STRING NOT NULL, rejectionReason STRING, createdAt TIMESTAMP NOT NULL, "
    "venueId INT NOT NULL, createdById INT NOT NULL, moderatedById INT"
)
FIRST = {"users": USERS, "venues": VENUES, "events": FIRST_EVENTS, "opening_hours": OPENING_HOURS}
SCHEMAS = {"users": USERS, "api_keys": API_KEYS, "categories": CATEGORIES, "venues": VENUES, "events": EVENTS, "opening_hours": OPENING_HOURS}
ROLES = ("USER", "MODERATOR", "ADMIN")
SETTINGS = ("INDOOR", "OUTDOOR", "BOTH")
#: Image types that an upload may have, with the bytes (hex) that each begins with, and its largest size.
PHOTO_TYPES = {"image/jpeg": "^FFD8FF", "image/png": "^89504E470D0A1A0A", "image/webp": "^52494646.{8}57454250", "image/gif": "^47494638(37|39)61", "image/avif": "^.{8}66747970(61766966|61766973)"}
PHOTO_BYTES = 10 * 1024 * 1024


def struct(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns and types of ``schema``, in its order; all of them may be null, as in any file."""
    fields = T._parse_datatype_string(schema).fields
    return df.to(T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a snapshot: Parquet with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def snapshot(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: read(spark, folder, n) for n in names or SCHEMAS if n != "opening_hours"}


def jdbc(spark: SparkSession, url: str, name: str, key: str = "id", low: int = 0, high: int = 1, parts: int = 8, **options) -> DataFrame:
    """The same table from a live database, read in ``parts`` ranges of its key."""
    ranges = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **ranges, **options).load()


def inline(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Literal rows with the table's schema; columns that a row leaves out are null."""
    schema = struct(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads that the size and type limits admit, with their ``type``, told by their first bytes, and ``name``."""
    # a file beyond the limit is not read
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") <= PHOTO_BYTES)
    return files.withColumns({"type": photo_type(F.col("content")), "name": F.element_at(F.split("path", "/"), -1)}).where("type IS NOT NULL")


def photo_type(content: Column) -> Column:
    """The MIME type of an image that is allowed, else null."""
    start = F.hex(F.substring(content, 1, 12))
    return F.coalesce(*(F.when(start.rlike(p), F.lit(t)) for t, p in PHOTO_TYPES.items()))


def records(bodies: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """``bodies`` with ``record``, the JSON of ``body`` by ``schema``, and ``malformed``; the record of a malformed body is null."""
    parsed = F.from_json(body, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    malformed = F.col(body).isNull() | parsed["_bad"].isNotNull() | parsed.isNull()
    return bodies.withColumns({"record": F.when(~malformed, parsed.dropFields("_bad")), "malformed": malformed})
