"""Declared schemas of the two source entities.

Declaring the schema avoids the extra pass of ``inferSchema`` and keeps
types stable between yearly files whose columns drift.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Trip file columns in file order (yellow-cab monthly CSV).
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.ByteType()),
        T.StructField("tpep_pickup_datetime", T.TimestampType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampType()),
        T.StructField("passenger_count", T.ByteType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.ByteType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("PULocationID", T.ShortType()),
        T.StructField("DOLocationID", T.ShortType()),
        T.StructField("payment_type", T.IntegerType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)

# The 38 core columns of the parking-ticket file, in file
# order, exactly as they appear in the header (note the four trailing
# blanks of "Days Parking In Effect    ").
TICKET_CORE_COLUMNS = [
    "Summons Number", "Plate ID", "Registration State", "Plate Type", "Issue Date",
    "Violation Code", "Vehicle Body Type", "Vehicle Make", "Issuing Agency",
    "Street Code1", "Street Code2", "Street Code3", "Vehicle Expiration Date",
    "Violation Location", "Violation Precinct", "Issuer Precinct", "Issuer Code",
    "Issuer Command", "Issuer Squad", "Violation Time", "Time First Observed",
    "Violation County", "Violation In Front Of Or Opposite", "House Number",
    "Street Name", "Intersecting Street", "Date First Observed", "Law Section",
    "Sub Division", "Days Parking In Effect    ", "From Hours In Effect",
    "To Hours In Effect", "Vehicle Color", "Unregistered Vehicle?", "Vehicle Year",
    "Feet From Curb", "Violation Post Code", "Violation Description",
]

# Columns seen in some yearly files only (appended after the core).
TICKET_EXTRA_COLUMNS = [
    "No Standing or Stopping Violation", "Hydrant Violation", "Double Parking Violation",
    "Latitude", "Longitude", "Community Board", "Community Council", "Census Tract",
    "BIN", "BBL", "NTA", "Meter Number", "Violation Legal Code",
]

TICKET_TYPES = {
    "Summons Number": T.LongType(),
    "Violation Code": T.IntegerType(),
    "Violation Precinct": T.IntegerType(),
    "Issuer Precinct": T.IntegerType(),
}


def ticket_schema(columns: list[str] | None = None, typed: bool = True) -> T.StructType:
    """Schema for a ticket file with the given header columns.

    ``Issue Date`` and ``Violation Time`` stay text: the date is
    ``MM/dd/yyyy`` and the clock is ``hhmm`` + ``A``/``P``; both are parsed
    by the tolerant functions in ``citylens.functions``.
    """
    cols = columns or TICKET_CORE_COLUMNS
    return T.StructType(
        [T.StructField(c, TICKET_TYPES.get(c, T.StringType()) if typed else T.StringType()) for c in cols]
    )
