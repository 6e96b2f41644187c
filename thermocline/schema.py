"""Profile data model: columns, types, reference dimension and fixed values."""

from pyspark.sql import DataFrame, SparkSession, types as T


def _field(name, data_type, nullable, comment):
    return T.StructField(name, data_type, nullable, {"comment": comment})


PROFILE_SCHEMA = T.StructType([
    _field("basin", T.IntegerType(), False, "Ocean basin identifier, 1 to 5"),
    _field("timestamp", T.TimestampType(), False, "Measurement time, UTC"),
    _field("cycle_number", T.IntegerType(), False, "Float cycle number, 1-999"),
    _field("vertical_sampling_scheme", T.StringType(), True, "Sampling methodology"),
    _field("longitude", T.DoubleType(), False, "Degrees east, -180 to 180"),
    _field("latitude", T.DoubleType(), False, "Degrees north, -90 to 90"),
    _field("pressure_decibar", T.DoubleType(), False, "Pressure, decibar, 0-6000"),
    _field("salinity_psu", T.DoubleType(), True, "Salinity, PSU, 30-40"),
    _field("temperature_degc", T.DoubleType(), True, "Temperature, degrees Celsius, -2 to 35"),
])

TRAJECTORY_SCHEMA = T.StructType([
    _field("platform_number", T.StringType(), True, "Float platform identifier"),
    _field("cycle_number", T.IntegerType(), True, "Cycle number"),
    _field("longitude", T.DoubleType(), True, "Surface longitude, degrees"),
    _field("latitude", T.DoubleType(), True, "Surface latitude, degrees"),
    _field("juld", T.DoubleType(), True, "Julian day"),
    _field("juld_qc", T.IntegerType(), True, "Date quality flag"),
])

PROFILE_COLUMNS = PROFILE_SCHEMA.fieldNames()
CRITICAL_COLUMNS = [f.name for f in PROFILE_SCHEMA if not f.nullable]
MEASUREMENT_FIELDS = ["pressure_decibar", "temperature_degc", "salinity_psu"]

# Column precision of the relational store; doubles everywhere else.
JDBC_DECIMALS = {
    "longitude": "decimal(12,8)",
    "latitude": "decimal(12,8)",
    "pressure_decibar": "decimal(10,2)",
    "salinity_psu": "decimal(10,6)",
    "temperature_degc": "decimal(10,6)",
}

# Identifiers and texts that stored results contain.
BASIN_NAMES = {
    1: "Atlantic Ocean",
    2: "Pacific Ocean",
    3: "Indian Ocean",
    4: "Southern Ocean",
    5: "Arctic Ocean",
}
CHUNK_ID_PREFIX = "argo_timestamp_"
CHUNK_SOURCE = "argo_floats"
CHUNK_TYPE = "temporal_profile"
SPLIT_CHUNK_TYPE = "temporal_profile_split"
CHUNK_SIZE_LIMIT = 2000
CHARS_PER_MEASUREMENT = 80
VECTOR_DIMENSION = 384
KM_PER_DEGREE = 111.0


def basins(spark: SparkSession) -> DataFrame:
    """The five-row basin dimension, as literal rows: their size is known, so a join broadcasts them and leaves profiles in place."""
    rows = ", ".join(f"({number}, '{name}')" for number, name in BASIN_NAMES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(basin, basin_name)")
