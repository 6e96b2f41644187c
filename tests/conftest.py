import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thermocline.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PROFILE_DDL = ("basin int, timestamp timestamp, cycle_number int, vertical_sampling_scheme string, longitude double, "
               "latitude double, pressure_decibar double, salinity_psu double, temperature_degc double")


@pytest.fixture
def profile_rows(spark):
    """Build profiles from (time text, pressure, temperature, salinity[, overrides]) tuples."""
    from pyspark.sql import functions as F

    def build(rows, **common):
        base = {"basin": 1, "cycle_number": 7, "vertical_sampling_scheme": "Primary sampling",
                "longitude": -30.5, "latitude": 45.25, **common}
        data = [({**base, **(r[4] if len(r) > 4 else {})}, r) for r in rows]
        df = spark.createDataFrame(
            [(b["basin"], r[0], b["cycle_number"], b["vertical_sampling_scheme"], b["longitude"], b["latitude"],
              r[1], r[3], r[2]) for b, r in data], PROFILE_DDL.replace("timestamp timestamp", "timestamp string"))
        return df.withColumn("timestamp", F.to_timestamp("timestamp"))

    return build
