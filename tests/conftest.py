import pyarrow as pa
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def lines(spark):
    """Numbered lines from strings."""

    def make(*values):
        table = {"line_no": pa.array(range(1, len(values) + 1), pa.int64()), "value": pa.array(values, pa.string())}
        return spark.createDataFrame(pa.table(table))

    return make
