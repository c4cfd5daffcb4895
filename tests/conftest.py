import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        # many short queries: a quick compiler, no fused methods
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1").config("spark.sql.codegen.wholeStage", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
