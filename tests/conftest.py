import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeline.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """`rows(schema, [tuples])`, with text in `YYYY-MM-DD HH:MM[:SS]` turned into times."""

    def make(schema, data):
        plain = schema.replace("timestamp_ntz", "string")
        df = spark.createDataFrame(data, plain)
        for part in schema.split(", "):
            name, kind = part.rsplit(" ", 1)
            if kind == "timestamp_ntz":
                df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return make
