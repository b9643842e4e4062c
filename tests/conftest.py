import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weftline.plans.session import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def normal(rows, columns):
    """Rows as sorted text, columns by name, floats to 6 decimals, dates as their day."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return round(x, 6)
        return str(x).removesuffix(" 00:00:00") if hasattr(x, "year") else x

    return sorted(repr([cell(r[i]) for i in at]) for r in rows)
