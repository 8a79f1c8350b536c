import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import get_spark

    scratch = tempfile.mkdtemp(prefix="riskloom-tests-")
    s = get_spark(
        master="local[*]",
        shuffle_partitions=8,
        conf={
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="riskloom-out-")


@pytest.fixture(scope="session")
def small_fact(spark):
    from riskloom.sources.fixture import complaint_fact

    return complaint_fact(spark, SF_SMALL).cache()


def fact_rows(spark, rows, cutover=3):
    """Hand-made fact rows: (firm, type, category, order, opened, upheld_tenths[, closed3_tenths]).

    Orders map to half-years from 2022 (1 = H1 2022); Pre-Duty up to ``cutover``.
    """
    from pyspark.sql import functions as F

    from riskloom import contract as K

    data = []
    for r in rows:
        firm, ftype, cat, order, opened, ut = r[:6]
        ct = r[6] if len(r) > 6 else ut
        year = 2022 + (order - 1) // 2
        half = 1 if order % 2 == 1 else 2
        data.append((firm, ftype, "G", cat, year, half, f"H{half} {year}", order,
                     "Pre-Duty" if order <= cutover else "Post-Duty", opened, float(opened), ut, ct))
    df = spark.createDataFrame(
        data,
        "firm_name string, firm_type string, firm_group string, product_category string, year int, half int, "
        "period_label string, period_order int, pre_post_duty string, complaints_opened bigint, "
        "complaints_closed double, upheld_tenths bigint, closed3_tenths bigint",
    )
    return df.select(
        "*",
        F.make_date("year", F.when(F.col("half") == 1, 1).otherwise(7), F.lit(1)).alias("period_start"),
        F.make_date("year", F.when(F.col("half") == 1, 6).otherwise(12), F.when(F.col("half") == 1, 30).otherwise(31)).alias("period_end"),
        (F.col(K.UPHELD_T).cast("double") / 10).alias(K.UPHELD),
        (F.col(K.CLOSED3_T).cast("double") / 10).alias(K.CLOSED3),
    )
