import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    from barloom.plans.staging import ship_package

    s = session()
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans name a file by its whole path, however long
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Build a numbered table from ``{series: {column: values}}`` at a fixed step in seconds."""
    import pandas as pd
    from pyspark.sql import functions as F

    from barloom.plans.blocks import from_epoch

    def build(data, step=86400, start=1704067200, shuffle=True):
        frames = []
        for key, columns in data.items():
            pdf = pd.DataFrame(columns)
            pdf.insert(0, "series_id", key)
            pdf["pos"] = range(1, len(pdf) + 1)
            pdf["epoch"] = start + step * (pdf["pos"] - 1)
            frames.append(pdf)
        pdf = pd.concat(frames, ignore_index=True)
        if shuffle:
            pdf = pdf.sample(frac=1, random_state=7)
        rows = [tuple(None if v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
        types = {c: "string" if c == "series_id" else "bigint" if c in ("pos", "epoch") else "double" for c in pdf.columns}
        for c in pdf.columns:
            if types[c] == "double" and pdf[c].map(lambda v: isinstance(v, str)).any():
                types[c] = "string"
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in types.items())).repartition(3)
        return df.withColumn("ts", from_epoch(F.col("epoch"))).drop("epoch")

    return build


@pytest.fixture
def frame():
    """Collect a table as pandas, in series order."""

    def collect(df, key="pos"):
        return df.toPandas().sort_values(["series_id", key]).reset_index(drop=True)

    return collect
