import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from churnscope.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raw_schema():
    from churnscope.sources.subscribers import RAW_SCHEMA
    return RAW_SCHEMA


def make_raw(spark, rows):
    """Raw subscriber rows from partial dicts (defaults for the rest)."""
    from churnscope.sources.subscribers import RAW_SCHEMA
    base = {
        "customerID": "1", "gender": "Female", "SeniorCitizen": 0, "Partner": "No",
        "Dependents": "No", "tenure": 12, "PhoneService": "Yes", "MultipleLines": "No",
        "InternetService": "DSL", "OnlineSecurity": "No", "OnlineBackup": "No",
        "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "No",
        "StreamingMovies": "No", "Contract": "Month-to-month", "PaperlessBilling": "Yes",
        "PaymentMethod": "Electronic check", "MonthlyCharges": 50.0, "TotalCharges": "600",
        "Churn": "No",
    }
    data = []
    for i, r in enumerate(rows):
        d = dict(base, customerID=str(i + 1))
        d.update(r)
        data.append(tuple(d[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(data, RAW_SCHEMA)
