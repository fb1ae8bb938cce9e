from __future__ import annotations

import pytest

from grapevine.operators import distinct, skew
from grapevine.session import build_session, use_trial_folder


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    use_trial_folder(session)
    yield session
    session.stop()


@pytest.fixture
def always_skewed(spark, monkeypatch):
    """No broadcasts, any amount of data counts as large, and every key as hot."""
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(distinct, "SET_ROWS", 1)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "0",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
