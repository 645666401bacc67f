from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from quernstone.session import local_session  # noqa: E402

SF_DIR = os.environ.get("QUERNSTONE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def event_log_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("event-log")


@pytest.fixture(scope="session")
def spark(tmp_path_factory, event_log_dir):
    session = local_session(
        8,
        "quernstone-tests",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__eventLog__enabled="true",
        spark__eventLog__dir=event_log_dir.as_uri(),
        spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def load(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
