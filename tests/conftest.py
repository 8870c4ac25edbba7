from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from querylume.session import build_session

    session = build_session("tests", cpus=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    return "/root/testdata/sf0.001"
