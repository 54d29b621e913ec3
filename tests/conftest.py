from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from continuity.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    return local_session(
        8,
        8,
        **{
            "spark.checkpoint.dir": str(root),
            "spark.sql.warehouse.dir": str(root / "warehouse"),
        },
    )
