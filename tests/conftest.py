import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from barloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.barloom.workdir", str(tmp_path_factory.mktemp("work")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars31(spark):
    """31 daily bars from 2023-01-01."""
    import datetime as dt

    opens = [10, 11, 12, 11, 12, 13, 14, 15, 14, 13, 12, 13, 14, 15, 16, 17, 18, 19, 20, 19, 18, 17, 16, 15, 14, 15, 16, 17, 18, 19, 20]
    closes = [11, 12, 11, 12, 13, 14, 15, 14, 13, 12, 13, 14, 15, 16, 17, 18, 19, 20, 19, 18, 17, 16, 15, 14, 15, 16, 17, 18, 19, 20, 19]
    day = dt.date(2023, 1, 1)
    rows = [
        ("X", day + dt.timedelta(days=i), float(o), float(o + 1), float(o - 1), float(c), float(o * 10))
        for i, (o, c) in enumerate(zip(opens, closes))
    ]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")
