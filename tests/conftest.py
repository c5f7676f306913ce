import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# workers import the package from here
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from diurna.session import build_session

    session = build_session(
        "tests", "local[2]", spark__sql__shuffle__partitions="3", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
