import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from fotolake.runtime import session

    s = session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def media(spark):
    """Build media rows from dicts; what is not given has a plain default."""
    from fotolake.schema import MEDIA

    def make(*rows):
        base = dict.fromkeys(MEDIA.names) | {"size": 100, "mtime": 1000, "missing": False, "meta_version": 2, "ext": "jpg"}
        full = []
        for i, r in enumerate(rows):
            x = base | {"id": i + 1, "path": f"/lib/{i + 1}.jpg"} | r
            x["file_name"] = x["path"].rsplit("/", 1)[-1] if "file_name" not in r else r["file_name"]
            full.append(tuple(x[c] for c in MEDIA.names))
        return spark.createDataFrame(full, MEDIA)

    return make
