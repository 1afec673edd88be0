import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.addPyFile(_zipped(folder))
    yield s


def _zipped(folder):
    """The package for the Python workers, whatever the working folder."""
    import zipfile

    target = folder / "code_for_tests.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*(ROOT / "veilspark").rglob("*.py"), *(ROOT / "veilspark").rglob("*.npz")]:
            z.write(f, f.relative_to(ROOT))
    return str(target)
