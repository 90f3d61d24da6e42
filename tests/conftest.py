import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.default.parallelism": "4"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = " ".join(words[(i * i + i // 7) % 10] + str(i % 13) for i in range(80))
    texts = [None, "", "   \n\t ", "one", "Two words", base, base, base.upper(), base + " tail", "x" * 250, "y z " * 60, "é ß   日本語 " * 20, "long " * 40_000, "a@b.cd, a@b.cd +49 (0)30 1234567 at 1.2.3.4 and 4111 1111 1111 1111"]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t), f"w{i}", i * 2, i % 5, f"r{i}", i) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "src2", len(base), "w", 1, 2, "r", 3), (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string, fp long, n long, rid string, y int")
