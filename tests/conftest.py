from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelspark.session import local_session  # noqa: E402
from line_table import LINE_DDL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def make_lines(spark):
    """{scan: [text | (text, confidence[, panel])]} → line table; one fixed box."""

    def build(scans, box=(10.0, 20.0, 50.0, 15.0)):
        rows = []
        for scan, lines in scans.items():
            for i, line in enumerate(lines):
                line = (line,) if isinstance(line, str) else line
                text, confidence, panel = (*line, *(0.9, "front")[len(line) - 1:])
                rows.append((scan, panel, i, text, float(confidence), box, "tesseract", "single_pass"))
        return spark.createDataFrame(rows, LINE_DDL)

    return build
