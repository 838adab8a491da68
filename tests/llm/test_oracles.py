import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import differs, duck  # noqa: E402

from ondula.llm.oracle import ORACLES  # noqa: E402
from ondula.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(ORACLES[name])
    assert differs(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
