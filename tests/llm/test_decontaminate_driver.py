"""Windows reach the join without passing through the driver's Python, whether broadcast or shuffled."""

import pytest
from test_decontaminate import brute, run

from flowsieve.llm import decontaminate

ITEMS = [(i, f"common passage of {i % 2} words " + " ".join(f"w{i % 3}x{k}" for k in range(16))) for i in range(60)] + [(90, "alone")]
DOCS = [(i, f"start {i} " + ITEMS[i % 60][1] + (" alone" if i % 7 == 0 else "")) for i in range(70)] + [(80, "nothing here"), (81, None)]


def test_no_rows_are_fetched(spark, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")

    def fetched(self):
        raise AssertionError("rows are fetched by the driver")

    monkeypatch.setattr(type(d), "collect", fetched)
    assert decontaminate.contamination(d, b).filter("contaminated").count() == 70


@pytest.mark.parametrize("rows", [500_000, 0])
def test_broadcast_or_not_gives_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "PREFIX_ROWS", rows)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
