"""Arguments of timelines and congress questions."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import catalog, congress

GOOD = {"start_year": 1, "end_year": 9999, "event_types": ["visit"], "statuses": ["confirmed"], "limit": 200, "offset": 0}


@pytest.mark.parametrize("wrong", [{"start_year": 0}, {"end_year": 10000}, {"start_year": 5, "end_year": 4}, {"limit": 0}, {"limit": 201}, {"offset": -1}, {"event_types": [" "]}, {"statuses": ["rejected"]}])
def test_filters(wrong):
    catalog.check_filters(**GOOD)
    with pytest.raises(ValueError):
        catalog.check_filters(**GOOD | wrong)


@pytest.mark.parametrize("question, wanted", [
    ("中共一大至中共三大", ["一", "二", "三"]),
    ("中共七大到中共第五大，以及中共十二大", ["七", "六", "五", "十二"]),
    ("中共二大、中共二大", ["二"]),
    ("中共十十大到中共一大", ["十十", "一"]),
    ("没有", []),
])
def test_ordinals(spark, question, wanted):
    assert spark.createDataFrame([(question,)], "q string").select(congress.ordinals(F.col("q"))).first()[0] == wanted
