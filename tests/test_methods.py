"""Protocols of methods sections and the rows they apply to."""

import pytest

from quarrylight.operators import methods as W

ROW = "article long, row_id long, name string, conditions map<string,string>, start int, stop int, caption string"
CAPTION = "Table 1. Properties of the prepared samples"
PLAIN = "The ionic conductivity was measured using EIS at 25 °C under 10 MPa."


def given(spark, *paragraphs, conditions=None, name="ionic_conductivity", caption=CAPTION, row=(5000, 5040)):
    spans = spark.createDataFrame([(1, k, 100 + 1000 * k, t) for k, t in enumerate(paragraphs)], "article long, span_no int, start int, text string")
    rows = spark.createDataFrame([(1, 7, name, {"temperature": "298.15 K"} if conditions is None else conditions, *row, caption), (2, 8, name, {}, *row, caption)], ROW)
    return {r.condition: r.value for r in W.linked(rows, spans).collect()}


def test_missing_conditions_are_given(spark):
    assert given(spark, "Powders were pressed at 300 MPa. " + PLAIN) == {"pressure": "10 MPa", "test_method": "EIS"}
    assert given(spark, "The ionic conductivity was determined by DC polarization. Measurements were performed at 25 °C and 5 MPa.") == {"pressure": "5 MPa", "test_method": "DC polarization"}
    assert given(spark, PLAIN, "The electronic conductivity was measured at 60 °C under 2 MPa.") == {"pressure": "10 MPa", "test_method": "EIS"}
    assert given(spark, PLAIN, conditions={"temperature": "25 °C", "pressure": "10000 kPa", "test_method": "electrochemical impedance spectroscopy"}) == {}


def test_a_named_table_needs_no_temperature(spark):
    text = "For all samples in Table 1, the ionic conductivity was measured at 25 °C under 10 MPa."
    assert given(spark, text, conditions={}, caption="Table 1. Data") == {"temperature": "25 °C", "pressure": "10 MPa"}
    assert given(spark, text, conditions={}, caption="Table 11. Data") == {}
    assert given(spark, PLAIN, conditions={}) == {}


@pytest.mark.parametrize(
    "paragraphs,more",
    [
        ((PLAIN, "The ionic conductivity was determined at 80 °C."), {}),  # two protocols
        ((PLAIN, PLAIN), {}),
        (("The ionic and electronic conductivities were measured at 25 °C under 10 MPa.",), {}),
        (("The ionic conductivity was measured at 25 °C under 10 MPa for selected samples.",), {}),
        (("The ionic conductivity was measured at 20–25 °C under 10 MPa.",), {}),
        (("The ionic conductivity was measured at 25 °C. Measurements were taken at 60 °C under 10 MPa.",), {}),
        (("The ionic conductivity of sample B was measured at 25 °C under 10 MPa.",), {}),
        (("The ionic conductivity was measured at 60 °C under 10 MPa.",), {}),  # disagrees with the row
        (("The electronic conductivity was measured at 25 °C under 10 MPa.",), {}),
        ((PLAIN,), {"caption": "Table 1. Literature values of prepared samples"}),
        ((PLAIN,), {"caption": "Table 1. Values"}),
        ((PLAIN,), {"row": (110, 150)}),  # the witness is the row's own text
        ((PLAIN,), {"name": "capacity_retention"}),
        (("",), {}), ((None,), {}), (("The furnace ran at 25 °C under 10 MPa.",), {}),
    ],
)
def test_what_is_not_clear_gives_nothing(spark, paragraphs, more):
    assert given(spark, *paragraphs, **more) == {}


def test_places_are_those_of_the_text(spark):
    text = "Dry well.  " + PLAIN + " More follows."
    spans = spark.createDataFrame([(1, 0, 40, text)], "article long, span_no int, start int, text string")
    p = W.protocols(spans).first()
    assert (" " * 40 + text)[p.start : p.stop] == PLAIN == p.quote and p.conditions == {"temperature": "25 °C", "pressure": "10 MPa", "test_method": "EIS"}
