"""The query of all window indicators leaves none out."""

from stratagrid.operators import technical as t
from stratagrid.plans import registry


def test_every_window_indicator_of_every_span_is_there(spark, sf):
    got = set(registry.QUERIES["technical_all"](spark, sf).columns)
    built = t.kbar() | t.price_ratios() | t.moving_averages() | t.bollinger() | t.roc() | t.williams() | t.cci() | t.volatility() | t.volumes()
    for d in t.SPANS:
        built |= t.position(d) | t.correlations(d) | t.trend(d) | t.counts(d) | t.extremes(d) | t.volume_shape(d)
    assert got == {"entity", "date", "atr_14", "mfi_14", "cmo_14", *built} and len(got) > 160
    assert all(f" AS {c}" in registry.ORACLES["technical_all"] for c in built)
