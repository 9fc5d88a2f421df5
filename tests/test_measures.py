import pytest

from lodestone.functions.measures import Agg, ArgExtreme, MeasureError, Partial, Share, Where, parse, partials

ACCEPT = {
    "sum(tests)": Agg("sum", "tests"), "count()": Agg("count"), "avg(download_mbps)": Agg("avg", "download_mbps"), "wavg(download_mbps, tests)": Agg("wavg", "download_mbps", "tests"),
    "min(latency_ms)": Agg("min", "latency_ms"), "max(tests)": Agg("max", "tests"), "  sum(  tests )  ": Agg("sum", "tests"), "sum(tests) where operator = 'apex'": Agg("sum", "tests", None, Where("operator", "apex")),
    "count() where operator = 'apex'": Agg("count", None, None, Where("operator", "apex")), "share(sum(tests)) where operator = 'apex'": Share(Agg("sum", "tests"), Where("operator", "apex")),
    "argmax(operator, sum(tests))": ArgExtreme("operator", Agg("sum", "tests"), True), "argmin(operator, avg(latency_ms))": ArgExtreme("operator", Agg("avg", "latency_ms"), False),
}
REJECT = {
    "sum()": "expected a numeric channel", "sum('tests')": "expected a numeric channel", "foo(tests)": "unknown aggregate verb 'foo'", "argmax(operator)": "expected ','", "share(sum(tests))": "requires a 'where'",
    "sum(tests) extra": "unexpected trailing token", "argmax(operator, argmax(operator, sum(tests)))": "expected an aggregate verb", "argmax(operator, sum(tests) where operator = 'apex')": "may not carry a 'where'",
    "sum(tests": "expected ')'", "sum(tests) where operator 'apex'": "expected '='", "": "expected an aggregate verb",
}


@pytest.mark.parametrize("text", ACCEPT)
def test_accepts(text):
    assert parse(text) == ACCEPT[text]


@pytest.mark.parametrize("text", REJECT)
def test_rejects(text):
    with pytest.raises(MeasureError) as e:
        parse(text)
    assert REJECT[text] in str(e.value)


def test_partials_once_in_order():
    got = partials([parse("avg(a)"), parse("wavg(b, a)"), parse("count()"), parse("argmax(d, max(a))")])
    assert [p.name for p in got] == ["sum__a", "cnt", "swp__b__a", "max__a"]
    assert Partial("swp", "b", "a") in got
