"""Views of a shop: parsing, storing, and the rules that a view must keep."""
import dataclasses

import pytest

from lodestone.config import Channel, Geometry, Measure, View, ViewError, ViewRegistry, dump_view, load_view

SHOP = View(
    "shop-sales", "SELECT cell, part, qty, price, day FROM sales", Geometry("quadkey", "cell"),
    (Channel("part", "part", "dimension", "dict"), Channel("qty", "qty", "measure", "i32"), Channel("price", "price", "measure", "f64"), Channel("day", "day", "temporal", "date")),
    mark="rect", measures=(Measure("sold", "sum(qty)"), Measure("best", "argmax(part, sum(price))"), Measure("mean", "wavg(price, qty)")),
    encoding={"color": {"channel": "sold", "bins": 5}, "size": {"channel": "price"}}, inspect={"channels": ["part", "sold"], "title": "best"}, filters=({"channel": "day", "control": "dateRange"},),
)


def but(**changes) -> View:
    return dataclasses.replace(SHOP, **changes)


def test_a_view_survives_its_text(spark, tmp_path):
    assert load_view(dump_view(SHOP.validate())) == SHOP and SHOP.grouped and SHOP.color == "sold" and SHOP.dictionaries == ["part"]
    shelf = ViewRegistry(str(tmp_path))
    shelf.save(SHOP)
    assert shelf.list() == ["shop-sales"] and shelf.get("shop-sales") == SHOP
    assert shelf.get("../shop-sales") is None and shelf.get("other") is None


def test_text_may_hold_comments_and_commas():
    text = dump_view(SHOP).replace("{", "{ // opens\n", 1).replace("\n}", ",\n/* the\nend */ }")
    assert load_view(text) == SHOP
    assert load_view(dump_view(but(query="SELECT 'a // b /* c */' AS x"))).query == "SELECT 'a // b /* c */' AS x"


BROKEN = {
    "kebab-case": but(id="Shop Sales"),
    "needs a query": but(query="  "),
    "no such kind": but(geometry=Geometry("circle", "cell")),
    "does not say its columns": but(geometry=Geometry("quadkey")),
    "role or type": but(channels=(*SHOP.channels, Channel("rain", "rain", "weather", "f32"))),
    "share a name": but(measures=(*SHOP.measures, Measure("qty", "count()"))),
    "need a name": but(measures=(*SHOP.measures, Measure("", "count()"))),
    "only keyed places": but(geometry=Geometry("lonLat", x="lon", y="lat")),
    "need a number": but(measures=(*SHOP.measures, Measure("odd", "max(part)"))),
    "need a dict": but(measures=(*SHOP.measures, Measure("odd", "argmin(price, count())"))),
    "cannot be read": but(measures=(*SHOP.measures, Measure("odd", "median(price)"))),
    "color shows no": but(encoding={"color": {"channel": "rain"}}),
    "one bin": but(encoding={"color": {"channel": "sold", "bins": 0}}),
    "size shows no": but(encoding={"size": {"channel": "rain"}}),
    "inspect shows nothing": but(inspect={"channels": []}),
    "inspect shows no channel": but(inspect={"channels": ["sold"], "title": "rain"}),
    "filters need": but(filters=({"channel": "part", "control": "dial"},)),
    "aggregate groups": but(aggregate={"by": ["rain"]}),
}


@pytest.mark.parametrize("words", BROKEN)
def test_each_rule_is_told(words):
    with pytest.raises(ViewError, match=words):
        BROKEN[words].validate()


def test_all_broken_rules_are_told_at_once():
    with pytest.raises(ViewError) as e:
        but(query="", encoding={"color": {"channel": "rain"}}).validate()
    assert "query" in str(e.value) and "rain" in str(e.value)


def test_rules_that_need_the_data():
    SHOP_NO_INSPECT = but(inspect=None)
    SHOP_NO_INSPECT.validate_classified({"part", "qty", "price", "day"})
    with pytest.raises(ViewError, match="best"):
        SHOP_NO_INSPECT.validate_classified({"qty"})
    with pytest.raises(ViewError, match="inspect"):
        SHOP.validate_classified({"part"})
