"""Head blocks against a full reader of the format, where one is installed."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import headblock

CASES = [
    "title: A note\ntags:\n  - one\n  - two words\n",
    "tags:\n- at the margin\n- 2\nnext: yes\n",
    "tags: [a, 'b, c', \"d\\n\", 5, [x, y], {k: v, w: 1}]\nempty: []\nnone: {}\n",
    "author:\n  name: Ann\n  mail:\n    work: a@b.c\n    home: null\n  age: 41\nafter: 1.5\n",
    "people:\n  - name: Ann\n    tags: [x]\n  - name: Bob\n    roles:\n      - lead\n      - cook\n",
    "folded: >\n  one line\n  and more\n\n  new part\nliteral: |\n  keep\n    this\nlast: |-\n  no end\n",
    "a: 'it''s'\nb: \"q \\\"x\\\" \\u00e9\"\nc: plain text # comment\nd: no#comment\n# whole line\ne: http://x.y/z\n",
    "a: ~\nb:\nc: TRUE\nd: Off\ne: 0x\nf: -3\ng: 1e3\nh: .5\n",
    "a: long text\n  that goes on\n  here\nb: 1\n",
    "- a\n- b: 1\n  c: 2\n- - x\n  - y\n",
    "\"quoted key\": 1\nkey with spaces: 2\n'other': 3\n",
]


def plain(value):
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("block", CASES)
def test_same_values_as_a_full_reader(block):
    yaml = pytest.importorskip("yaml")
    assert headblock.read(block) == plain(yaml.safe_load(block))


WORDS = st.text("abcxyz é'-:#\"", min_size=1, max_size=8)
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | WORDS,
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("abcdef", min_size=2, max_size=4).filter(lambda k: k not in ("off",)), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["title", "tags", "people", "x"]), VALUES, min_size=1), st.sampled_from([None, False]))
def test_written_values_read_back(value, style):
    yaml = pytest.importorskip("yaml")
    assert headblock.read(yaml.safe_dump(value, default_flow_style=style, allow_unicode=True, width=10_000)) == value


def test_variant_column(spark):
    rows = [("title: T\ntags: [a, b, 3]\nauthor:\n  name: Ann",), ("tags: one",), ("a: [never closed",), ("",), (None,)]
    df = spark.createDataFrame(rows, "block string").select(headblock.values(F.col("block")).alias("v"))
    got = df.select(
        F.try_variant_get("v", "$.author.name", "string").alias("name"), headblock.texts(F.col("v"), "$.tags").alias("tags"), F.col("v").isNull().alias("none")
    ).collect()
    assert [tuple(r) for r in got] == [("Ann", ["a", "b", "3"], False), (None, ["one"], False), (None, [], True), (None, [], True), (None, [], True)]


def test_long_blocks_are_linear(spark):
    block = "tags:\n" + "  - a tag of some length\n" * 50_000
    assert len(headblock.read(block)["tags"]) == 50_000
    assert headblock.read("a: " + "[" * 20_000 + "]" * 20_000)["a"] is not None
