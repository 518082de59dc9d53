from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.functions import lattice
from tidelake.functions.hashing import tag_hash
from tidelake.functions.naming import distinct_columns, field_column, identifier, tag_column
from tidelake.functions.time import parse_width
from tidelake.sources.lineproto import LineError, parse_line, split


@pytest.mark.parametrize(
    ("line", "fields"),
    [
        ("cpu value=42", {"value": 42.0}),
        ("cpu,host=a,region=us value=1.5,count=3i,ok=true 1700000000000000000", {"value": 1.5, "count": 3, "ok": True}),
        (r'm s="hello \"world\""', {"s": 'hello "world"'}),
        ("m a=10i,b=20u", {"a": 10, "b": 20}),
        ('m s="hello, world",n=1i', {"s": "hello, world", "n": 1}),
        ("m v=nan,w=1_0", {"w": 10.0}),
        ("m v=T,w=F", {"v": True, "w": False}),
        ("m v=1,v=2", {"v": 2.0}),
        ('m s="a=b"', {"s": "a=b"}),
    ],
)
def test_fields(line, fields):
    got = parse_line(line)[2]
    assert {k: got[k] for k in fields} == fields


def test_head_and_time():
    m, tags, _, time = parse_line(r"weird\ name,k=a\,b,empty= v=1 1700000000000", "ms")
    assert (m, tags) == ("weird name", {"k": "a,b", "empty": ""})
    assert time == datetime.fromtimestamp(1_700_000_000, UTC)


@pytest.mark.parametrize("line", ["cpu,host=a", "cpu,host=a ", "m v=", "m =1", "m,=a v=1", ",a=b v=1", "m v=1.5i", "m v=hi", "m v=i", "m v=1 x", "m,a v=1", "m  v=1", f"m v={1 << 63}i", "m v=1 99999999999999999999999", "# c", ""])
def test_errors(line):
    with pytest.raises(LineError):
        parse_line(line)


def test_quote_after_an_escaped_backslash_does_not_close():
    assert split(r'a="x\\",b=1', ",", True) == [r'a="x\\",b=1']


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab,= "\\', max_size=12), st.text(alphabet='ab,= "\\', max_size=12).filter(lambda s: not s.endswith("\\")))
def test_escaped_text_comes_back(tag, value):
    esc = lambda s: "".join("\\" + c if c in ",= \\" else c for c in s)
    if '"' in tag or not tag:
        return
    line = f'm,{esc(tag)}={esc(tag)} s="' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if '\\"' in value:
        return  # a quote after a backslash is told apart only by the character before it
    _, tags, fields, _ = parse_line(line)
    assert tags == {tag: tag} and fields == {"s": value}


def test_tag_hash():
    assert tag_hash({}) == 0
    assert tag_hash({"host": "a", "region": "us"}) == tag_hash({"region": "us", "host": "a"}) == 4678696672566170412
    assert all(0 <= tag_hash({"k": str(i)}) < 1 << 63 for i in range(200))


def test_names():
    assert identifier("Cpu Usage!") == "cpu_usage_" and identifier("123abc") == "_123abc" and len(identifier("a" * 100)) == 63
    assert (tag_column("Host"), field_column("Value")) == ("t_host", "f_value")
    with pytest.raises(ValueError):
        distinct_columns(["a b", "a_b"], tag_column)


@pytest.mark.parametrize(("types", "to"), [(["boolean", "bigint"], "bigint"), (["boolean", "double"], "double"), (["bigint", "double"], "double"), (["double", "string"], "string"), (["boolean", "boolean", "bigint", "double", "string", "bigint"], "string")])
def test_lattice(types, to):
    assert lattice.widest(types) == to


@pytest.mark.parametrize(("value", "to", "out"), [(None, "bigint", None), (True, "bigint", 1), ("3", "bigint", 3), (2.9, "bigint", 2), (3, "double", 3.0), ("true", "boolean", True), (0, "boolean", False), (123, "string", "123"), (True, "string", "True"), (1.0, "string", "1.0")])
def test_coerce(value, to, out):
    assert lattice.coerce(value, to) == out


def test_infer():
    assert [lattice.infer(v) for v in (True, 1, 1.0, "x")] == list(lattice.TYPES)


@pytest.mark.parametrize("bad", ["", "1", "x minutes", "1 month 2 days", "0 seconds"])
def test_widths(bad):
    with pytest.raises(ValueError):
        parse_width(bad)
    assert parse_width("90m") == (0, 5_400_000_000) and parse_width("5 months") == (5, 0)
