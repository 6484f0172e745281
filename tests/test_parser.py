import pytest

from pipewright.lang import parse_query, parse_script
from pipewright.lang.lexer import QuerySyntaxError, tokenize, unquote
from pipewright.lang.parser import span_micros
from pipewright.lang.tree import Bin, Call, Function, Lit, Name, Query


def test_strings():
    assert unquote(r'"a\n\"b\""') == 'a\n"b"'
    assert unquote('@"a\\b""c"') == 'a\\b"c'
    assert parse_query("print 'a' \"b\"").source.exprs[0] == Lit("ab", "string")


def test_spans():
    assert span_micros("1.02:03:04.5") == ((26 * 60 + 3) * 60 + 4) * 1_000_000 + 500_000
    assert span_micros("-00:00:01") == -1_000_000
    assert span_micros("90m") == 90 * 60 * 1_000_000
    assert span_micros("x") is None


def test_precedence():
    q = parse_query("T | where a or b and c == 1 + 2 * 3")
    p = q.ops[0].predicate
    assert isinstance(p, Bin) and p.op == "or" and p.right.op == "and"
    assert p.right.right.right.op == "+" and p.right.right.right.right.op == "*"


def test_lets_and_functions():
    s = parse_script("let a = 1; let f = (x:int, T:(*), y:long=3) { let z = 2; x + y + z }; T | where a == f(1)")
    assert s.lets[0].value == Lit(1, "long")
    assert isinstance(s.lets[1].value, Function) and len(s.lets[1].value.statements) == 1
    assert isinstance(s.query, Query)


def test_typed_literals():
    q = parse_query("T | where t > datetime(2024-01-01 10:00) and d == dynamic({\"a\": [1, 2]}) and x == int(null) and y == real(nan)")
    text = str(q)
    assert "2024-01-01 10:00" in text and "{'a': [1, 2]}" in text and "nan" in text


def test_dashed_operators_and_minus():
    q = parse_query("T | extend c = a-b | project-away a, b")
    assert [o.kind for o in q.ops] == ["extend", "project-away"]


def test_call_and_name():
    q = parse_query("f(1, x=2) | take 3")
    assert isinstance(q.source, Call) and isinstance(parse_query("T").source, Name)


@pytest.mark.parametrize("text", ["T | nonsense x", "T | where (a", "T | where a ==", "datatable(a:int)[1", "T | project a b"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse_script(text)


def test_comments_are_space():
    assert [t.text for t in tokenize("a // b\n + c")] == ["a", "+", "c", ""]
