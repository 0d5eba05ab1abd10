import ast
import re

import pytest
from pyspark.sql import functions as F

from lettermill.functions.ids import parse_service_ids
from tests.helpers import evaluated, one_column

VALUES = [
    "[1, 2]", "[1.9, -3]", "['4','5']", "[]", "[ ]", "[1,]", "[1, 2.5, '3', True]", "['-4']", "['4.5']", "[007]", "[-007]",
    "5", "5.7", "-3", "+8", "1e3", ".5", "5.", "007", "00", "(5)", "- 3", "[- 3]",
    "(1,2)", "12, 13", "(1,)", "()", "'12'", '"12"', "{1: 2}", "{1, 2}", "{}", "None", "set()",
    "True", "False", "nan", "abc 7 x-8", "id 5; 9", "", "   ", "12; 13", "[1, 2", "1,2]", "[1 2]", "[a, 1]", "5d",
    "[1j]", "[1, 2+3j]", "1+2j", "2j", "3 - 4", "[b'12', 1]", "b'12'", "[b'x', 1]", "['1' '2']", "['1 ' '2']", "['1', '2' 'x']", "'a' 'b'",
    "['1' b'2']", "[u'5', r'6']", "[ub'5']", "[[1], 2]", "[1, (2, {3: [4]})]", "[1, (2, {3: [4]}]", "([1, 2])", "(([7]))", "[(1), ((2))]", "[(1, 2)]",
    "{1: [2, 3], 4: (5,)}", "{1, (2, 3)}", "{1: 2, 3}", "{1, 2: 3}", "[set()]", "set() ", "set", "[-(3)]", "[--3]", "[-True]", "-True", "[+1, - 2]",
    "[1,\n 2]", "1,\n2", "[1, 'a', None]", "['a', None]", "[1__0]", "[1_0, '2_0']", "['2__0']", "[0_0, 00]", "1_", "[1.5e3, 2E-1]", "[1e]",
    "[...]", "[1, 2, 'x, 3']", "[1, '2]", "['é'']", "[,]", "(,)", "{,}", "[1,,2]", "[1 ,]", "[1]]", "((1)", "[)", "[" * 150 + "]" * 150, "[" * 250 + "1" + "]" * 250,
    "  [1, 2]  ", "9223372036854775807", "[1, 'x9']", "x", "-", "[1;2]", "3-4", "[1, 2] [3]",
]


def python_result(text):
    try:
        parsed = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return [int(x) for x in re.findall(r"\d+", text)]
    if isinstance(parsed, list):
        try:
            return [int(x) for x in parsed]
        except ValueError:
            return [int(x) for x in re.findall(r"\d+", text)]
        except TypeError:  # an item that is neither number nor text: our choice
            return []
    return [int(parsed)] if isinstance(parsed, (int, float)) else []


@pytest.fixture(scope="module")
def parsed(spark):
    df = one_column(spark, VALUES)
    return dict(zip(VALUES, evaluated(df, parse_service_ids(F.col("t")))))


@pytest.mark.parametrize("text", VALUES)
def test_like_a_python_literal(parsed, text):
    assert parsed[text] == python_result(text)


@pytest.mark.parametrize(
    "form, found",
    [
        ("[{}]", 1), ("[{},]", 1), ("['0', {}]", 1), ("{}, 1", 0), ("({})", 0), ("{{{}}}", 0), ("{{0: [{}]}}", 0), ("[{}, None]", 0),
        ("x {}", 1), ("[{}", 1), ("[[{}], 0]", 0),
    ],
)
def test_lists_of_any_length(spark, form, found):
    """A hundred thousand ids in each form, plain and as quoted, signed and based numbers."""
    plain = [str(i) for i in range(1, 100_001)]
    mixed = [(str(i), f"'{i}'", f"+{i}", hex(i), f"({i})")[i % 5] for i in range(1, 100_001)]
    texts = [form.format(", ".join(plain)), form.format(", ".join(mixed)) if "x" not in form and form != "[{}" else form.format(",".join(plain))]
    for got in evaluated(one_column(spark, texts), parse_service_ids(F.col("t"))):
        want = [i for i in range(1, 100_001)] if found else []
        assert [x for x in got if x] == want


def test_a_million_strings_side_by_side(spark):
    text = "[" + "'1' " * 1_000_000 + "]"
    assert evaluated(one_column(spark, [text]), F.size(parse_service_ids(F.col("t")))) == [1]


def test_null_and_unparsable_lists(spark):
    df = one_column(spark, [None, "[None]", "[[1]]", "1e999", "99999999999999999999"])
    assert evaluated(df, parse_service_ids(F.col("t"))) == [[], [], [], [None], [None]]
