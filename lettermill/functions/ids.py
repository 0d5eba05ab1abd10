"""Identifier lists written as Python literals.

A text is cut into tokens, each token gets a kind of one letter, and a state machine is folded over the kinds: it says
whether the text is a literal, of what type, and which item of a list no integer can be made of. No pattern repeats a
group, so lists of any length are read without recursion. Lists and numbers in their plain form need no fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets may be nested so deep, as in Python's own parser.
MOST_DEEP = 200

_STRING = r"[bBrRuU]{0,2}(?:'[^'\\\n]*+'|\"[^\"\\\n]*+\")"
_STRINGS = rf"{_STRING}(?:[ \t\f]*+{_STRING})*+"  # written side by side; a possessive group is matched in a loop
_TOKEN = rf"{_STRINGS}|[0-9.][0-9_.]*+[eE][+-][0-9][0-9_]*+[jJ]?|[0-9A-Za-z_.]++|[ \t\f]++|[\r\n]++|[\s\S]"

#: Plain lists and numbers: digits alone, without leading zeros.
_PLAIN_LIST = r"^\[[0-9, \t]*+\]$"
_NOT_PLAIN = r",[ \t]*+[,]|\[[ \t]*+,|[0-9][ \t]++[0-9]|[^0-9]0[0-9]"
_PLAIN_NUMBER = r"^(?:0|[1-9][0-9]*+)$"

# Numbers; underscores are looked at apart.
_DECIMAL = r"^(?:0[0_]*+|[1-9][0-9_]*+)$"
_BASED = r"^0(?:[xX][0-9a-fA-F_]++|[oO][0-7_]++|[bB][01_]++)$"
_FRACTION = r"^(?:[0-9][0-9_]*+\.[0-9_]*+|\.[0-9][0-9_]*+)$"
_POWER = r"^(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)[eE][+-]?[0-9][0-9_]*+$"
_IMAGINARY = r"^(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9][0-9_]*+)?[jJ]$"
_MISPLACED = r"__|_$|_\.|\._|_[eEjJ]|_[+-]"
_OF_BASE = r"^0[xXoObB]"
# What is left of strings without their contents and the blanks between them.
_BYTES = r"^(?:(?:[bB][rR]?|[rR][bB])')++$"
_TEXT = r"^(?:[rRuU]?')++$"
_SEAM = r"['\"][ \t\r\n\f]*+[bBrRuU]{0,2}['\"]"
_WHOLE = r"['\"][ \t\r\f]*+[+-]?[0-9][0-9_]*+[ \t\r\f]*+['\"]$"


def _to_long(item: Column) -> Column:
    """One literal as a whole number; fractions are cut off towards zero."""
    quoted = F.regexp_replace(item, r"[bBrRuU]{1,2}(?=['\"])", "")
    bare = F.regexp_replace(F.when(item.rlike("['\"]"), quoted).otherwise(item), r"['\"\s()_]", "")
    sign = F.when(bare.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    number = F.regexp_extract(bare, r"^[+-]?0[xXoObB]([0-9a-fA-F]+)$", 1)
    based = F.lit(None).cast("string")
    for mark, base in (("[xX]", 16), ("[oO]", 8), ("[bB]", 2)):
        based = F.when(bare.rlike(rf"^[+-]?0{mark}"), F.conv(number, base, 10)).otherwise(based)
    return (
        F.when(bare == "True", F.lit(1).cast("bigint"))
        .when(bare == "False", F.lit(0).cast("bigint"))
        .when(bare.rlike(r"^[+-]?0[xXoObB]"), based.try_cast("bigint") * sign)
        .when(bare.rlike(r"^[+-]?[0-9]++$"), bare.try_cast("bigint"))
        .otherwise(bare.try_cast("double").try_cast("bigint"))
    )


def _whole(strings: Column) -> Column:
    """Whether strings, written side by side, are a whole number together."""
    together = F.regexp_replace(strings, _SEAM, "")
    return together.rlike(_WHOLE) & ~together.rlike(r"__|_[ \t\r\f'\"]")


def _kind(token: Column) -> Column:
    """One letter for a token.

    i real number, j imaginary, b truth value, n other constant, s and x text of a whole number and other text, y and z
    the same in bytes, S the name set, w blanks, l line ends, o what no literal holds; brackets and signs are themselves.
    """
    number = token.rlike(_DECIMAL) | token.rlike(_FRACTION) | token.rlike(_POWER)
    shape = F.regexp_replace(F.regexp_replace(token, "'[^']*+'|\"[^\"]*+\"", "'"), r"[ \t\f]", "")
    text = F.when(shape.rlike(_TEXT), F.when(_whole(token), "s").otherwise("x")).when(
        shape.rlike(_BYTES) & ~token.rlike(r"[^\x00-\x7F]"), F.when(_whole(token), "y").otherwise("z")
    )
    return (
        F.when(token.rlike(r"^[ \t\f]"), "w")
        .when(token.rlike(r"^[\r\n]"), "l")
        .when(token.isin(*"[](){},:+-"), token)
        .when(token.isin("'", '"'), "o")
        .when(token.rlike("['\"]"), F.coalesce(text, F.lit("o")))
        .when(token.rlike(_OF_BASE), F.when(token.rlike(_BASED) & ~token.rlike("__|_$"), "i").otherwise("o"))
        .when(token.rlike(_MISPLACED), "o")
        .when(number, "i")
        .when(token.rlike(_IMAGINARY), "j")
        .when(token.isin("True", "False"), "b")
        .when(token.isin("None", "..."), "n")
        .when(token == "set", "S")
        .otherwise("o")
    )


def _step(state: Column, t: Column) -> Column:
    """The state after a token of kind t.

    need: what may come next. 0, 1, 2 an element (first in its bracket; after a comma; after a colon), U a number after
    a sign, M a number in brackets after a sign and N their end, B an imaginary number, V what follows a value, Q the same
    after a string, C and D the brackets after set, ! nothing: the text is no literal.
    stack: a letter for each open bracket. T the text itself, t with a comma; [ a list; ( brackets, p with a comma;
    { a brace, s a set, k a dictionary before a key, v before a value; m brackets after a sign.
    kind: of the last value, c a collection but L a list, g a complex number, q strings side by side. fail: the kind of the
    first item of the list that is no whole number.
    """
    need, stack, kind, fail = state["need"], state["stack"], state["kind"], state["fail"]
    top, below = F.right(stack, F.lit(1)), F.substring(stack, F.lit(1), F.length(stack) - 1)

    def to(n, s=stack, k=kind, f=fail) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(n).alias("need"), lit(s).alias("stack"), lit(k).alias("kind"), lit(f).alias("fail"))

    bad = to("!", "T", "o", "")
    element, after = need.isin("0", "1", "2"), need.isin("V", "Q")
    # An item of the list that is the text itself, perhaps in brackets.
    judged = F.when((fail == "") & stack.rlike(r"^T\(*+\[$") & ~kind.isin("i", "b", "s", "y", "q", "Q"), kind).otherwise(fail)
    closes_list = (t == "]") & (top == "[")
    closes_round = (t == ")") & top.isin("(", "p")
    closes_brace = (t == "}") & (top.isin("{", "s", "v") & after | top.isin("{", "s", "k") & need.isin("0", "1"))
    value = F.when(after, judged).otherwise(fail)
    closed = (
        F.when(closes_list, to("V", below, "L", value))
        .when(closes_round & after & (top == "("), to("V", below))
        .when(closes_round & ((top == "p") | (need == "0")), to("V", below, "c"))
        .when(closes_brace, to("V", below, "c"))
        .otherwise(bad)
    )
    comma = (
        F.when(top == "T", to("1", F.concat(below, F.lit("t"))))
        .when(top == "(", to("1", F.concat(below, F.lit("p"))))
        .when(top == "{", to("1", F.concat(below, F.lit("s"))))
        .when(top == "v", to("1", F.concat(below, F.lit("k"))))
        .when(top.isin("t", "p", "s"), to("1"))
        .when(top == "[", to("1", f=judged))
        .otherwise(bad)
    )
    bytes_now, text_now = t.isin("y", "z"), t.isin("s", "x")
    joined = (text_now & kind.isin("s", "x", "q")) | (bytes_now & kind.isin("y", "z", "Q"))
    return (
        F.when(need == "!", state)
        .when((t == "w") | (t == "l") & ~stack.isin("T", "t"), state)
        .when(element & t.isin("i", "j", "b", "n"), to("V", k=t))
        .when(element & t.isin("s", "x", "y", "z"), to("Q", k=t))
        .when(element & t.isin("[", "(", "{"), F.when(F.length(stack) > MOST_DEEP, bad).otherwise(to("0", F.concat(stack, t))))
        .when(element & t.isin("+", "-"), to("U"))
        .when(element & (t == "S"), to("C"))
        .when((after | need.isin("0", "1")) & t.isin("]", ")", "}"), closed)
        .when(after & (t == ","), comma)
        .when(after & (t == ":") & top.isin("{", "k"), to("2", F.concat(below, F.lit("v"))))
        .when((need == "Q") & joined, to("Q", k=F.when(text_now, "q").otherwise("Q")))
        .when(after & t.isin("+", "-") & (kind == "i"), to("B"))
        .when((need == "U") & t.isin("i", "j"), to("V", k=t))
        .when((need == "U") & (t == "("), to("M", F.concat(stack, F.lit("m"))))
        .when((need == "M") & t.isin("i", "j"), to("N", k=t))
        .when((need == "N") & (t == ")"), to("V", below))
        .when((need == "B") & (t == "j"), to("V", k="g"))
        .when((need == "C") & (t == "("), to("D"))
        .when((need == "D") & (t == ")"), to("V", k="c"))
        .otherwise(bad)
    )


def _scanned(kinds: Column) -> Column:
    """The last state: what kind of value the text is (o: no literal; t: values with commas), and fail."""
    start = F.struct(*[F.lit(x).alias(n) for n, x in (("need", "0"), ("stack", "T"), ("kind", "o"), ("fail", ""))])

    def end(state: Column) -> Column:
        whole = state["need"].isin("V", "Q") & state["stack"].isin("T", "t") | (state["need"] == "1") & (state["stack"] == "t")
        kind = F.when(~whole, "o").when(state["stack"] == "t", "t").otherwise(state["kind"])
        return F.struct(kind.alias("kind"), state["fail"].alias("fail"))

    return F.when(F.array_contains(kinds, "o"), F.struct(F.lit("o").alias("kind"), F.lit("").alias("fail"))).otherwise(
        F.aggregate(kinds, start, _step, end)
    )


def parse_service_ids(raw: Column) -> Column:
    """Identifiers of a textual list as array<bigint>, never null.

    A Python list literal gives its numbers, a lone number a one-item array, any other literal an empty one, and so
    does a list whose first item that is no whole number is neither text nor bytes; text that is no literal gives every
    run of digits, and so does a list whose first such item is text. A number beyond bigint becomes a null item. Strings
    with a backslash or a line end, and comments, count as no literal.
    """
    empty = F.array().cast("array<bigint>")
    text = F.btrim(raw, F.lit(" \t\n\r\f\x0b"))
    runs = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda d: d.try_cast("bigint"))

    def numbers(t: Column) -> Column:
        """Items of a list without a failing item: what stands between its commas."""
        inner = F.regexp_extract(t, r"(?s)\[(.*+)", 1)
        parts = F.split(F.regexp_replace(inner, r"[\s)]*+\][\s)]*+$", ""), ",")
        return F.filter(parts, lambda p: ~p.rlike(r"^\s*+$"))

    def parsed(t: Column, kinds: Column) -> Column:
        """Through one-item arrays, so that tokens, state and items are worked out once."""
        return F.transform(F.array(_scanned(kinds)), lambda s: _read(t, s))[0]

    def _read(t: Column, state: Column) -> Column:
        listed = F.transform(
            F.array(numbers(t)),
            lambda items: F.when(F.exists(items, lambda x: x.rlike(_SEAM) & ~_whole(x)), runs(t)).otherwise(F.transform(items, _to_long)),
        )[0]
        return (
            F.when(state["kind"] == "o", runs(t))
            .when(state["kind"].isin("i", "b"), F.array(_to_long(t)))
            .when(state["kind"] != "L", empty)
            .when(state["fail"] == "", listed)
            .when(state["fail"].isin("x", "z"), runs(t))
            .otherwise(empty)
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    literal = F.transform(F.array(F.transform(tokens, _kind)), lambda kinds: parsed(text, kinds))[0]
    return (
        F.when(raw.isNull(), empty)
        .when(text.rlike(_PLAIN_NUMBER), F.array(text.try_cast("bigint")))
        .when(text.rlike(_PLAIN_LIST) & ~text.rlike(_NOT_PLAIN), runs(text))
        .otherwise(literal)
    )
