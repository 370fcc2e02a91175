"""Filtered reads of collections: bounding box, CQL2 text, attribute equality, limit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import geometry as G

DEFAULT_LIMIT = 10

TOKEN = re.compile(r"""\s*(?:(?P<number>[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<text>'(?:[^']|'')*')|(?P<op><=|>=|<>|!=|[=<>(),])|(?P<name>"[^"]+"|[A-Za-z_][\w.]*))""", re.I)


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = TOKEN.match(text, at)
        if not match:
            raise ValueError(f"cannot read the filter at {text[at : at + 20]!r}")
        kind, word, at = match.lastgroup, match[match.lastgroup], match.end()
        if kind == "name" and word.upper() in ("POLYGON", "MULTIPOLYGON"):
            depth, begin = 0, at
            while at < len(text) and (depth or "(" not in text[begin:at]):
                depth += {"(": 1, ")": -1}.get(text[at], 0)
                at += 1
            kind, word = "wkt", word + text[begin:at]
        found.append((kind, word))
    return found


class Cql:
    """Compiles a CQL2 text into a Column, by recursive descent."""

    def __init__(self, text: str, columns: list[str]) -> None:
        self.rest, self.columns = tokens(text), columns

    def compile(self) -> Column:
        found = self._or()
        if self.rest:
            raise ValueError(f"unexpected {self.rest[0][1]!r}")
        return found

    def _word(self, *words: str) -> bool:
        """Take the next token if it is one of the words."""
        if self.rest and self.rest[0][0] in ("name", "op") and self.rest[0][1].upper() in words:
            self.rest.pop(0)
            return True
        return False

    def _expect(self, word: str) -> None:
        if not self._word(word):
            raise ValueError(f"{word} expected at {self.rest[:1]}")

    def _or(self) -> Column:
        found = self._and()
        while self._word("OR"):
            found = found | self._and()
        return found

    def _and(self) -> Column:
        found = self._not()
        while self._word("AND"):
            found = found & self._not()
        return found

    def _not(self) -> Column:
        if self._word("NOT"):
            return ~self._not()
        if self._word("("):
            found = self._or()
            self._expect(")")
            return found
        return self._test()

    def _value(self) -> Column:
        kind, text = self.rest.pop(0) if self.rest else ("end", "")
        if kind == "number":
            return F.lit(float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "text":
            return F.lit(text[1:-1].replace("''", "'"))
        if kind == "name":
            name = text.strip('"')
            if name not in self.columns:
                raise ValueError(f"no column {name}")
            return F.col(f"`{name}`")
        raise ValueError(f"a value is expected, not {text!r}")

    def _test(self) -> Column:
        if self._word("S_INTERSECTS"):
            self._expect("(")
            column = self._value()
            self._expect(",")
            kind, text = self.rest.pop(0)
            if kind != "wkt":
                raise ValueError("s_intersects takes a POLYGON or MULTIPOLYGON")
            self._expect(")")
            return intersects_literal(column, text)
        left = self._value()
        negated = self._word("NOT")
        if self._word("IN"):
            self._expect("(")
            found = [self._value()]
            while self._word(","):
                found.append(self._value())
            self._expect(")")
            test = left.isin(*found)
        elif self._word("BETWEEN"):
            low = self._value()
            self._expect("AND")
            test = left.between(low, self._value())
        elif self._word("LIKE"):
            test = F.like(left, self._value())
        elif self._word("IS"):
            negated = self._word("NOT")
            self._expect("NULL")
            test = left.isNull()
        else:
            return self._comparison(left)
        return ~test if negated else test

    def _comparison(self, left: Column) -> Column:
        for words, test in ((("=",), lambda a, b: a == b), (("<>", "!=", "NE"), lambda a, b: a != b), (("<=",), lambda a, b: a <= b), ((">=",), lambda a, b: a >= b), (("<",), lambda a, b: a < b), ((">",), lambda a, b: a > b)):
            if self._word(*words):
                return test(left, self._value())
        raise ValueError(f"a comparison is expected at {self.rest[:1]}")


def intersects_literal(column: Column, text: str) -> Column:
    """Whether polygons meet a literal one: boxes first, which prune in the JVM, and then exactly."""
    tests = None
    for rings in G.rings_of_wkt(text):
        shell, box = rings[0], G.bounds(column)
        xs, ys = [p[0] for p in shell], [p[1] for p in shell]
        near = (box["xmin"] <= max(xs)) & (box["xmax"] >= min(xs)) & (box["ymin"] <= max(ys)) & (box["ymax"] >= min(ys))
        literal = F.array(*[F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in r]) for r in rings])
        test = near & G.intersects(F.when(near, column), literal)
        tests = test if tests is None else tests | test
    return F.coalesce(tests, F.lit(False))


def items(
    df: DataFrame, filter: str | None = None, bbox: tuple[float, float, float, float] | None = None, limit: int | None = DEFAULT_LIMIT,
    order: list[str] | None = None, box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax"), **equal,
) -> DataFrame:
    """Rows of a collection by CQL2 text, bounding box and attributes; the first ``limit`` by order (None: all)."""
    if bbox:
        a, b, c, d = (F.col(x) for x in box)
        df = df.where((c >= bbox[0]) & (a <= bbox[2]) & (d >= bbox[1]) & (b <= bbox[3]))
    if filter:
        df = df.where(Cql(filter, df.columns).compile())
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def items_meeting(first: DataFrame, target: DataFrame, geometry: str, target_geometry: str, filter: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The two-step request: target's items that meet the geometry of first's first row, and pass the filter.

    One geometry travels, as the text of the second request's filter; no row in first gives no items.
    """
    found = first.select(G.wkt(F.col(geometry)).alias("text")).first()
    if found is None or found.text is None:
        return target.limit(0)
    test = f"s_intersects({target_geometry}, {found.text})"
    return items(target, filter=f"{test} AND ({filter})" if filter else test, limit=limit)
