"""The few spots in which Spark SQL and DuckDB's SQL differ, and operators written once for both.

An operator is a SQL text over named inputs.  Called with DataFrames it gives a
DataFrame whose plan Catalyst optimises as a whole; ``reference`` gives the text
that checks it in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class SparkDialect:
    name = "spark"
    #: A word boundary of ASCII word characters.
    boundary = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

    def literal(self, pattern: str) -> str:
        return 'r"' + pattern + '"' if "'" in pattern else "r'" + pattern + "'"

    def div(self, a: str, b: str) -> str:
        return f"({a} DIV {b})"

    def micros(self, ts: str) -> str:
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"

    def instant(self, micros: str) -> str:
        return f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"

    def join_set(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def join_array(self, x: str) -> str:
        return f"array_join({x}, ' ')"

    def like(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, {self.literal(pattern)})"

    def hits(self, text: str, pattern: str) -> str:
        return f"CAST(regexp_count({text}, {self.literal(pattern)}) AS BIGINT)"

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.literal(pattern)}, 0)"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.literal(pattern)}, {quoted(by.replace('@1', '$1'))})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def unnest(self, array: str, name: str) -> str:
        return f"LATERAL VIEW explode({array}) {name}_t AS {name}"

    def grams(self, array: str, n: int) -> str:
        return f"IF(size({array}) < {n}, CAST(array() AS ARRAY<STRING>), transform(sequence(1, size({array}) - {n - 1}), i -> array_join(slice({array}, CAST(i AS INT), {n}), ' ')))"

    def keep(self, array: str, condition: str) -> str:
        return f"filter({array}, x -> {condition})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0e0, (s, v) -> s + v)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def weekday_year(self, day: str) -> tuple[str, str]:
        return f"CAST(extract(YEAROFWEEK FROM {day}) AS BIGINT)", f"CAST(weekofyear({day}) AS BIGINT)"


class DuckDialect(SparkDialect):
    name = "duckdb"
    boundary = r"\b"

    def literal(self, pattern: str) -> str:
        return quoted(pattern)

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def instant(self, micros: str) -> str:
        return f"make_timestamp({micros})"

    def join_set(self, x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({x}))), ',')"

    def join_array(self, x: str) -> str:
        return f"array_to_string({x}, ' ')"

    def like(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.literal(pattern)})"

    def hits(self, text: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({text}, {self.literal(pattern)})) AS BIGINT)"

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.literal(pattern)})"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.literal(pattern)}, {quoted(by.replace('@1', chr(92) + '1'))}, 'g')"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def unnest(self, array: str, name: str) -> str:
        return f", UNNEST({array}) AS {name}_t({name})"

    def grams(self, array: str, n: int) -> str:
        return f"list_transform(range(1, len({array}) - {n - 2}), lambda i: array_to_string({array}[i:i + {n - 1}], ' '))"

    def keep(self, array: str, condition: str) -> str:
        return f"list_filter({array}, lambda x: {condition})"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def weekday_year(self, day: str) -> tuple[str, str]:
        return f"CAST(isoyear({day}) AS BIGINT)", f"CAST(weekofyear({day}) AS BIGINT)"


SPARK, DUCK = SparkDialect(), DuckDialect()
Text = Callable[[SparkDialect], str]


def with_inputs(text: str, inputs: dict[str, str]) -> str:
    """``text`` with its inputs as common table expressions before its own."""
    head = ", ".join(f"{name} AS ({body})" for name, body in inputs.items())
    text = text.strip()
    if not head:
        return text
    return f"WITH {head}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head} {text}"


def steps(text: str) -> tuple[list[tuple[str, str]], str]:
    """The common table expressions of ``WITH a AS (...), b AS (...) rest`` as (name, body), and the rest."""
    text, out = text.strip(), []
    if text[:5].upper() != "WITH ":
        return out, text
    at = 5
    while True:
        name, at = text[at : text.index("(", at)], text.index("(", at) + 1
        begin, depth, quote = at, 1, None
        while depth:
            c = text[at]
            if quote:
                quote = None if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            at += 1
        out.append((name.split()[0], text[begin : at - 1]))
        rest = text[at:].lstrip()
        if not rest.startswith(","):
            return out, rest
        at = len(text) - len(rest) + 1


class Operator:
    """A relational operator over named inputs."""

    def __init__(self, text: Text, *inputs: str, doc: str = "") -> None:
        self.text, self.inputs, self.__doc__ = text, inputs, doc

    def __call__(self, *frames: DataFrame, **named: DataFrame) -> DataFrame:
        """The plan of the text.

        Its common table expressions are analysed one by one, as views, so no plan that others share holds a CTE node.
        Views of the session with the same names are there again afterwards.
        """
        given = dict(zip(self.inputs, frames, strict=False)) | named
        if set(given) != set(self.inputs):
            raise TypeError(f"inputs are {', '.join(self.inputs)}")
        spark = next(iter(given.values())).sparkSession
        parts, text = steps(self.text(SPARK))
        names = {*given, *(name for name, _ in parts)}
        held = {name: spark.table(name) for name in names if spark.catalog.tableExists(name)}
        try:
            for name, frame in given.items():
                frame.createOrReplaceTempView(name)
            for name, body in parts:
                spark.sql(body).createOrReplaceTempView(name)
            return spark.sql(text)
        finally:
            for name in names:
                spark.catalog.dropTempView(name)
            for name, frame in held.items():
                frame.createOrReplaceTempView(name)

    def reference(self, **inputs: str) -> str:
        """DuckDB text; ``inputs`` gives the text of each input that is not a table itself."""
        return with_inputs(self.text(DUCK), inputs)


def operator(*inputs: str) -> Callable[[Text], Operator]:
    """Makes an operator of a function from a dialect to a SQL text."""
    return lambda text: Operator(text, *inputs, doc=(text.__doc__ or "").strip())


def rounded(x: str, digits: int = 4) -> str:
    """Half-up rounding that gives the same bits in both engines."""
    return f"floor(({x}) * 1e{digits} + 5e-1) / 1e{digits}"
