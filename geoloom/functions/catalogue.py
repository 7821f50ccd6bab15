"""The expression catalogue: filter texts of feature tables as Spark SQL.

Entries whose name or meaning differs from Spark's are temporary SQL functions, which the analyser inlines, so filters
that use them are still pushed down where their parts are. `spark_sql` puts a filter text's spellings that Spark reads
otherwise (names in double quotes, $-variables, a lenient to_date, measures called length) into Spark's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geometry import GEOM_TYPE

_STEPS = "sequence(2, greatest(size(r), 2))"
_FAR = "sqrt(pow(r[i - 1].x - r[i - 2].x, 2) + pow(r[i - 1].y - r[i - 2].y, 2))"
_TURN = "r[i - 2].x * r[i - 1].y - r[i - 1].x * r[i - 2].y"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (a, v) -> a + coalesce(v, 0D))"


def _over(kinds: str, of_part: str) -> str:
    """The sum of `of_part` (of p) over the parts of some kinds."""
    return _sum(f"transform(filter(g.parts, p -> p.kind IN ({kinds})), p -> {of_part})")


_LENGTHS = _sum(f"transform(p.rings, r -> {_sum(f'transform({_STEPS}, i -> {_FAR})')})")
_AREA = _sum(f"transform(p.rings, (r, k) -> CASE WHEN k = 0 THEN 1D ELSE -1D END * abs({_sum(f'transform({_STEPS}, i -> {_TURN})')}) / 2)")
_FIRST = "g.parts[0].rings[0][0]"


def _centre(axis: str) -> str:
    """One coordinate of the centroid: by area for polygons (outer rings), by length for lines, the mean for points."""

    def mean(weight: str, value: str, rings: str) -> str:
        total = lambda term: _sum(f"transform(g.parts, p -> {_sum(f'transform({rings}, r -> {_sum(f'transform({_STEPS}, i -> {term})')})')})")
        return f"{total(f'({weight}) * {value}')} / nullif({total(weight)}, 0D)"

    ends = f"(r[i - 2].{axis} + r[i - 1].{axis})"
    points = f"flatten(transform(g.parts, p -> transform(flatten(p.rings), q -> q.{axis})))"
    return (
        f"CASE WHEN g.gtype LIKE '%Polygon' THEN {mean(_TURN, f'{ends} / 3', 'slice(p.rings, 1, 1)')} "
        f"WHEN g.gtype LIKE '%LineString' THEN {mean(_FAR, f'{ends} / 2', 'p.rings')} ELSE {_sum(points)} / nullif(size({points}), 0) END"
    )


_CIRCLE = " , ".join(f"'{a}', {_FIRST}.{a} + d * {f}(2 * pi() * (i % 32) / 32)" for a, f in (("x", "cos"), ("y", "sin")))
_DISC = (
    "CASE WHEN g.gtype = 'Point' THEN named_struct('gtype', 'Polygon', 'srid', g.srid, 'has_z', false, 'parts', array(named_struct('kind', 'Polygon', "
    f"'rings', array(transform(sequence(0, 32), i -> named_struct({_CIRCLE}, 'z', CAST(NULL AS DOUBLE))))))) END"
)

# name(parameters) -> body, each a plain SQL expression.
FUNCTIONS = {
    "title(s STRING) RETURNS STRING": "initcap(s)",
    "regexp_match(s STRING, p STRING) RETURNS BOOLEAN": "regexp_like(s, p)",
    "natural_log(v DOUBLE) RETURNS DOUBLE": "ln(v)",
    "today() RETURNS DATE": "current_date()",
    "age(a TIMESTAMP, b TIMESTAMP) RETURNS INTERVAL DAY TO SECOND": "a - b",
    "to_int(v STRING) RETURNS INT": "try_cast(try_cast(v AS DOUBLE) AS INT)",
    "to_real(v STRING) RETURNS DOUBLE": "try_cast(v AS DOUBLE)",
    "to_text(v STRING) RETURNS STRING": "v",
    "to_string(v STRING) RETURNS STRING": "v",
    "as_date(v STRING) RETURNS DATE": "try_to_date(v)",
    "as_datetime(v STRING) RETURNS TIMESTAMP": "try_to_timestamp(v)",
    "to_datetime(v STRING) RETURNS TIMESTAMP": "try_to_timestamp(v)",
    f"area(g {GEOM_TYPE}) RETURNS DOUBLE": _over("'Polygon'", _AREA),
    f"perimeter(g {GEOM_TYPE}) RETURNS DOUBLE": _over("'Polygon'", _LENGTHS),
    f"line_length(g {GEOM_TYPE}) RETURNS DOUBLE": _over("'LineString'", _LENGTHS),
    f"num_geometries(g {GEOM_TYPE}) RETURNS INT": "size(g.parts)",
    f"point_x(g {GEOM_TYPE}) RETURNS DOUBLE": f"CASE WHEN g.gtype LIKE '%Point' THEN {_FIRST}.x END",
    f"point_y(g {GEOM_TYPE}) RETURNS DOUBLE": f"CASE WHEN g.gtype LIKE '%Point' THEN {_FIRST}.y END",
    f"centroid(g {GEOM_TYPE}) RETURNS STRUCT<x:DOUBLE,y:DOUBLE>": f"named_struct('x', {_centre('x')}, 'y', {_centre('y')})",
    # A polygon of 32 sides around a point; null for lines and polygons, which would need a geometry solver.
    f"buffer(g {GEOM_TYPE}, d DOUBLE) RETURNS {GEOM_TYPE}": _DISC,
}

# Variables of filter texts.
VARIABLES = {
    "$id": "fid", "$geometry": "geom", "$area": "area(geom)", "$perimeter": "perimeter(geom)", "$length": "line_length(geom)",
    "$x": "point_x(geom)", "$y": "point_y(geom)", "$currentfeature": "struct(*)",
}
RENAMED = {"to_date": "as_date"}
_TOKEN = re.compile(
    r"""attribute\s*\(\s*(?:\$currentfeature\s*,\s*)?'(?P<attribute>[^']+)'\s*\)   # a column by its name
      | length\s*\(\s*(?P<shape>\$geometry|geom)\s*\)                              # of a geometry, not of a text
      | (?P<text>'(?:[^']|'')*') | "(?P<name>(?:[^"]|"")*)" | (?P<variable>\$\w+) | (?P<call>[A-Za-z_]\w*)(?=\s*\()""",
    re.IGNORECASE | re.VERBOSE,
)


def spark_sql(expression: str) -> str:
    """A filter text in Spark's spelling. Unknown variables raise."""
    quoted = lambda name: "`" + name.replace('""', '"').replace("`", "``") + "`"

    def one(m: re.Match) -> str:
        if m["attribute"]:
            return quoted(m["attribute"])
        if m["shape"]:
            return "line_length(geom)"
        if m["text"]:
            return "'" + m["text"][1:-1].replace("''", r"\'") + "'"
        if m["name"] is not None:
            return quoted(m["name"])
        if m["variable"]:
            if m["variable"].lower() not in VARIABLES:
                raise ValueError(f"unknown variable {m['variable']}")
            return VARIABLES[m["variable"].lower()]
        return RENAMED.get(m["call"].lower(), m["call"])

    return _TOKEN.sub(one, expression)


def register(spark: SparkSession, *texts: str) -> None:
    """Make the functions that the texts use known to a session; all of them where no text is given."""
    used = {name.lower() for text in texts for name in re.findall(r"([A-Za-z_]\w*)\s*\(", spark_sql(text))}
    for signature, body in FUNCTIONS.items():
        if not texts or signature.split("(")[0] in used:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def condition(spark: SparkSession, expression: str) -> Column:
    """A filter text as a column; functions of the catalogue that it uses are made known first."""
    register(spark, expression)
    return F.expr(spark_sql(expression))
