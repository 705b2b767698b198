"""Pajek network text read as a Spark job.

The file is split across tasks like any text file and read once: its lines are written as a table with
their position, ``(file, start of the file split, running line id inside it)``, which orders them as in
the file.  How a later job splits its input does not matter any more.  A second table adds the section
of each line; faults, vertices and edges derive from that.  A directory of part files in name order, as
Spark writes one, is read as one document.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from eddymap.graph import Graph, sum_parallel_edges
from eddymap.store import Store

# Fixed patterns of the format.
HEADER = r"^\*([a-zA-Z]+).*$"
VERTEX_HEADER = r"(?i)^\*Vertices[ \t]+([0-9]+)$"
VERTEX = r"^[ \t]*([0-9]+)[ \t]+\"(.*)\".*$"
EDGE = r"^[ \t]*([0-9]+)[ \t]+([0-9]+)[ \t]*$"
WEIGHTED_EDGE = r"^[ \t]*([0-9]+)[ \t]+([0-9]+)[ \t]+([0-9.eE\-+]+).*$"
PAIR_SECTIONS = ("edges", "arcs")
LIST_SECTIONS = ("edgeslist", "arcslist")
SECTIONS = ("vertices", *PAIR_SECTIONS, *LIST_SECTIONS)

# Fixed message texts.
UNKNOWN_SECTION = (
    "Pajek file format only accepts Vertices, Arcs, Edges, Arcslist, Edgeslist"
    " as section declarator: line {line}"
)
ONE_VERTICES_SECTION = "There must be one and only one vertices section"
BAD_NODE_NUMBER = "Cannot read node number: line {line}"
BAD_INDEX = "Vertex index must be within [1,{n}]: line {line}"
BAD_VERTEX = "Vertex definition error: line {line}"
BAD_EDGE = "Edge definition error: line {line}"
NEGATIVE_WEIGHT = "Edge weight must be non-negative: line {line}"
NO_SECTION = "Line {line} does not belong to any sections"
BAD_LIST = "Edge list definition error: line {line}"
DUPLICATE_VERTEX = "Vertex {id} is not unique!"
NO_FILE = "Cannot open file {path}"


class PajekError(ValueError):
    """The file breaks the format."""


POSITION = ("file", "block", "line_id")
SPLIT = ("file", "block")


def _position() -> Column:
    return F.struct(*POSITION)


def _at(row: Row) -> tuple[str, int, int]:
    return (row.file, row.block, row.line_id)


def _after(at: tuple[str, int, int]) -> Column:
    file, block, line_id = at
    return _position() > F.struct(
        F.lit(file).alias("file"), F.lit(block).cast("bigint").alias("block"),
        F.lit(line_id).cast("bigint").alias("line_id"),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty, non-comment lines with their position, decoded from Latin-1."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("text"),
    ).filter("text <> '' and not startswith(text, '%')").withColumn(
        "header", F.lower(F.nullif(F.regexp_extract("text", HEADER, 1), F.lit(""))))


def _sections(lines: DataFrame) -> DataFrame:
    """Add ``section``: the last header before each line.

    A window runs inside each file split, so no task holds more than one split.  What a split inherits
    is found among one row per split of its file, and one row per file.
    """
    seen = lines.withColumn("here", F.last("header", ignorenulls=True).over(
        Window.partitionBy(*SPLIT).orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)))
    of_split = lines.groupBy(*SPLIT).agg(
        F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_id"))).alias("header"))
    of_file = of_split.groupBy("file").agg(
        F.max_by("header", F.when(F.col("header").isNotNull(), F.col("block"))).alias("header"))
    before_file = of_file.select("file", F.last("header", ignorenulls=True).over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    carried = of_split.select(*SPLIT, F.last("header", ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return seen.filter("header IS NULL").join(carried, list(SPLIT)).join(before_file, "file").select(
        *POSITION, "text", F.coalesce("here", "carried", "earlier", F.lit("")).alias("section"))


def _headings(lines: DataFrame) -> tuple[int | None, dict]:
    """The declared node count, where it stands, and the faults among the headers.

    At most two headers of vertices and one unknown header reach the driver.
    """
    heads = lines.filter("header IS NOT NULL").orderBy(*POSITION)
    found = heads.filter("header = 'vertices'").withColumn(
        "digits", F.regexp_extract("text", VERTEX_HEADER, 1)).limit(2).collect()
    wrong = heads.filter(~F.col("header").isin(*SECTIONS)).limit(1).collect()
    faults = [(_at(row), UNKNOWN_SECTION) for row in wrong]
    count = where = None
    if found:
        where = _at(found[0])
        if found[0].digits:
            count = int(found[0].digits)
        else:
            faults.append((where, BAD_NODE_NUMBER))
    if len(found) > 1:
        faults.append((_at(found[1]), ONE_VERTICES_SECTION))
    return count, {"where": where, "faults": faults}


def _pair_fields() -> dict[str, Column]:
    plain = F.col("text").rlike(EDGE)
    weighted = F.col("text").rlike(WEIGHTED_EDGE)

    def part(group: int) -> Column:
        return F.when(plain, F.regexp_extract("text", EDGE, group)).when(
            weighted, F.regexp_extract("text", WEIGHTED_EDGE, group)
        )

    weight = F.when(plain, F.lit(1.0)).when(
        weighted, F.regexp_extract("text", WEIGHTED_EDGE, 3).try_cast("double")
    )
    return {
        "src": part(1).try_cast("bigint"), "dst": part(2).try_cast("bigint"), "weight": weight,
    }


def _targets() -> Column:
    return F.filter(F.split(F.col("text"), r"\s+"), lambda word: word != "")


def _fault(count: int | None, where: tuple[str, int, int] | None) -> Column:
    """Message for a line that breaks its section's rules, else NULL."""
    fields = _pair_fields()
    if where is None:
        in_force = F.lit(-1)
    else:
        in_force = F.when(_after(where), F.lit(-1 if count is None else count)).otherwise(-1)
    bad_index = F.replace(F.lit(BAD_INDEX), F.lit("{n}"), in_force.cast("string"))

    def inside(column: Column) -> Column:
        return (column >= 1) & (column <= in_force)

    vertex_id = F.regexp_extract("text", VERTEX, 1).try_cast("bigint")
    vertex_fault = F.when(~F.col("text").rlike(VERTEX) | vertex_id.isNull(), F.lit(BAD_VERTEX)).when(
        ~inside(vertex_id), bad_index
    )
    edge_fault = (
        F.when(fields["src"].isNull() | fields["dst"].isNull() | fields["weight"].isNull(), F.lit(BAD_EDGE))
        .when(~(inside(fields["src"]) & inside(fields["dst"])), bad_index)
        .when(fields["weight"] < 0, F.lit(NEGATIVE_WEIGHT))
    )
    words = _targets()
    list_fault = F.when(
        (F.size(words) > 1) & F.exists(words, lambda word: word.try_cast("bigint").isNull()),
        F.lit(BAD_LIST),
    )
    section = F.col("section")
    return (
        F.when(section == "", F.lit(NO_SECTION))
        .when(section == "vertices", vertex_fault)
        .when(section.isin(*PAIR_SECTIONS), edge_fault)
        .when(section.isin(*LIST_SECTIONS), list_fault)
    )


def _raise_first_fault(lines: DataFrame, body: DataFrame, count: int | None, found: dict) -> None:
    worst = (
        body.select(_position().alias("at"), _fault(count, found["where"]).alias("fault"))
        .filter("fault is not null")
        .agg(F.min(F.struct("at", "fault")).alias("first")).first().first
    )
    faults = list(found["faults"])
    if worst is not None:
        faults.append((_at(worst.at), worst.fault))
    if faults:
        at, message = min(faults)
        if "{line}" in message:
            message = message.replace("{line}", str(lines.filter(~_after(at)).count()))
        raise PajekError(message)
    if count is None:
        raise PajekError(ONE_VERTICES_SECTION)


def _duplicate_vertices(declared: DataFrame) -> DataFrame:
    """The declarations of an id behind its first."""
    first = declared.groupBy("id").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("times"))
    return declared.join(first.filter("times > 1"), "id").withColumn("at", _position()).filter("at > first")


def _raise_duplicate_vertex(declared: DataFrame) -> None:
    again = _duplicate_vertices(declared).agg(F.min_by("id", "at").alias("id")).first()
    if again.id is not None:
        raise PajekError(DUPLICATE_VERTEX.format(id=again.id))


def _declared(body: DataFrame) -> DataFrame:
    return body.filter("section = 'vertices'").select(
        *POSITION,
        F.regexp_extract("text", VERTEX, 1).try_cast("bigint").alias("id"),
        F.regexp_extract("text", VERTEX, 2).alias("name"),
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """The position of each line and ``line``, counted from 1 in the order of the document.

    Lines are counted inside each file split; a split's first number is the sum of the splits before it,
    taken over a table with one row per split.
    """
    of_split = lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("lines"))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    before = of_split.select(*SPLIT, F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*SPLIT).orderBy("line_id"))
    return (
        lines.select(*POSITION, place.alias("place")).join(before, list(SPLIT))
        .select(*POSITION, (F.col("before") + F.col("place")).alias("line"))
    )


def pajek_faults(spark: SparkSession, path: str, store: Store | None = None) -> DataFrame:
    """Every fault of a Pajek file at once: ``(line, fault)`` with the messages that reading raises.

    Lines count as the reader counts them, without comments and empty lines.  A missing vertices section
    has no line.  Nothing but the first two vertices headings and one unknown one reaches the driver.
    """
    store = store or Store(spark)
    raw = store.cut(_lines(spark, path), "pajek-lines").df
    count, found = _headings(raw)
    body = store.cut(_sections(raw), "pajek-sections").df
    heads, where = raw.filter("header IS NOT NULL"), found["where"]
    of_heading = F.when(~F.col("header").isin(*SECTIONS), F.lit(UNKNOWN_SECTION))
    if where is not None:
        vertices = F.col("header") == "vertices"
        of_heading = of_heading.when(vertices & _after(where), F.lit(ONE_VERTICES_SECTION))
        if count is None:
            of_heading = of_heading.when(vertices, F.lit(BAD_NODE_NUMBER))
    again = F.replace(F.lit(DUPLICATE_VERTEX), F.lit("{id}"), F.col("id").cast("string"))
    faults = (
        body.select(*POSITION, _fault(count, where).alias("fault"))
        .unionByName(heads.select(*POSITION, of_heading.alias("fault")))
        .unionByName(_duplicate_vertices(_declared(body)).select(*POSITION, again.alias("fault")))
        .filter("fault IS NOT NULL")
    )
    line = F.col("line").cast("string")
    placed = faults.join(numbered_lines(raw), list(POSITION)).select("line", F.replace("fault", F.lit("{line}"), line).alias("fault"))
    if where is not None:
        return placed
    return placed.unionByName(spark.createDataFrame([(None, ONE_VERTICES_SECTION)], "line bigint, fault string"))


def read_pajek(spark: SparkSession, path: str, store: Store | None = None) -> Graph:
    """Read a Pajek file.

    Both ``*Edges`` and ``*Arcs`` are directed; a missing weight is 1; list sections give one edge
    of weight 1 per target; parallel edges are summed; undeclared ids are named by their number.
    """
    store = store or Store(spark)
    try:
        raw = store.cut(_lines(spark, path), "pajek-lines")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise PajekError(NO_FILE.format(path=path)) from None
        raise
    count, found = _headings(raw.df)
    body = store.cut(_sections(raw.df), "pajek-sections").df
    _raise_first_fault(raw.df, body, count, found)
    raw.drop()

    declared = _declared(body)
    _raise_duplicate_vertex(declared)
    vertices = (
        spark.range(1, count + 1).join(declared.select("id", "name"), "id", "left")
        .select("id", F.coalesce("name", F.col("id").cast("string")).alias("name"),
                F.col("id").alias("module"))
    )
    fields = _pair_fields()
    pairs = body.filter(F.col("section").isin(*PAIR_SECTIONS)).select(
        *[column.alias(key) for key, column in fields.items()]
    )
    words = _targets()
    lists = (
        body.filter(F.col("section").isin(*LIST_SECTIONS)).select(words.alias("words"))
        .filter(F.size("words") > 1)
        .select(
            F.get("words", F.lit(0)).cast("bigint").alias("src"),
            F.explode(F.slice("words", F.lit(2), F.size("words") - 1)).alias("dst"),
            F.lit(1.0).alias("weight"),
        )
        .withColumn("dst", F.col("dst").cast("bigint"))
    )
    return Graph(vertices, sum_parallel_edges(pairs.unionByName(lists)))
