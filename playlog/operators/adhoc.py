"""Questions in SQL over a play log's tables, read only."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from playlog.model import PlayLog

TABLES = ("plays", "sessions", "stats", "gateway", "links", "albums", "artists", "tags", "loved")
#: Functions that run code of the driver's or the executors' class path.
REFUSED = re.compile(r"\b(reflect|java_method|try_reflect)\b", re.I)


def _leaves(plan) -> Iterator:
    """The leaves of an analysed plan and of all queries within it."""
    every = [plan, *(plan.subqueriesAll().apply(i) for i in range(plan.subqueriesAll().size()))]
    for p in every:
        found = p.collectLeaves()
        yield from (found.apply(i) for i in range(found.size()))


def query_sql(log: PlayLog, text: str, limit: int = 500, cell: int = 2000) -> DataFrame:
    """The first rows of one query over the library's tables, texts cut to cell characters; anything but a query is an error, and so are files and tables of the catalog.

    The text is parsed alone, as a query, so it cannot close a bracket that it did not open.  The views exist while it is analysed only.
    """
    if REFUSED.search(text):
        raise ValueError("this function is not open to queries")
    spark, files = log.spark, log.spark.conf.get("spark.sql.runSQLOnFiles")
    taken = [t for t in TABLES if t in {v.name for v in spark.catalog.listTables() if v.isTemporary}]
    if taken:
        raise ValueError(f"the session has its own views {taken}")
    try:
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        for table in TABLES:
            getattr(log, table).createTempView(table)
        try:
            spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
        except Exception as e:
            raise ValueError(f"not a query: {str(e)[:200]}") from None
        found = spark.sql(f"select * from (\n{text}\n) limit {int(limit)}")
        for leaf in _leaves(found._jdf.queryExecution().analyzed()):
            if leaf.nodeName().startswith(("LogicalRelation", "HiveTableRelation", "DataSourceV2", "Relation")) and (not hasattr(leaf, "catalogTable") or leaf.catalogTable().isDefined()):
                raise ValueError("only the library's tables are open to queries")
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", files)
        for table in TABLES:
            spark.catalog.dropTempView(table)
    return found.select(*[F.left(F.col(f"`{f.name}`"), F.lit(cell)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in found.schema]) if len(set(found.columns)) == len(found.columns) else found


def answer(log: PlayLog, text: str, limit: int = 500, cell: int = 2000, seconds: float = 10) -> list[Row]:
    """The rows of query_sql, or a TimeoutError after so many seconds; its jobs are cancelled then."""
    context, group = log.spark.sparkContext, f"question-{uuid.uuid4().hex}"
    found, late = query_sql(log, text, limit, cell), threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a question in SQL", interruptOnCancel=True)
    timer.start()
    try:
        return found.collect()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} s") from None
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def describe_schema(log: PlayLog) -> DataFrame:
    """(table, column, type, rows) of the library's tables; rows are counted."""
    out = None
    for name in TABLES:
        table = getattr(log, name)
        columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in table.schema])
        rows = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.explode(columns).alias("c"), "rows").select("table", "c.column", "c.type", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
