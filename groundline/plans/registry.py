"""The registered queries and the reference SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundline.plans import inputs
from groundline.plans.inputs import dealt, derive, given, given_tables, oracle_text
from groundline.session import meet_where_dealt, tune

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Given and derived tables of one data folder by name; ``known`` ones stand in for those of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, **known: DataFrame) -> None:
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self.tasks: int | None = None
        self._known: dict[str, DataFrame] = dict(known)
        self._shared: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            table = self._dealt if given_tables(name) == {"customer"} else self.given
            self._known[name] = derive(self.spark, name, table, self._shared)
        return self._known[name]

    def _dealt(self, name: str) -> DataFrame:
        key = f"{name} dealt"
        if key not in self._known:
            self._known[key] = dealt(self.given(name), self.given(name).columns[0])
        return self._known[key]

    def by_order(
        self, *steps: str, hashed: str | None = None, lines: bool = False, at_once: int | None = None
    ) -> Tables:
        """The same tables; all that is derived of an order is made where the order is dealt to (counts them, an action).

        Rows of one order then meet by its key without a further shuffle. ``steps`` are derived tables that
        others are derived from in turn; a join hashes the rows a task has of the one named ``hashed`` instead of sorting them. With
        ``lines``, the lines of an order are dealt to where it is, too. ``at_once`` orders, where given, make a task.
        """
        tasks = max(1, -(-self.given("orders").count() // (at_once or inputs.ORDERS_PER_TASK)))
        # What was derived here before was not made where orders are dealt to.
        read = {name: table for name, table in self._known.items() if name not in inputs.INPUTS}
        tables = Tables(self.spark, self.sf_dir, **read)
        tables.tasks = tasks
        meet_where_dealt(self.spark)
        tables._shared["order_facts"] = self.order_facts.repartition(tasks, "k")
        if lines:
            tables._known["lineitem"] = self.given("lineitem").repartition(tasks, "l_orderkey")
        for step in steps:
            made = getattr(tables, step)
            tables._shared[step] = made.hint("shuffle_hash") if step == hashed else made
        return tables

    def given(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = given(self.spark, self.sf_dir, name)
        return self._known[name]


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = oracle_text(sql)
        return build

    return register
