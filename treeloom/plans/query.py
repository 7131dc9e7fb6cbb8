"""The query interface: compiled XPath over node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans import grammar as G
from treeloom.plans.grammar import XPathError
from treeloom.plans.lift import Lift

__all__ = ["Variables", "XPath", "XPathError", "first", "select_node", "select_nodes", "sort"]


class Variables:
    """Typed variables. A name keeps the type it was added with; set() refuses values of another type."""

    _DEFAULTS = {G.BOOLEAN: False, G.NUMBER: float("nan"), G.STRING: "", G.NODES: None}

    def __init__(self, **values: object) -> None:
        self.types: dict[str, str] = {}
        self.values: dict[str, object] = {}
        for name, value in values.items():
            self.set(name, value)

    @staticmethod
    def type_of(value: object) -> str:
        if isinstance(value, bool):
            return G.BOOLEAN
        if isinstance(value, int | float):
            return G.NUMBER
        return G.STRING if isinstance(value, str) else G.NODES

    def add(self, name: str, kind: str) -> bool:
        """False if the name is there with another type."""
        if self.types.setdefault(name, kind) != kind:
            return False
        self.values.setdefault(name, self._DEFAULTS[kind])
        return True

    def set(self, name: str, value: object) -> bool:
        """False if the name is there with another type."""
        kind = self.type_of(value)
        if not self.add(name, kind):
            return False
        self.values[name] = float(value) if kind == G.NUMBER else value
        return True

    def find(self, name: str) -> str | None:
        """The type of a variable, None if there is none."""
        return self.types.get(name)

    def get(self, name: str, kind: str | None = None) -> object:
        """The value; the default of the kind that is asked for if the variable has another."""
        return self.values.get(name) if kind in (None, self.types.get(name)) else self._DEFAULTS[kind]


class XPath:
    """A compiled query. Raises XPathError, with message and offset, if it can't be compiled. Values of variables are read when it is evaluated."""

    def __init__(self, query: str, variables: Variables | None = None) -> None:
        self.query, self.variables = query, variables
        self.tree = G.compiled(query, variables.types if variables else None)

    @property
    def return_type(self) -> str:
        return self.tree.type

    def _lift(self, nodes: DataFrame) -> Lift:
        return Lift(nodes, dict(self.variables.values) if self.variables else None)

    def _scalar(self, nodes: DataFrame, contexts: DataFrame | None, kind: str) -> DataFrame:
        lift = self._lift(nodes)
        scope = lift.scope(contexts)
        value = {G.NUMBER: lift.number, G.STRING: lift.string, G.BOOLEAN: lift.boolean}[kind](self.tree, scope)
        rows = scope.df.withColumn("value_of", value)
        key = [F.col("d").alias("doc_id")] + ([F.col("pre").alias("context")] if contexts is not None else [])
        return rows.select(*key, F.col("value_of").alias("value"))

    def evaluate_boolean(self, nodes: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
        """(doc_id, value) for each document, or (doc_id, context, value) for each context (doc_id, pre)."""
        return self._scalar(nodes, contexts, G.BOOLEAN)

    def evaluate_number(self, nodes: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
        return self._scalar(nodes, contexts, G.NUMBER)

    def evaluate_string(self, nodes: DataFrame, contexts: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
        """With a capacity, value is cut to capacity - 1 characters and full_size tells the whole length and one."""
        rows = self._scalar(nodes, contexts, G.STRING)
        if capacity is None:
            return rows
        return rows.withColumn("full_size", F.length("value") + 1).withColumn("value", F.substring("value", 1, max(0, capacity - 1)))

    def evaluate_nodes(self, nodes: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
        """(doc_id, [context,] pre, kind, name, value, string_value) of the node set, each node once a context."""
        if self.tree.type != G.NODES:
            raise XPathError("Expression does not evaluate to node set", 0)
        lift = self._lift(nodes)
        rel = lift.nodes(self.tree, lift.scope(contexts)).df
        key = [F.col("d").alias("doc_id")] + ([F.element_at("it", 1).alias("context")] if contexts is not None else [])
        return rel.select(*key, "pre", "kind", "name", "value", F.col("sval").alias("string_value"))

    def evaluate_node(self, nodes: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
        """The first node of each context in document order."""
        return first(self.evaluate_nodes(nodes, contexts))


def first(found: DataFrame) -> DataFrame:
    """The first node in document order of each document, or of each context."""
    key = [c for c in ("doc_id", "context") if c in found.columns]
    rest = [c for c in found.columns if c not in key]
    return found.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("pre")).alias("n")).select(*key, "n.*")


def sort(found: DataFrame, reverse: bool = False) -> DataFrame:
    """In document order, or against it within each document."""
    return found.orderBy("doc_id", F.col("pre").desc() if reverse else F.col("pre").asc())


def select_nodes(nodes: DataFrame, query: str | XPath, contexts: DataFrame | None = None, variables: Variables | None = None) -> DataFrame:
    return (query if isinstance(query, XPath) else XPath(query, variables)).evaluate_nodes(nodes, contexts)


def select_node(nodes: DataFrame, query: str | XPath, contexts: DataFrame | None = None, variables: Variables | None = None) -> DataFrame:
    return (query if isinstance(query, XPath) else XPath(query, variables)).evaluate_node(nodes, contexts)


#: The older name.
select_single_node = select_node
