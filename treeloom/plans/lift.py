"""XPath trees to DataFrame plans.

Every evaluation context is a row (d, it, pre) of a relation: d is the document, it names the iteration (the path of
nodes that led to it, so it is exact and needs no counter), pre the context node. A step is one join of such a relation
with the node table, a predicate a filter of the joined rows, with windows only where it depends on positions. What an
expression needs of a node set (existence, first string, count, sum) is aggregated by (d, it) and joined back; filters
by existence are semi and anti joins. Everything joins on d, so a node table that is dealt by document isn't moved again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import numbers as N
from treeloom.functions import strings as S
from treeloom.plans import grammar as G
from treeloom.tables import merged

#: What a relation carries of its nodes; what isn't used is pruned from the plan.
NODE = ["kind", "name", "value", "sval", "parent", "size", "level", "ord", "nsib", "anc", "dup"]




@dataclass
class Relation:
    """df (d, it, pre, NODE); single: one row an iteration at most; roots: just the document nodes, with it = [0]."""

    df: DataFrame
    single: bool = False
    roots: bool = False


@dataclass
class Scope:
    """df (d, it, pre, pos, last, NODE, ...): one row an iteration; expressions attach what they need as further columns."""

    df: DataFrame
    roots: bool = False
    names: count = field(default_factory=count)

    def attach(self, values: DataFrame, default: Column | None) -> Column:
        """The column v of values (d, it, v), or default where there is none."""
        name = f"v{next(self.names)}"
        self.df = self.df.join(merged(values.withColumnRenamed("v", name)), ["d", "it"], "left")
        return F.coalesce(F.col(name), default) if default is not None else F.col(name)

    def exists(self, rows: DataFrame) -> Column:
        return self.attach(rows.select("d", "it").distinct().withColumn("v", F.lit(True)), F.lit(False))


#: Axes on which what is found of a set depends on its outermost node only.
SIDEWAYS = ("following", "preceding", "following-sibling", "preceding-sibling")


def _hidden(name: Column) -> Column:
    """Namespace declarations, which the attribute axis doesn't show."""
    return (name == "xmlns") | name.startswith("xmlns:")


def test_of(test: G.Test, axis: str) -> Column:
    """The node test on a candidate row."""
    kind, name = F.col("kind"), F.col("name")
    if axis == "attribute":
        shown = {"name": (name == test.value) & ~F.col("dup"), "any": F.lit(True), "node": F.lit(True), "prefix": name.startswith(test.value)}.get(test.what, F.lit(False))
        return (kind == "attribute") & ~_hidden(name) & shown
    element = kind == "element"
    plain = {"name": element & (name == test.value), "any": element, "prefix": element & name.startswith(test.value), "text": kind.isin("pcdata", "cdata"), "comment": kind == "comment", "processing-instruction": kind == "pi", "target": (kind == "pi") & (name == test.value)}
    if test.what == "node":
        return F.lit(True) if axis in ("self", "ancestor-or-self", "descendant-or-self") else kind != "attribute"
    return plain[test.what]


class Lift:
    """Plans over one node table. variables: name to value, a node set being a DataFrame (doc_id, pre)."""

    def __init__(self, nodes: DataFrame, variables: dict | None = None) -> None:
        self.all = nodes.select(F.col("doc_id").alias("d"), "pre", *NODE)
        self.variables = variables or {}

    # contexts

    def scope(self, contexts: DataFrame | None = None) -> Scope:
        """One iteration a document, or one a row of contexts (doc_id, pre)."""
        if contexts is None:
            rows = self.all.where("kind = 'document'").withColumn("it", F.array(F.lit(0)))
        else:
            rows = self.all.join(merged(contexts.select(F.col("doc_id").alias("d"), "pre").distinct()), ["d", "pre"]).withColumn("it", F.array("pre"))
        return Scope(rows.withColumns({"pos": F.lit(1.0), "last": F.lit(1.0)}), contexts is None)

    def _context(self, scope: Scope) -> Relation:
        return Relation(scope.df.select("d", "it", "pre", *NODE), True, scope.roots)

    def _empty(self) -> Relation:
        return Relation(self.all.where("false").withColumn("it", F.array(F.lit(0))).select("d", "it", "pre", *NODE), True)

    # node sets

    def nodes(self, tree: object, scope: Scope) -> Relation:
        """The relation of a node-set expression in each iteration of the scope, without repeated rows."""
        if isinstance(tree, G.Path):
            if tree.start == "context":
                rel = self._context(scope)
            elif tree.start == "root":
                rel = self._root(scope)
            else:
                rel = self.nodes(tree.start, scope)
            for step in tree.steps:
                rel = self.step(rel, step)
            return rel
        if isinstance(tree, G.Filter):
            rel = self.nodes(tree.of, scope)
            df = rel.df.withColumn("cpre", F.lit(-1))
            for p in tree.predicates:
                df = self._predicate(df, p, False)
            return Relation(df.drop("cpre"), rel.single)
        if isinstance(tree, G.Binary) and tree.op == "|":
            left, right = self.nodes(tree.left, scope), self.nodes(tree.right, scope)
            return Relation(self._once(left.df.unionByName(right.df)))
        if isinstance(tree, G.Variable):
            given = self.variables[tree.name].select(F.col("doc_id").alias("d"), "pre").distinct()
            return Relation(scope.df.select("d", "it").join(merged(given), "d").join(merged(self.all), ["d", "pre"]).select("d", "it", "pre", *NODE))
        if isinstance(tree, G.Call) and tree.name == "id":  # there are no declarations of identifiers
            return self._empty()
        raise TypeError(tree)

    def _root(self, scope: Scope) -> Relation:
        if scope.roots:
            return self._context(scope)
        return Relation(scope.df.select("d", "it").join(merged(self.all.where("kind = 'document'")), "d").select("d", "it", "pre", *NODE), True)

    @staticmethod
    def _once(df: DataFrame) -> DataFrame:
        return df.groupBy("d", "it", "pre").agg(*[F.first(c).alias(c) for c in NODE])

    def step(self, rel: Relation, step: G.Step) -> Relation:
        predicates = step.predicates
        ranked = bool(predicates) and isinstance(predicates[0], G.Literal) and predicates[0].type == G.NUMBER
        if ranked and step.axis.endswith("-sibling") and not rel.roots and predicates[0].value >= 1 and predicates[0].value == int(predicates[0].value):
            df = self._nth_sibling(rel, step.axis, step.test, int(predicates[0].value))
            predicates = predicates[1:]
        elif step.axis in SIDEWAYS and not rel.roots and not any(p.type == G.NUMBER or G.positional(p) for p in predicates):
            df = self._sideways(rel, step.axis, step.test)
            for p in predicates:
                df = self._predicate(df, p, False)
            return Relation(df.drop("cpre"))
        else:
            df = self._axis(rel, step.axis, step.test)
        for p in predicates:
            df = self._predicate(df, p, step.axis in G.REVERSE)
        df = df.drop("cpre")
        alone = rel.single or step.axis in ("child", "attribute", "self")
        return Relation(df if alone else self._once(df), rel.single and step.axis in ("self", "parent"))

    def _axis(self, rel: Relation, axis: str, test: G.Test) -> DataFrame:
        """(d, it, cpre, pre, NODE): the nodes on the axis of each context node that pass the test."""
        fits = test_of(test, axis)
        out = ["d", "it", "cpre", "pre", *NODE]
        if axis == "namespace" or (rel.roots and axis in ("attribute", "parent", "ancestor", "following", "preceding", "following-sibling", "preceding-sibling")):
            return self._empty().df.withColumn("cpre", F.lit(0)).select(*out)
        if axis == "self":
            own = fits if test.what == "node" else fits & (F.col("kind") != "attribute")
            return rel.df.where(own).withColumn("cpre", F.col("pre")).select(*out)
        if rel.roots:  # all nodes lie below their document: no join
            depth = {"child": F.col("level") == 1, "descendant": F.col("level") >= 1}.get(axis, F.lit(True))
            below = self.all.where(fits & depth & (F.col("kind") != "attribute"))
            return below.withColumns({"it": F.array(F.lit(0)), "cpre": F.lit(0)}).select(*out)
        left = rel.df.select("d", "it", F.col("pre").alias("cpre"), F.col("kind").alias("x_kind"), F.col("parent").alias("x_parent"), F.col("size").alias("x_size"), F.col("ord").alias("x_ord"), F.col("anc").alias("x_anc"))
        right = self.all.where(fits if axis in ("attribute", "ancestor-or-self", "descendant-or-self") else fits & (F.col("kind") != "attribute"))
        if axis in ("child", "attribute"):
            found = left.withColumn("parent", F.col("cpre")).join(merged(right), ["d", "parent"])
        elif axis == "parent":
            found = left.withColumn("pre", F.col("x_parent")).join(merged(right), ["d", "pre"])
        elif axis in ("ancestor", "ancestor-or-self"):
            above = F.col("x_anc") if axis == "ancestor" else F.concat("x_anc", F.array("cpre"))
            found = left.withColumn("pre", F.explode(above)).join(merged(right), ["d", "pre"])
        elif axis in ("descendant", "descendant-or-self"):
            if axis == "descendant":
                tagged = right.withColumn("cpre", F.explode("anc"))
            else:  # attributes are found from themselves only
                tagged = right.withColumn("cpre", F.explode(F.when(F.col("kind") == "attribute", F.array("pre")).otherwise(F.concat("anc", F.array("pre")))))
            found = left.join(merged(tagged), ["d", "cpre"])
        elif axis in ("following-sibling", "preceding-sibling"):
            later = F.col("ord") > F.col("x_ord") if axis == "following-sibling" else F.col("ord") < F.col("x_ord")
            found = left.where("x_kind <> 'attribute'").withColumn("parent", F.col("x_parent")).join(merged(right), ["d", "parent"]).where(later)
        elif axis == "following":
            found = left.join(merged(right), "d").where(F.col("pre") > F.col("cpre") + F.col("x_size"))
        else:
            begin = F.when(F.col("x_kind") == "attribute", F.col("x_parent")).otherwise(F.col("cpre"))
            found = left.join(merged(right), "d").where(F.col("pre") + F.col("size") < begin)
        return found.select(*out)

    def _sideways(self, rel: Relation, axis: str, test: G.Test) -> DataFrame:
        """The nodes beside, before or behind any of the context nodes of an iteration, each once: what counts is the
        outermost context alone, one for each iteration (and parent)."""
        rows = rel.df if axis in ("following", "preceding") else rel.df.where("kind <> 'attribute'")
        right = self.all.where(test_of(test, axis) & (F.col("kind") != "attribute"))
        if axis.endswith("-sibling"):
            edge = F.min("ord") if axis == "following-sibling" else F.max("ord")
            left = rows.groupBy("d", "it", "parent").agg(edge.alias("edge"))
            found = left.join(merged(right), ["d", "parent"]).where(F.col("ord") > F.col("edge") if axis == "following-sibling" else F.col("ord") < F.col("edge"))
        elif axis == "following":
            left = rows.groupBy("d", "it").agg(F.min(F.col("pre") + F.col("size")).alias("edge"))
            found = left.join(merged(right), "d").where(F.col("pre") > F.col("edge"))
        else:
            begin = F.when(F.col("kind") == "attribute", F.col("parent")).otherwise(F.col("pre"))
            left = rows.groupBy("d", "it").agg(F.max(begin).alias("edge"))
            found = left.join(merged(right), "d").where(F.col("pre") + F.col("size") < F.col("edge"))
        return found.withColumn("cpre", F.lit(-1)).select("d", "it", "cpre", "pre", *NODE)

    def _nth_sibling(self, rel: Relation, axis: str, test: G.Test, n: int) -> DataFrame:
        """The n-th node before or behind each context node among the siblings that pass the test, by running numbers: no pairs of siblings."""
        order = Window.partitionBy("d", "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.all.where("kind <> 'attribute'").withColumn("fit", F.coalesce(test_of(test, axis), F.lit(False)).cast("int"))
        rows = rows.withColumn("upto", F.sum("fit").over(order))
        left = rel.df.where("kind <> 'attribute'").select("d", "it", F.col("pre").alias("cpre"))
        places = rows.select("d", F.col("pre").alias("cpre"), "parent", (F.col("upto") + n if axis == "following-sibling" else F.col("upto") - F.col("fit") - (n - 1)).alias("upto"))
        return left.join(merged(places), ["d", "cpre"]).join(merged(rows.where("fit = 1")), ["d", "parent", "upto"]).select("d", "it", "cpre", "pre", *NODE)

    def _predicate(self, df: DataFrame, tree: object, reverse: bool) -> DataFrame:
        """The rows (d, it, cpre, pre, NODE) for which the predicate holds; positions are within (d, it, cpre)."""
        by = Window.partitionBy("d", "it", "cpre")
        ranked = by.orderBy(F.col("pre").desc() if reverse else F.col("pre").asc())
        if isinstance(tree, G.Literal) and tree.type == G.NUMBER:
            if tree.value != int(tree.value) or tree.value < 1:
                return df.where("false")
            return df.withColumn("pos", F.row_number().over(ranked)).where(F.col("pos") <= int(tree.value)).where(F.col("pos") == int(tree.value)).drop("pos")
        if G.positional(tree):
            df = df.withColumns({"pos": F.row_number().over(ranked).cast("double"), "last": F.count(F.lit(1)).over(by).cast("double")})
        else:
            df = df.withColumns({"pos": F.lit(1.0), "last": F.lit(1.0)})
        scope = Scope(df.withColumn("outer", F.col("it")).withColumn("it", F.concat("it", F.array("cpre", "pre"))))
        if tree.type == G.NUMBER:
            value = self.number(tree, scope)
            scope.df = scope.df.where(N.equal(value, F.col("pos")))
        else:
            self.keep(tree, scope)
        return scope.df.select("d", F.col("outer").alias("it"), "cpre", "pre", *NODE)

    def keep(self, tree: object, scope: Scope, wanted: bool = True) -> None:
        """Restrict the scope to the iterations where the expression, as a boolean, is as wanted; by semi and anti joins where it says what exists."""
        if isinstance(tree, G.Call) and tree.name == "not":
            return self.keep(tree.args[0], scope, not wanted)
        if isinstance(tree, G.Call) and tree.name == "boolean":
            return self.keep(tree.args[0], scope, wanted)
        if isinstance(tree, G.Binary) and tree.op == ("and" if wanted else "or"):
            self.keep(tree.left, scope, wanted)
            return self.keep(tree.right, scope, wanted)
        rows = self.nodes(tree, scope).df if tree.type == G.NODES else self._matching(tree, scope)
        if rows is not None:
            scope.df = scope.df.join(merged(rows.select("d", "it")), ["d", "it"], "left_semi" if wanted else "left_anti")
            return None
        value = self.boolean(tree, scope)
        scope.df = scope.df.where(value if wanted else ~value)
        return None

    def _matching(self, tree: object, scope: Scope) -> DataFrame | None:
        """The nodes that make a comparison of a node set with a constant, or the equality of two node sets, true; None for other expressions."""
        if not isinstance(tree, G.Binary) or tree.op not in ("=", "!=", "<", "<=", ">", ">="):
            return None
        op, left, right = tree.op, tree.left, tree.right
        if left.type != G.NODES:
            left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if left.type != G.NODES:
            return None
        if right.type == G.NODES:
            if op != "=":
                return None
            other = self.nodes(right, scope).df.select("d", "it", "sval")
            return self.nodes(left, scope).df.select("d", "it", "sval").join(merged(other), ["d", "it", "sval"], "left_semi")
        constant = self._constant(right)
        if constant is None or (isinstance(constant, bool) and op in ("=", "!=")):
            return None
        rows = self.nodes(left, scope).df
        if op in ("=", "!=") and isinstance(constant, str):
            return rows.where(F.col("sval") == constant if op == "=" else F.col("sval") != constant)
        value, own = F.lit(_as_number(constant)), N.to_number(F.col("sval"))
        return rows.where(N.equal(own, value) if op == "=" else N.unequal(own, value) if op == "!=" else N.compare(op, own, value))

    def _constant(self, tree: object) -> str | float | bool | None:
        if isinstance(tree, G.Literal):
            return tree.value
        if isinstance(tree, G.Variable) and tree.type != G.NODES:
            return self.variables[tree.name]
        if isinstance(tree, G.Negate) and isinstance(tree.of, G.Literal) and tree.of.type == G.NUMBER:
            return -tree.of.value
        if isinstance(tree, G.Call) and tree.name in ("true", "false"):
            return tree.name == "true"
        return None

    # values

    def value(self, tree: object, scope: Scope) -> Column:
        """The expression as a column of scope.df, in its own type."""
        return {G.NUMBER: self.number, G.STRING: self.string, G.BOOLEAN: self.boolean}[tree.type](tree, scope)

    def number(self, tree: object, scope: Scope) -> Column:
        if tree.type == G.BOOLEAN:
            return self.boolean(tree, scope).cast("double")
        if tree.type in (G.STRING, G.NODES):
            return N.to_number(self.string(tree, scope))
        constant = self._constant(tree)
        if constant is not None:
            return F.lit(_as_number(constant))
        if isinstance(tree, G.Negate):
            return -self.number(tree.of, scope)
        if isinstance(tree, G.Binary):
            a, b = self.number(tree.left, scope), self.number(tree.right, scope)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: N.divide(a, b), "mod": lambda: N.modulo(a, b)}[tree.op]()
        name, args = tree.name, tree.args
        if name in ("position", "last"):
            return F.col("pos" if name == "position" else "last")
        if name == "count":
            return scope.attach(self.nodes(args[0], scope).df.groupBy("d", "it").agg(F.count(F.lit(1)).cast("double").alias("v")), F.lit(0.0))
        if name == "sum":
            return scope.attach(self.nodes(args[0], scope).df.groupBy("d", "it").agg(F.sum(N.to_number(F.col("sval"))).alias("v")), F.lit(0.0))
        if name == "number":
            return self.number(args[0], scope) if args else N.to_number(F.col("sval"))
        if name == "string-length":
            return F.length(self.string(args[0], scope) if args else F.col("sval")).cast("double")
        return {"floor": N.floor, "ceiling": N.ceiling, "round": N.rounded}[name](self.number(args[0], scope))

    def string(self, tree: object, scope: Scope) -> Column:
        if tree.type == G.NODES:
            return self._first(tree, scope, F.col("sval"))
        if tree.type == G.NUMBER:
            return N.to_text(self.number(tree, scope))
        if tree.type == G.BOOLEAN:
            return self.boolean(tree, scope).cast("string")
        constant = self._constant(tree)
        if constant is not None:
            return F.lit(str(constant))
        name, args = tree.name, tree.args
        if name in ("name", "local-name", "namespace-uri"):
            if name == "namespace-uri":
                return self._namespace(args, scope)
            own = self._first(args[0], scope, F.col("name")) if args else F.col("name")
            return own if name == "name" else S.local_name(own)
        given = [self._argument(name, k, a, scope) for k, a in enumerate(args)]
        if name == "string":
            return given[0] if given else F.col("sval")
        if name == "normalize-space":
            return S.normalize_space(given[0] if given else F.col("sval"))
        if name == "translate" and all(isinstance(self._constant(a), str) for a in args[1:]):
            return F.translate(given[0], self._constant(args[1]), self._constant(args[2]))
        return {"concat": F.concat, "substring-before": S.before, "substring-after": S.after, "substring": S.part, "translate": _translate}[name](*given)

    def _argument(self, function: str, k: int, tree: object, scope: Scope) -> Column:
        return self.number(tree, scope) if function == "substring" and k else self.string(tree, scope)

    def _first(self, tree: object, scope: Scope, what: Column) -> Column:
        """what, of the first node in document order; '' for the empty set."""
        return scope.attach(self.nodes(tree, scope).df.groupBy("d", "it").agg(F.min_by(what, F.col("pre")).alias("v")), F.lit(""))

    def _namespace(self, args: tuple, scope: Scope) -> Column:
        """The value of the nearest declaration of the prefix at or above the node; '' without one, and for attributes without a prefix."""
        if args:
            found = self.nodes(args[0], scope).df
            first = found.groupBy("d", "it").agg(F.min_by(F.struct("pre", "kind", "name", "anc"), F.col("pre")).alias("n")).select("d", "it", "n.*")
        else:
            first = scope.df.select("d", "it", "pre", "kind", "name", "anc")
        wanted = F.when(F.instr("name", ":") > 0, F.concat(F.lit("xmlns:"), S.prefix(F.col("name")))).when(F.col("kind") == "attribute", F.lit(None)).otherwise("xmlns")
        owners = first.where(F.col("kind").isin("element", "attribute")).withColumn("name", wanted).withColumn("parent", F.explode(F.concat("anc", F.array("pre")))).select("d", "it", "name", "parent")
        declared = self.all.where((F.col("kind") == "attribute") & _hidden(F.col("name")) & ~F.col("dup")).select("d", "parent", "name", F.col("value").alias("uri"))
        return scope.attach(owners.join(merged(declared), ["d", "parent", "name"]).groupBy("d", "it").agg(F.max_by("uri", "parent").alias("v")), F.lit(""))

    def boolean(self, tree: object, scope: Scope) -> Column:
        if tree.type == G.NODES:
            return scope.exists(self.nodes(tree, scope).df)
        if tree.type == G.NUMBER:
            return N.truth(self.number(tree, scope))
        if tree.type == G.STRING:
            return F.length(self.string(tree, scope)) > 0
        constant = self._constant(tree)
        if constant is not None:
            return F.lit(bool(constant))
        if isinstance(tree, G.Binary):
            if tree.op in ("and", "or"):
                a, b = self.boolean(tree.left, scope), self.boolean(tree.right, scope)
                return a & b if tree.op == "and" else a | b
            rows = self._matching(tree, scope)
            return scope.exists(rows) if rows is not None else self._comparison(tree, scope)
        name, args = tree.name, tree.args
        if name == "boolean":
            return self.boolean(args[0], scope)
        if name == "not":
            return ~self.boolean(args[0], scope)
        if name == "lang":
            return self._lang(self.string(args[0], scope), scope)
        a, b = self.string(args[0], scope), self.string(args[1], scope)
        return F.startswith(a, b) if name == "starts-with" else F.contains(a, b)

    def _lang(self, wanted: Column, scope: Scope) -> Column:
        owners = scope.df.where("kind <> 'attribute'").withColumn("parent", F.explode(F.concat("anc", F.array("pre")))).select("d", "it", "parent")
        given = self.all.where("kind = 'attribute' and name = 'xml:lang' and not dup").select("d", "parent", F.col("value").alias("language"))
        own = S.lower_ascii(scope.attach(owners.join(merged(given), ["d", "parent"]).groupBy("d", "it").agg(F.max_by("language", "parent").alias("v")), None))
        wanted = S.lower_ascii(wanted)
        return F.coalesce((own == wanted) | F.startswith(own, F.concat(wanted, F.lit("-"))), F.lit(False))

    def _comparison(self, tree: G.Binary, scope: Scope) -> Column:
        """Comparisons that no join answers at once."""
        op, left, right = tree.op, tree.left, tree.right
        sets = (left.type == G.NODES) + (right.type == G.NODES)
        if not sets:
            if op not in ("=", "!="):
                return N.compare(op, self.number(left, scope), self.number(right, scope))
            if G.BOOLEAN in (left.type, right.type):
                a, b = self.boolean(left, scope), self.boolean(right, scope)
            elif G.NUMBER in (left.type, right.type):
                a, b = self.number(left, scope), self.number(right, scope)
                return N.equal(a, b) if op == "=" else N.unequal(a, b)
            else:
                a, b = self.string(left, scope), self.string(right, scope)
            return a == b if op == "=" else a != b
        if sets == 2:
            return self._two_sets(op, left, right, scope)
        if left.type != G.NODES:
            left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if op in ("=", "!="):
            if right.type == G.BOOLEAN:
                a, b = self.boolean(left, scope), self.boolean(right, scope)
                return a == b if op == "=" else a != b
            numeric = right.type == G.NUMBER
            own = N.to_number(F.col("sval")) if numeric else F.col("sval")
            values = scope.attach(self.nodes(left, scope).df.groupBy("d", "it").agg(F.collect_set(own).alias("v")), F.array().cast("array<double>" if numeric else "array<string>"))
            other = self.number(right, scope) if numeric else self.string(right, scope)
            test = (N.equal if op == "=" else N.unequal) if numeric else (lambda a, b: a == b if op == "=" else a != b)
            return F.exists(values, lambda x: test(x, other))
        low, high = self._extremes(left, scope)
        other = self.number(right, scope)
        return F.coalesce(N.compare(op, low if op in ("<", "<=") else high, other), F.lit(False))

    def _extremes(self, tree: object, scope: Scope) -> tuple[Column, Column]:
        """Least and greatest number of a node set, null without numbers."""
        own = N.to_number(F.col("sval"))
        number = F.when(~F.isnan(own), own)
        values = self.nodes(tree, scope).df.groupBy("d", "it").agg(F.struct(F.min(number).alias("low"), F.max(number).alias("high")).alias("v"))
        both = scope.attach(values, None)
        return both["low"], both["high"]

    def _two_sets(self, op: str, left: object, right: object, scope: Scope) -> Column:
        if op == "!=":  # some pair differs unless all values of both are one and the same
            ends = lambda t: scope.attach(self.nodes(t, scope).df.groupBy("d", "it").agg(F.struct(F.min("sval").alias("low"), F.max("sval").alias("high")).alias("v")), None)
            a, b = ends(left), ends(right)
            return F.coalesce((a["low"] != b["high"]) | (a["high"] != b["low"]), F.lit(False))
        (a_low, a_high), (b_low, b_high) = self._extremes(left, scope), self._extremes(right, scope)
        return F.coalesce(N.compare(op, a_low, b_high) if op in ("<", "<=") else N.compare(op, a_high, b_low), F.lit(False))


def _translate(s: Column, old: Column, new: Column) -> Column:
    """translate() with arguments that aren't constant: the first of repeated characters counts, those without a partner go."""
    characters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    source, target = characters(old), characters(new)

    def mapped(c: Column) -> Column:
        at = F.array_position(source, c)
        return F.when(at == 0, c).otherwise(F.coalesce(F.try_element_at(target, F.when(at > 0, at).otherwise(F.lit(1)).cast("int")), F.lit("")))

    return F.array_join(F.transform(characters(s), mapped), "")


def _as_number(constant: str | float | bool) -> float:
    if isinstance(constant, str):
        import re

        return float(constant.strip(" \t\r\n")) if re.fullmatch(r"[ \t\r\n]*-?([0-9]+([.][0-9]*)?|[.][0-9]+)[ \t\r\n]*", constant) else float("nan")
    return float(constant)
