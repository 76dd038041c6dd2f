"""Join trees: relations, equality edges from child to parent, and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvalidTree(ValueError):
    """Not one root, a cycle, an unreachable relation, or a column that is missing."""


class CountOverflow(ArithmeticError):
    """A count is over 2**63 - 1."""


class OutputTooLarge(RuntimeError):
    def __init__(self, exact_rows: int, limit: int):
        super().__init__(f"the join has {exact_rows} rows; the limit is {limit}")
        self.exact_rows, self.limit = exact_rows, limit


@dataclass(frozen=True)
class Edge:
    """child.child_columns = parent.parent_columns, pairwise; several columns make a composite key."""

    child: str
    parent: str
    child_columns: tuple[str, ...]
    parent_columns: tuple[str, ...]


def edge(child: str, parent: str, child_columns: str | Sequence[str], parent_columns: str | Sequence[str] | None = None) -> Edge:
    one = lambda c: (c,) if isinstance(c, str) else tuple(c)
    return Edge(child, parent, one(child_columns), one(parent_columns if parent_columns is not None else child_columns))


@dataclass
class JoinTree:
    """relations by name, in output order; output: columns that a relation gives to the result (all, if not named)."""

    relations: Mapping[str, DataFrame]
    edges: Sequence[Edge]
    root: str
    output: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = set(self.relations)
        if self.root not in names:
            raise InvalidTree(f"no relation {self.root}")
        parents: dict[str, str] = {}
        for e in self.edges:
            if e.child not in names or e.parent not in names:
                raise InvalidTree(f"{e} names an unknown relation")
            if e.child in parents or e.child == self.root:
                raise InvalidTree(f"{e.child} has two parents or is the root")
            if not e.child_columns or len(e.child_columns) != len(e.parent_columns):
                raise InvalidTree(f"{e} pairs unequal numbers of columns")
            for relation, columns in ((e.child, e.child_columns), (e.parent, e.parent_columns)):
                if missing := set(columns) - set(self.relations[relation].columns):
                    raise InvalidTree(f"{relation} lacks {sorted(missing)}")
            parents[e.child] = e.parent
        if len(self.breadth_first()) != len(names):
            raise InvalidTree("a relation can't be reached from the root")
        for relation, columns in self.output.items():
            if relation not in names or set(columns) - set(self.relations[relation].columns):
                raise InvalidTree(f"output of {relation} names unknown columns")

    def children(self, relation: str) -> list[Edge]:
        """In the order of the relations."""
        place = {r: i for i, r in enumerate(self.relations)}
        return sorted((e for e in self.edges if e.parent == relation), key=lambda e: place[e.child])

    def edge_to(self, child: str) -> Edge:
        return next(e for e in self.edges if e.child == child)

    def breadth_first(self) -> list[str]:
        out = [self.root]
        for r in out:
            out += [e.child for e in self.children(r) if e.child not in out]
        return out

    def columns_out(self, relation: str) -> list[str]:
        return list(self.output.get(relation, self.relations[relation].columns))

    def names_out(self) -> dict[tuple[str, str], str]:
        """Output names: a column's own where no other relation has it, else relation_column."""
        every = [c for r in self.relations for c in self.columns_out(r)]
        return {(r, c): c if every.count(c) == 1 else f"{r}_{c}" for r in self.relations for c in self.columns_out(r)}

    def qualified(self, relation: str) -> DataFrame:
        """The relation under names that no other relation has; only key and output columns."""
        needed = dict.fromkeys(self.columns_out(relation))
        for e in self.edges:
            needed |= dict.fromkeys(e.child_columns if e.child == relation else ()) | dict.fromkeys(e.parent_columns if e.parent == relation else ())
        return self.relations[relation].select(*[F.col(f"`{c}`").alias(f"{relation}__{c}") for c in needed])

    def finish(self, joined: DataFrame, extra: Sequence[str] = (), column_order: str = "relation") -> DataFrame:
        """The output columns of a join of qualified relations, by relation order or breadth first."""
        names = self.names_out()
        order = list(self.relations) if column_order == "relation" else self.breadth_first()
        return joined.select(*[F.col(f"{r}__{c}").alias(names[r, c]) for r in order for c in self.columns_out(r)], *extra)

    def with_relations(self, relations: Mapping[str, DataFrame]) -> JoinTree:
        return JoinTree({r: relations.get(r, df) for r, df in self.relations.items()}, self.edges, self.root, self.output)


def from_arrays(tables: Sequence[DataFrame], parent: Sequence[int], parent_column: Sequence[int], child_column: Sequence[int], widths: Sequence[int] | None = None) -> JoinTree:
    """A tree given as three arrays of relation and column numbers; -1 is the root's parent. widths: how many leading columns each relation gives out."""
    n = len(tables)
    if not n or len(parent) != n or len(parent_column) != n or len(child_column) != n or list(parent).count(-1) != 1:
        raise InvalidTree("the arrays don't describe one root and as many relations as tables")
    edges = []
    for c, p in enumerate(parent):
        if p == -1:
            continue
        if not 0 <= p < n or not 0 <= parent_column[c] < len(tables[p].columns) or not 0 <= child_column[c] < len(tables[c].columns):
            raise InvalidTree(f"relation {c} has no such parent or column")
        edges.append(Edge(f"R{c}", f"R{p}", (tables[c].columns[child_column[c]],), (tables[p].columns[parent_column[c]],)))
    output = {f"R{i}": t.columns[: widths[i]] for i, t in enumerate(tables)} if widths else {}
    return JoinTree({f"R{i}": t for i, t in enumerate(tables)}, edges, f"R{list(parent).index(-1)}", output)


def is_acyclic(schemas: Mapping[str, set[str]]) -> bool:
    """Whether a set of relations over shared attributes has a join tree: repeatedly drop attributes of one relation only and relations inside others."""
    left = [set(s) for s in schemas.values()]
    while True:
        before = [set(s) for s in left]
        for s in left:
            s -= {a for a in s if sum(a in t for t in left) == 1}
        for i, s in enumerate(left):
            if any(j != i and s <= t for j, t in enumerate(left)):
                left.pop(i)
                break
        if len(left) <= 1:
            return True
        if left == before:
            return False
