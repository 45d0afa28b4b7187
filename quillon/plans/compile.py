"""Query tree to one lazy DataFrame.

Every scanned column gets an id that is unique in the tree, so self joins and
dotted names are never ambiguous to Spark; the query's names live beside the
DataFrame and are put on once, at the root. Nothing is scheduled here: joins,
their order and strategy, pushed filters and pruned columns are Catalyst's. Three
things it cannot know are settled here: which columns a source that Catalyst
cannot prune has to decode, whether a product that no predicate joins is meant,
and that its sides are joined within themselves first (Catalyst puts joins one
after the other, and would multiply a table before what reduces it) and dealt
over many tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.compare import as_text, comparison, comparison_with_literal, loose_comparison
from quillon.operators.ir import Cross, Filter, Predicate, Project, Query, Ref, Scan, Sort
from quillon.plans.resolve import Field, resolve
from quillon.sources.catalog import Catalog


#: A product that no predicate joins may have so many pairs, unless told otherwise.
MOST_PAIRS = 1_000_000_000
#: Where both sides of a product have so many rows, dealing these over the tasks costs little beside their pairs.
DEALT_ROWS = 1000
#: Ways to join that a caller may ask for; without one Catalyst chooses.
JOINS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")


class CrossTooLarge(ValueError):
    """A product of two inputs that no predicate joins, with more pairs than allowed."""


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _condition(p: Predicate, fields: list[Field], loose: bool) -> Column:
    left = resolve(p.column, fields)
    if loose:
        right = resolve(p.value.name, fields) if isinstance(p.value, Ref) else None
        return loose_comparison(p.op, as_text(left.column, left.kind), as_text(right.column, right.kind) if right else F.lit(str(p.value)))
    if isinstance(p.value, Ref):
        right = resolve(p.value.name, fields)
        return comparison(p.op, left.column, left.kind, right.column, right.kind)
    return comparison_with_literal(p.op, left.column, left.kind, p.value)


def _last(name: str) -> str:
    return name.rpartition(".")[2]


def _named_columns(q: Query) -> set[str]:
    """The last parts of all names in predicates, keys and projections."""
    if isinstance(q, Scan):
        return set()
    if isinstance(q, Cross):
        return _named_columns(q.left) | _named_columns(q.right)
    if isinstance(q, Filter):
        own = {p.column for p in q.predicates} | {p.value.name for p in q.predicates if isinstance(p.value, Ref)}
    else:
        own = {src for src, _ in q.columns} if isinstance(q, Project) else {k.column for k in q.keys}
    return {_last(c) for c in own} | _named_columns(q.child)


def _all_projected(q: Query) -> bool:
    """Whether every scan stands under a Project, so that columns without a name in the query are not asked for."""
    if isinstance(q, Project):
        return True
    if isinstance(q, Cross):
        return _all_projected(q.left) and _all_projected(q.right)
    return not isinstance(q, Scan) and _all_projected(q.child)


#: A DataFrame and the numbers of the scans in it, or a condition and those it reads.
_Part = tuple[set[int], DataFrame]
_Condition = tuple[set[int], Column]


def _scans_of(parts: list[_Part]) -> set[int]:
    return set().union(*(scans for scans, _ in parts))


class _Compiler:
    """Filter, Project and Cross only collect: parts to multiply, conditions on them, and fields. They become a DataFrame at a Sort and at the root."""

    def __init__(self, catalog: Catalog, columns: set[str] | None, join: str | None, most_pairs: int | None, loose: bool):
        self._catalog, self._columns, self._join, self._most_pairs, self._loose, self._next = catalog, columns, join, most_pairs, loose, count()
        self._scans: list[_Part] = []
        self._scan_of: dict[str, int] = {}  # id to number of its scan
        self._conditions: list[_Condition] = []  # of the whole tree
        self._products: list[tuple[set[int], set[int]]] = []  # scans on both sides of each Cross
        self._rows: dict[frozenset[int], int] = {}  # of groups, by their scans, where they were counted

    def visit(self, q: Query) -> tuple[list[_Part], list[_Condition], list[Field]]:
        return getattr(self, f"_{type(q).__name__.lower()}")(q)

    def build(self, parts: list[_Part], conditions: list[_Condition], fields: list[Field]) -> tuple[_Part, list[Field]]:
        df = reduce(self._times, self._dealt(self._groups(parts, conditions)))
        return (_scans_of(parts), df.select(*dict.fromkeys(f.id for f in fields))), fields

    def _dealt(self, groups: list[_Part]) -> list[DataFrame]:
        """Sides of a product. What is left of a table may lie in one partition, and one task would make all pairs: of long sides the longest is dealt over as many tasks as a shuffle has, and each has the others whole."""
        rows = [self._rows.get(frozenset(scans), 0) for scans, _ in groups]
        if self._join or sum(n >= DEALT_ROWS for n in rows) < 2:
            return [df for _, df in groups]
        longest, sides = rows.index(max(rows)), []
        for i, (_, df) in enumerate(groups):
            if rows[i] >= DEALT_ROWS:
                tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if i == longest else 1
                df = df.repartition(tasks).hint("shuffle_replicate_nl")
            sides.append(df)
        return sides

    def _times(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.crossJoin(right.hint(self._join) if self._join else right)

    def _groups(self, parts: list[_Part], conditions: list[_Condition]) -> list[_Part]:
        """Parts that conditions link, directly or by way of others, as one part under these conditions, so that tables are joined before they are multiplied."""
        groups, rest = [], list(parts)
        while rest:
            scans, df = rest.pop(0)
            while (i := next((i for i, (other, _) in enumerate(rest) if any(read & scans and read & other for read, _ in conditions)), None)) is not None:
                other, right = rest.pop(i)
                scans, df = scans | other, self._times(df, right)
            own = [c for read, c in conditions if read & scans]
            groups.append((scans, df.where(reduce(and_, own)) if own else df))
        return groups

    def _scan(self, q: Scan) -> tuple[list[_Part], list[_Condition], list[Field]]:
        df = self._catalog.table(q.table, self._columns)
        fields = [Field(f"{q.table}.{f.name}", f"c{next(self._next)}", f.dataType) for f in df.schema.fields]
        part = {len(self._scans)}, df.select(*(_quoted(s.name).alias(f.id) for s, f in zip(df.schema.fields, fields)))
        self._scan_of |= {f.id: len(self._scans) for f in fields}
        self._scans.append(part)
        return [part], [], fields

    def _filter(self, q: Filter) -> tuple[list[_Part], list[_Condition], list[Field]]:
        parts, conditions, fields = self.visit(q.child)
        own = []
        for p in q.predicates:
            names = [p.column, p.value.name] if isinstance(p.value, Ref) else [p.column]
            own.append(({self._scan_of[resolve(n, fields).id] for n in names}, _condition(p, fields, self._loose)))
        self._conditions += own
        return parts, conditions + own, fields

    def _project(self, q: Project) -> tuple[list[_Part], list[_Condition], list[Field]]:
        if not q.columns:
            raise ValueError("a Project needs a column")
        parts, conditions, fields = self.visit(q.child)
        picked = [(resolve(src, fields), to) for src, to in q.columns]
        # ids stay: a repeated column is one id under two names until the root
        return parts, conditions, [Field(to, f.id, f.kind) for f, to in picked]

    def _cross(self, q: Cross) -> tuple[list[_Part], list[_Condition], list[Field]]:
        (left, on_left, a), (right, on_right, b) = self.visit(q.left), self.visit(q.right)
        self._products.append((_scans_of(left), _scans_of(right)))
        return left + right, on_left + on_right, a + b

    def _sort(self, q: Sort) -> tuple[list[_Part], list[_Condition], list[Field]]:
        (scans, df), fields = self.build(*self.visit(q.child))
        keys = [(resolve(k.column, fields).column, k.ascending) for k in q.keys]
        return [(scans, df.orderBy(*(c.asc() if up else c.desc() for c, up in keys)) if keys else df)], [], fields

    def check_products(self) -> None:
        """Raises for a product that no predicate joins, directly or by way of other tables, and that has too many pairs of rows. Its sides are counted as joined and filtered by all predicates of the query; only such sides are counted."""
        group_of = {scan: (frozenset(scans), df) for scans, df in self._groups(self._scans, self._conditions) for scan in scans}
        for sides in self._products:
            left, right = ({group_of[s][0]: group_of[s][1] for s in scans} for scans in sides)
            if left.keys() <= right.keys() or right.keys() <= left.keys():
                continue  # joined, or checked at a Cross within
            for scans, df in (left | right).items():
                if scans not in self._rows:
                    self._rows[scans] = df.count()
            rows = [prod(self._rows[scans] for scans in side) for side in (left, right.keys() - left.keys())]
            if rows[0] * rows[1] > self._most_pairs:
                raise CrossTooLarge(f"a product of {rows[0]} and {rows[1]} rows that no predicate joins; at most {self._most_pairs} pairs are allowed")


def compile_query(query: Query, catalog: Catalog, qualified: bool = False, join: str | None = None, most_pairs: int | None = MOST_PAIRS, loose: bool = False) -> DataFrame:
    """The DataFrame of a query.

    Output columns drop their table part where the rest is unique; with
    ``qualified`` they keep it. ``join`` is one of JOINS, for all joins of the
    query. A Cross that no predicate joins is counted, its sides as predicates leave
    them, and is an error where it has over ``most_pairs`` pairs; None allows any.
    With ``loose``, values of any types compare: as numbers where both look like
    numbers, else as texts.
    """
    if join is not None and join not in JOINS:
        raise ValueError(f"unknown way to join {join!r}; known: {', '.join(JOINS)}")
    compiler = _Compiler(catalog, _named_columns(query) if _all_projected(query) else None, join, most_pairs, loose)
    found = compiler.visit(query)
    if most_pairs is not None:
        compiler.check_products()
    (_, df), fields = compiler.build(*found)
    short = [_last(f.name) for f in fields]
    names = [f.name if qualified or short.count(s) > 1 else s for f, s in zip(fields, short)]
    return df.select(*(f.column.alias(n) for f, n in zip(fields, names)))
