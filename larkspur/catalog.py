"""Collections, edge types, indexes and views: named DataFrames and what is known of them.

A record's identity is its slug, collection/key. Frames never change; a mutation puts another frame in place, so a
copy of the catalog is a snapshot and a transaction.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import QueryError

SYSTEM = ("_key", "_id", "_collection", "_created_unix", "_updated_unix")


@dataclass
class ColumnDef:
    name: str
    kind: str  # TEXT INTEGER REAL BOOL TIMESTAMPTZ GEO VECTOR JSON
    default: tuple | None = None
    generated: tuple | None = None
    not_null: bool = False


TYPES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "TIMESTAMPTZ": "string", "GEO": "string", "VECTOR": "array<float>", "JSON": "string"}


class Frame:
    """Something with a DataFrame, which may be given as a function that makes it when it is first needed."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame]):
        self._df = df

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df


class Collection(Frame):
    """df has _key and the fields; columns is the declared schema, if there is one; body is a view's text.

    key is the column that _key was made from, if it was.
    """

    def __init__(self, df, columns: list[ColumnDef] | None = None, body: str | None = None, auto_index: bool = False, key: str | None = None):
        super().__init__(df)
        self.key = key
        self.postings: dict[tuple, object] = {}  # fields -> the stored index of this frame
        self.columns, self.body, self.auto_index = columns, body, auto_index

    @property
    def df(self) -> DataFrame:
        return Frame.df.fget(self)

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df, self.key, self.postings = df, None, {}  # changed rows needn't have the column any more

    @property
    def number(self) -> str | None:
        """That column, if it has whole numbers."""
        return self.key if self.key and dict(self.df.dtypes).get(self.key) in ("bigint", "int", "smallint", "tinyint") else None


class EdgePart(Frame):
    """Edges of one type between two collections: _src and _dst are keys, the other columns attributes.

    sound: both ends are known to exist, as after a foreign key, so joins to prove it can be left out.
    """

    def __init__(self, source: str, target: str, df, sound: bool = False):
        super().__init__(df)
        self.source, self.target, self.sound = source, target, sound


@dataclass
class Catalog:
    collections: dict[str, Collection] = field(default_factory=dict)
    edges: dict[str, list[EdgePart]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str, tuple[str, ...]]] = field(default_factory=dict)  # name -> (collection, method, fields)
    kept: set[tuple] = field(default_factory=set)  # (collection, fields) of text indexes to be stored

    def snapshot(self) -> Catalog:
        return Catalog({k: copy.copy(v) for k, v in self.collections.items()}, {k: list(v) for k, v in self.edges.items()}, dict(self.indexes), set(self.kept))

    def collection(self, name: str) -> Collection:
        name = name.removeprefix("public.")
        if name not in self.collections:
            raise QueryError(f"no collection named {name}")
        return self.collections[name]

    def nodes(self, name: str) -> DataFrame:
        """The collection's rows with _id and _collection."""
        name = name.removeprefix("public.")
        df = self.collection(name).df
        return df.withColumns({"_id": F.concat(F.lit(name + "/"), F.col("_key")), "_collection": F.lit(name)})

    def every(self, names: list[str] | None = None) -> DataFrame:
        """All rows of some or all collections; fields that one lacks are NULL there, and types that differ become text."""
        frames = [self.nodes(n) for n in (names if names is not None else sorted(self.collections))]
        if not frames:
            raise QueryError("no collections")
        kinds: dict[str, set[str]] = {}
        for df in frames:
            for c, k in df.dtypes:
                kinds.setdefault(c, set()).add(k)
        alike = []
        for df in frames:
            alike.append(df.withColumns({c: (F.to_json(c) if k.startswith(("struct", "array", "map")) else F.col(c).cast("string")) for c, k in df.dtypes if len(kinds[c]) > 1}))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)

    def parts(self, types: list[str] | None, source: set[str] | None = None, target: set[str] | None = None) -> list[tuple[str, EdgePart]]:
        """(type, part) of the edges that can lie between these collections."""
        names = types if types else sorted(self.edges)
        found = [(t, p) for t in names for p in self.edges.get(t, [])]
        return [(t, p) for t, p in found if (source is None or p.source in source) and (target is None or p.target in target)]

    def between(self, start: str, goal: str) -> list[tuple[str, EdgePart]]:
        """The edges that a walk from one collection to another can use, by the collections they join."""
        parts = self.parts(None)

        def reached(first: str, a: str, b: str) -> set[str]:
            found = {first}
            while more := {getattr(p, b) for _, p in parts if getattr(p, a) in found} - found:
                found |= more
            return found

        ahead, behind = reached(start, "source", "target"), reached(goal, "target", "source")
        return [(t, p) for t, p in parts if p.source in ahead and p.target in behind]

    def search_fields(self, name: str) -> list[str]:
        for coll, method, fields in self.indexes.values():
            if coll == name and method == "search":
                return list(fields)
        raise QueryError(f"SEARCH needs a search index on {name}")

    def postings(self, name: str, fields: list[str]):
        """The stored index of a collection's text fields, built when first used after each change; None without one."""
        name, fields = name.removeprefix("public."), tuple(fields)
        if (name, fields) not in self.kept:
            return None
        coll = self.collection(name)
        if fields not in coll.postings:
            from .operators.postings import stored

            coll.postings[fields] = stored(coll.df, list(fields))
        return coll.postings[fields]

    def has_index(self, name: str, method: str, column: str) -> bool:
        return any(c == name and m == method and column in f for c, m, f in self.indexes.values())


def slug(collection: str, key: Column) -> Column:
    return F.concat(F.lit(collection + "/"), key)
