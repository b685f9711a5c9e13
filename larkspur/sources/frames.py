"""pandas in and out."""

from __future__ import annotations

import json

import pandas as pd

from ..engine import Engine


class Frames:
    """Engine(...).frames: query() to pandas, load_nodes() and load_edges() from pandas."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def query(self, text: str, params: list | None = None, index_col: str | None = None) -> pd.DataFrame:
        got = self.engine.sql(text, params).toPandas()
        return got.set_index(index_col) if index_col and index_col in got.columns else got

    def load_nodes(self, df: pd.DataFrame, collection: str, *, vector_cols: list[str] | None = None, mapping: dict[str, str] | None = None, id_col: str = "_key") -> int:
        """Rows become records; mapping renames columns, vector_cols are cast to arrays of float."""
        renamed = df.rename(columns={id_col: "_key", **(mapping or {})})
        vectors = [(mapping or {}).get(c, c) for c in vector_cols or []]
        rows = []
        for r in renamed.to_dict("records"):
            row = {}
            for k, v in r.items():
                if k in vectors:
                    row[k] = None if v is None else [float(x) for x in v]
                elif isinstance(v, float) and pd.isna(v) or v is None or v is pd.NaT:
                    row[k] = None
                else:
                    row[k] = v.item() if hasattr(v, "item") else v.isoformat() if hasattr(v, "isoformat") else v
            rows.append(row)
        return self.engine._mutate(lambda m: m.put(collection, rows)) if rows else 0

    def load_edges(self, df: pd.DataFrame, *, source_collection: str | None = None, source_col: str, target_collection: str | None = None, target_col: str, meta_col: str | None = None, weight_col: str | None = None, edge_type_col: str | None = None, edge_type: str | None = None) -> int:
        """One edge a row; a weight becomes the attribute `weight`, a JSON object in meta_col more attributes."""
        if not (edge_type or edge_type_col):
            raise ValueError("give edge_type or edge_type_col")
        slug = lambda c, v: f"{c}/{v}" if c and "/" not in str(v) else str(v)
        edges = []
        for r in df.to_dict("records"):
            attrs = {"weight": float(r[weight_col])} if weight_col and r.get(weight_col) is not None else {}
            if meta_col and isinstance(r.get(meta_col), str) and r[meta_col]:
                attrs |= json.loads(r[meta_col])
            edges.append((slug(source_collection, r[source_col]), slug(target_collection, r[target_col]), edge_type or str(r[edge_type_col]), attrs))
        return self.engine.link_many(edges) if edges else 0

    def create_collection(self, name: str, fields: dict[str, str], fulltext_index: tuple[str, ...] = (), vector_index: tuple[str, ...] = (), spatial_index: tuple[str, ...] = (), range_index: tuple[str, ...] = (), hash_index: tuple[str, ...] = ()) -> None:
        self.engine.execute(f"CREATE TABLE {name} ({', '.join(f'{k} {v}' for k, v in fields.items())})")
        for method, columns in (("hash", hash_index), ("btree", range_index), ("spatial", spatial_index), ("hnsw", vector_index), ("bm25", fulltext_index)):
            for c in columns:
                self.engine.execute(f"CREATE INDEX ON {name} USING {method} ({c})")


