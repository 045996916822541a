"""Tables whose ids all lie far above those of the small ones, to show rules that hold for small ids only."""

from __future__ import annotations

import os

import duckdb

#: What is added to ids; a multiple of all moduli of the plans that use them.
FAR = 60_060_000
IDS = {
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_suppkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "customer": ["c_custkey"],
}
JOINED = {"orders": ["o_custkey"]}


def far_tables(data: str, out: str, far: int = FAR) -> str:
    for t in ("region", "nation", "part", *IDS):
        moved = [*IDS.get(t, []), *JOINED.get(t, [])]
        kinds = {r[0]: r[1] for r in duckdb.sql(f"DESCRIBE SELECT * FROM '{data}/{t}.parquet'").fetchall()}
        star = "*" + (f" REPLACE ({', '.join(f'CAST({c} + {far} AS {kinds[c]}) AS {c}' for c in moved)})" if moved else "")
        duckdb.sql(f"COPY (SELECT {star} FROM '{data}/{t}.parquet') TO '{os.path.join(out, t)}.parquet' (FORMAT parquet)")
    return out
