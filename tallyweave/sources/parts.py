"""Versioned Parquet tables cut into parts, for stores that change little at a time.

Layout of a store, in a folder that every executor can reach:
  <table>/part=<p>/gen=<g>/     rows of one part, as one generation wrote them
  manifest/<version>.json       which generations make up each part; the last is the store

Generations are never changed, only added; a manifest names those that count. A step
that dies before its manifest is there leaves the store as it was. There is one writer at
a time: a manifest is created only where none has its number, so a second writer that
started from the same version is refused, on object stores too (nothing is renamed).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.session import filesystem


class PartStore:
    """Tables whose rows carry ``part`` (int)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- manifest -----------------------------------------------------------
    def state(self) -> dict:
        """The store as the last whole manifest describes it: version, tables (schema
        and generations of each part) and ``meta``, whatever its owner keeps there."""
        fs, where = filesystem(self.spark, f"{self.root}/manifest")
        names = sorted((f.getPath().getName() for f in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
        newest = int(names[0].split(".")[0]) if names else 0
        for name in names:
            text = self._read(f"{self.root}/manifest/{name}")
            if text.endswith("\n"):  # else its writer died while writing it
                return json.loads(text) | {"newest": newest}
        return {"version": 0, "newest": newest, "tables": {}, "meta": {}}

    def _read(self, path: str) -> str:
        fs, where = filesystem(self.spark, path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """Make ``state`` the next version."""
        version = state["newest"] + 1
        fs, where = filesystem(self.spark, f"{self.root}/manifest/{version:010d}.json")
        text = json.dumps({"version": version, "tables": state["tables"], "meta": state["meta"]}) + "\n"
        if fs.exists(where):
            raise RuntimeError("another writer committed this version")
        out = fs.create(where, False)  # refused where the file exists
        out.write(bytearray(text.encode()))
        out.close()

    @staticmethod
    def generation() -> str:
        return uuid.uuid4().hex[:16]

    # -- tables -------------------------------------------------------------
    def parts(self, state: dict, table: str) -> list[int]:
        return sorted(int(p) for p in state["tables"].get(table, {}).get("parts", {}))

    def load(self, state: dict, table: str, parts: Iterable[int] | None = None) -> DataFrame | None:
        """Rows of ``parts`` (default: all) with ``part`` and ``gen``; no other part is
        listed or read. None where the table has none of them."""
        known = state["tables"].get(table, {"parts": {}})
        wanted = known["parts"] if parts is None else {str(p): known["parts"][str(p)] for p in parts if str(p) in known["parts"]}
        paths = [f"{self.root}/{table}/part={p}/gen={g}" for p, gens in wanted.items() for g in gens]
        if not paths:
            return None
        schema = f"{known['schema']}, part int, gen string"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def empty(self, state: dict, table: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{state['tables'][table]['schema']}, part int, gen string")

    def write(self, state: dict, table: str, rows: DataFrame, gen: str, instead_of: Iterable[int] = (), spread: bool = True) -> list[int]:
        """Write rows as a generation and note it in ``state`` (not yet committed): beside
        what their parts hold, in place of it for the parts in ``instead_of``. Returns
        the parts written. With ``spread`` the rows of a part are brought together
        first; a part that is too large for one task is split."""
        plain = rows.drop("gen")
        order = [c for c in plain.columns if c != "part"]
        out = plain.select(*order, "part")
        schema = out.drop("part")._jdf.schema().toDDL()
        if spread:
            out = out.hint("rebalance", "part")
        out.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("part", "gen").parquet(f"{self.root}/{table}")
        fs, pattern = filesystem(self.spark, f"{self.root}/{table}/part=*/gen={gen}")
        found = fs.globStatus(pattern)
        written = sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in (found or []))
        known = state["tables"].setdefault(table, {"schema": schema, "parts": {}})
        for p in instead_of:
            known["parts"].pop(str(p), None)
        for p in written:
            known["parts"].setdefault(str(p), []).append(gen)
        return written

    def vacuum(self) -> int:
        """Delete generations that the last manifest does not name, those of writers that
        died among them, and manifests before it; returns how many generations went.
        Frames loaded from an older version must not be read afterwards."""
        state, gone = self.state(), 0
        fs, _ = filesystem(self.spark, self.root)
        for table, known in state["tables"].items():
            used = {(p, g) for p, gens in known["parts"].items() for g in gens}
            for f in fs.globStatus(filesystem(self.spark, f"{self.root}/{table}/part=*/gen=*")[1]) or []:
                g, p = f.getPath().getName()[4:], f.getPath().getParent().getName()[5:]
                if (p, g) not in used:
                    fs.delete(f.getPath(), True)
                    gone += 1
        for f in fs.globStatus(filesystem(self.spark, f"{self.root}/manifest/*.json")[1]) or []:
            if int(f.getPath().getName().split(".")[0]) < state["version"]:
                fs.delete(f.getPath(), False)
        return gone
