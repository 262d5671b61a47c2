"""Publish a result behind its checks (S5): write, audit, then one atomic step in the catalog.

Each version is a table of its own under the shared folder; the published name
is a view over the current one. ``CREATE OR REPLACE VIEW`` is a single change of
the catalog, so a reader sees the old version or the new one, never half, and a
version that fails its checks is never named.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetcraft.sources.tables import scratch_path

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def publish(df: DataFrame, name: str, audit: Callable[[DataFrame], object], folder: str | None = None) -> str:
    """Write ``df`` as a new version, audit it as read back, and point the view ``name`` at it; returns the version's table.

    ``audit`` raises to refuse (``quality.gate`` does); the refused version is
    dropped and the view stays as it was. Earlier versions stay until ``retire``,
    as readers that opened them may still read.
    """
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    spark = df.sparkSession
    version = f"{name}__v{uuid.uuid4().hex[:12]}"
    path = f"{folder.rstrip('/')}/{version}" if folder else scratch_path(spark, version)
    df.write.option("path", path).saveAsTable(version)
    try:
        audit(spark.table(version))
    except Exception:
        spark.sql(f"DROP TABLE {version}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    return version


def versions(spark, name: str) -> list[str]:
    """The stored versions of a published name."""
    base, _, leaf = name.rpartition(".")
    found = [t.name for t in spark.catalog.listTables(base or None) if t.name.startswith(f"{leaf.lower()}__v")]
    return sorted(f"{base}.{t}" if base else t for t in found)


def retire(spark, name: str, keep: str) -> None:
    """Drop all versions of a name but ``keep``, the table that publish() returned last."""
    for table in versions(spark, name):
        if table != keep.lower():
            spark.sql(f"DROP TABLE {table}")
