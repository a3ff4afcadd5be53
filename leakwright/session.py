"""Sessions, tables and the roles of columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Roles:
    """Which columns hold the item, its group and its label, and what the run is seeded with."""

    id: str = "image_id"
    group: str = "lesion_id"
    label: str = "dx"
    classes: tuple[str, ...] = ()
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def get(self, path: str, default=None):
        """A value of ``extra`` by dotted path."""
        node = self.extra
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def path(self, path: str, root: str) -> str:
        """A configured path, below ``root`` unless it is absolute or names a file system; a KeyError where there is none."""
        value = self.get(path)
        if value is None:
            raise KeyError(f"no path at {path}")
        return value if value.startswith("/") or "://" in value else f"{root.rstrip('/')}/{value}"


#: Where a configuration names the roles.
ROLE_NAMES = {"id": "dataset.id", "group": "dataset.group", "label": "dataset.label", "classes": "dataset.classes", "seed": "seed"}


def read_roles(spark: SparkSession, path: str, names: dict[str, str] = ROLE_NAMES) -> Roles:
    """Roles and all other settings of a JSON or YAML file in any file system that Spark reads.

    What the file does not name keeps its default; an empty file sets nothing; a missing one is
    a FileNotFoundError.  YAML needs the yaml package.
    """
    from leakwright.sources.files import head_of

    text = head_of(spark, path, 1 << 20)
    if path.endswith(".json"):
        raw = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError(f"the yaml package is needed to read {path}") from missing
        raw = yaml.safe_load(text) or {}
    found = {k: Roles(extra=raw).get(v) for k, v in names.items()}
    given = {k: v for k, v in found.items() if v is not None}
    if "classes" in given:
        given["classes"] = tuple(given["classes"])
    if "seed" in given:
        given["seed"] = int(given["seed"])
    return Roles(extra=raw, **given)


def session(name: str = "leakwright", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
