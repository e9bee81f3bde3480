"""Versioned model artifacts: forests as folders of Parquet."""
from __future__ import annotations


from ..operators.forest import Forest, Scorer
from .tables import TableStore

META = "mean ARRAY<DOUBLE>, std ARRAY<DOUBLE>, samples INT, threshold DOUBLE, version STRING, nominal_voltage DOUBLE"


class ModelStore:
    """Forests below one folder, one version each; the newest complete one is in force.

    A forest is loaded and sent to the executors once, and again only when a newer version
    has been saved. Its size is bounded by trees * 2 * samples nodes.
    """

    def __init__(self, tables: TableStore, name: str = "models") -> None:
        self.tables = tables
        self.name = name
        self._loaded: tuple[int, Scorer] | None = None

    def save(self, forest: Forest, number: int) -> None:
        """Write a version; the meta row goes last and makes it complete."""
        path = f"{self.tables.path(self.name)}/number={number}"
        forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        row = (list(forest.mean), list(forest.std), forest.samples, forest.threshold, forest.version, forest.nominal_voltage)
        self.tables.spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    def numbers(self) -> list[int]:
        found = (int(n) for n in self.tables._folders(self.name, "number"))
        return sorted(n for n in found if self.tables._exists(f"{self.tables.path(self.name)}/number={n}/meta/_SUCCESS"))

    def load(self, number: int) -> Forest:
        path = f"{self.tables.path(self.name)}/number={number}"
        meta = self.tables.spark.read.schema(META).parquet(f"{path}/meta").first()
        nodes = self.tables.spark.read.parquet(f"{path}/nodes")
        return Forest(nodes, tuple(meta.mean), tuple(meta.std), meta.samples, meta.threshold, meta.version, meta.nominal_voltage)

    def newest(self) -> Scorer | None:
        """The scorer of the newest version, or None if there is no model."""
        numbers = self.numbers()
        if not numbers:
            return None
        if self._loaded is None or self._loaded[0] != numbers[-1]:
            self._loaded = (numbers[-1], Scorer(self.load(numbers[-1])))
        return self._loaded[1]
