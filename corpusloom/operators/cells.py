"""The evaluation grid: 19 cells, one clean, 14 single degradations and 4 composed ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities by family, and composed chains.
SINGLE = {"jpeg": (90, 70, 50, 30), "blur": (0.5, 1.0, 2.0), "resize": (0.5, 0.25), "noise": (0.02, 0.05, 0.1), "jitter": (0.2,), "center_crop": (0.8,)}
COMPOSED = ((("blur", 1.0), ("jpeg", 70)), (("resize", 0.5), ("jpeg", 50)), (("jitter", 0.2), ("jpeg", 30)), (("resize", 0.25), ("blur", 0.5), ("jpeg", 30)))
FAMILIES = (*SINGLE, "composed")


@dataclass(frozen=True)
class Cell:
    name: str
    kind: str
    family: str
    severity: float | None
    ops: tuple[tuple[str, float], ...]

    @property
    def chain(self) -> str:
        return " -> ".join(f"{f}({s})" for f, s in self.ops) or "identity"


def grid() -> list[Cell]:
    """In order; whole numbers stay bare in names, others keep their point."""
    cells = [Cell("clean", "clean", "clean", None, ())]
    cells += [Cell(f"{f}_{s}", "single", f, float(s), ((f, s),)) for f, ss in SINGLE.items() for s in ss]
    cells += [Cell("composed_" + "+".join(f"{f}{s}" for f, s in ops), "composed", "composed", None, ops) for ops in COMPOSED]
    if len({c.name for c in cells}) != len(cells):
        raise ValueError("cell names must be unique")
    return cells


def select_cells(names: list[str] | None) -> list[Cell]:
    """Cells by their or their family's name, each once, in grid order; unknown names are an error."""
    cells = grid()
    if names is None:
        return cells
    known = {c.name for c in cells} | {c.family for c in cells}
    if unknown := sorted(set(names) - known):
        raise ValueError(f"unknown cells: {', '.join(unknown)}")
    return [c for c in cells if c.name in names or c.family in names]


def cell_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """At most 19 rows: (ord, cell, kind, family, severity, chain, ops)."""
    rows = [(i, c.name, c.kind, c.family, c.severity, c.chain, [(f, float(s)) for f, s in c.ops]) for i, c in enumerate(select_cells(names))]
    return spark.createDataFrame(rows, "ord int, cell string, kind string, family string, severity double, chain string, ops array<struct<family:string,severity:double>>")


def expand(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Every item in every cell; the cells' table is a literal of at most 19 rows, so each item is read once."""
    names = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in (("cell", "string"), ("kind", "string"), ("family", "string"), ("severity", "double"))]) for r in cells.orderBy("ord").collect()])
    return items.withColumn("_c", F.explode(names)).select(*items.columns, "_c.cell", "_c.kind", "_c.family", "_c.severity")
