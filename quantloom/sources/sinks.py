"""Writers: single tables, resumable predictions, manifests and typeset tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def if_absent(df: DataFrame, path: str) -> None:
    """Writes only where nothing lies."""
    df.write.mode("ignore").parquet(path)


def checkpoint_predictions(preds: DataFrame, path: str, whole: bool = False) -> None:
    """Replaces the model and year partitions that preds holds and leaves all others, so that a run can be resumed and
    another run can add models. whole: replaces all that lies there."""
    rows = preds.withColumn("year", F.year("date")).repartition("model", "year").sortWithinPartitions("date", "permno")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("model", "year").parquet(path)


def manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def copy_version(df: DataFrame, root: str, stamp: str, name: str) -> str:
    """Writes a copy under its stamp beside earlier ones, and says where."""
    path = versioned(root, stamp, name)
    parquet(df, path)
    return path


def versioned(root: str, stamp: str, name: str) -> str:
    return f"{root}/{name}/version={stamp}"


def latex(df: DataFrame, formats: dict[str, str] | None = None, missing: str = "n/a") -> str:
    """A small result as a LaTeX tabular, in the order of its rows."""
    formats = formats or {}
    cell = lambda c, v: missing if v is None else (formats[c] % v if c in formats else f"{v:.4f}" if isinstance(v, float) else str(v))
    clean = lambda s: s.replace("_", r"\_")
    rows = [" & ".join(clean(cell(c, r[c])) for c in df.columns) + r" \\" for r in df.collect()]
    head = " & ".join(clean(c) for c in df.columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(df.columns) - 1)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"])


def json_line(**fields: object) -> str:
    return json.dumps(fields, sort_keys=True, default=str)
