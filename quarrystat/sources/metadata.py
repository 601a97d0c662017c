"""ML attribute metadata of a feature vector and a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_metadata(df: DataFrame, categorical: dict[int, int], num_classes: int, d: int) -> DataFrame:
    """Mark features nominal (with their number of values) or numeric.

    The label is numeric for ``num_classes`` 0, else nominal.
    """
    nominal = [{"idx": j, "name": f"f{j}", "vals": [str(v) for v in range(categorical[j])]}
               for j in sorted(categorical)]
    numeric = [{"idx": j, "name": f"f{j}"} for j in range(d) if j not in categorical]
    attrs = {k: v for k, v in (("nominal", nominal), ("numeric", numeric)) if v}
    features = {"ml_attr": {"attrs": attrs, "num_attrs": d}}
    label = ({"ml_attr": {"type": "numeric", "name": "label"}} if num_classes == 0 else
             {"ml_attr": {"type": "nominal", "name": "label",
                          "vals": [str(v) for v in range(num_classes)]}})
    rest = [c for c in df.columns if c not in ("features", "label")]
    return df.select(*rest, F.col("features").alias("features", metadata=features),
                     F.col("label").alias("label", metadata=label))
