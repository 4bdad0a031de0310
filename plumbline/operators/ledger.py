"""Which inputs of an incremental job are still to be done, and which are done.

inputs(path, product, slot, always), ledger(path, product, slot, done_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "product", "slot"]


def relative(inputs: DataFrame, root: str) -> DataFrame:
    """Paths below root, with forward slashes."""
    slashed = F.replace("path", F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return inputs.withColumn("path", F.when(F.startswith(slashed, F.lit(base)), F.substr(slashed, F.lit(len(base) + 1))).otherwise(slashed))


def pending(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inputs that the ledger does not have, and those that always run."""
    once = inputs.where(~F.coalesce("always", F.lit(False)))
    return once.join(ledger.select(*KEY), KEY, "left_anti").select(*inputs.columns).unionByName(inputs.where("always"))


def record(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with finished inputs; those that always run are not recorded."""
    new = done.where(~F.coalesce("always", F.lit(False))).join(ledger.select(*KEY), KEY, "left_anti")
    return ledger.unionByName(new.select(*KEY, F.current_timestamp().alias("done_at")))


def obsolete(ledger: DataFrame, inputs: DataFrame) -> DataFrame:
    """Ledger rows, of the products and slots at hand, whose input is gone."""
    at_hand = inputs.select("product", "slot").distinct()
    return ledger.join(at_hand, ["product", "slot"], "left_semi").join(inputs.select(*KEY), KEY, "left_anti").select(*ledger.columns)
