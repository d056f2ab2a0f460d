"""Residue keys: ``chain:number`` or ``chain:number:insertion``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.columns import col


def chain_of(key: Column | str) -> Column:
    return F.split_part(col(key), F.lit(":"), F.lit(1))


def residue_struct(key: Column | str) -> Column:
    """A key as (chain, number, insertion code), which sorts in natural order."""
    k = col(key)
    return F.struct(chain_of(k).alias("chain"), F.split_part(k, F.lit(":"), F.lit(2)).try_cast("int").alias("resseq"), F.split_part(k, F.lit(":"), F.lit(3)).alias("icode"))


def filter_chain(keys: DataFrame, chain: str | None, key: str = "key") -> DataFrame:
    """Keys of one chain; no chain keeps all."""
    return keys if not chain else keys.filter(chain_of(key) == chain)


def match_residues(keys: DataFrame, residues: DataFrame, max_offset: int = 1) -> DataFrame:
    """Match each wanted key to a residue of its structure, by the first rule that holds.

    ``keys``: structure, key; ``residues``: structure, key.  Rules: the same key;
    the same chain and number if unique; for a chain that is blank or absent, the
    same number and insertion code, then the same number, in any chain if unique;
    a neighbour in the same chain (lower first; with the insertion code, then
    without).  Returns ``structure, key, matched_key, mode, warning``.

    Residues are listed under each chain and number that can ask for them, with the
    insertion codes there, and under each number in any chain, with its few codes and
    how many residues have them; a wanted key passes once through each of these joins.
    """
    r = residues.select("structure", F.col("key").alias("k")).distinct().select("structure", "k", residue_struct("k").alias("r")).select("structure", "k", "r.*")
    chains = r.select("structure", "chain").distinct().withColumn("_in", F.lit(True))
    numbered = r.filter(F.col("resseq").isNotNull())
    near = F.explode(F.sequence(F.lit(-max_offset), F.lit(max_offset)))
    spread = numbered.select("structure", "chain", "icode", "k", near.alias("shift"), "resseq")
    own = spread.groupBy("structure", "chain", (F.col("resseq") - F.col("shift")).alias("resseq")).agg(F.collect_list(F.struct("shift", "icode", "k")).alias("_own"))
    coded = numbered.groupBy("structure", "resseq", "icode").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    loose = coded.groupBy("structure", "resseq").agg(F.collect_list(F.struct("icode", "n", "k")).alias("_loose"))

    least = lambda rows: F.array_min(F.transform(rows, lambda x: x["k"]))
    named = lambda mode, key: F.when(key.isNotNull(), F.struct(key.alias("matched_key"), F.lit(mode).alias("mode")))

    def of_chain(shift: int) -> tuple[Column, Column]:
        """The residue with the insertion code, and the only residue of the number."""
        rows = F.filter("_own", lambda x: x["shift"] == shift)
        return least(F.filter(rows, lambda x: x["icode"] == F.col("icode"))), F.when(F.size(rows) == 1, least(rows))

    w = keys.select("structure", "key").distinct().select("structure", "key", residue_struct("key").alias("w")).select("structure", "key", "w.*")
    exact, number = of_chain(0)
    before = F.coalesce(named("exact", exact), named("chain_number", number))
    offsets = [named(f"offset_{sign:+d}", key) for step in range(1, max_offset + 1) for sign in (-step, step) for key in of_chain(sign)]
    after = F.coalesce(*offsets) if offsets else before
    d = w.join(own, ["structure", "chain", "resseq"], "left").select("structure", "key", "chain", "resseq", "icode", before.alias("_before"), after.alias("_after"))
    d = d.join(chains, ["structure", "chain"], "left")
    d = d.withColumn("_number", F.when((F.col("chain") == "") | F.col("_in").isNull(), F.col("resseq")))  # only keys without a chain of their own ask in any chain
    loose = loose.withColumnRenamed("resseq", "_number")
    same = F.filter("_loose", lambda x: (x["icode"] == F.col("icode")) & (x["n"] == 1))
    only = F.filter("_loose", lambda x: x["n"] == 1)
    anywhere = F.coalesce(named("any_chain_icode", least(same)), named("any_chain", F.when(F.size("_loose") == 1, least(only))))
    g = d.join(loose, ["structure", "_number"], "left").select("structure", "key", F.coalesce("_before", anywhere, "_after").alias("_b"))
    out = g.select("structure", "key", "_b.matched_key", F.coalesce("_b.mode", F.lit("unmatched")).alias("mode"))
    return out.withColumn("warning", F.col("mode") != "exact")


def site_summary(matches: DataFrame) -> DataFrame:
    """Counts of defined, matched and unmatched keys of each structure, and whether they span chains."""
    chain = F.when(F.col("matched_key").isNotNull(), chain_of("matched_key"))
    return matches.groupBy("structure").agg(F.count("*").alias("n_defined"), F.count("matched_key").alias("n_matched"), F.count_if(F.col("matched_key").isNull()).alias("n_unmatched"), F.count_if(F.col("warning")).alias("n_warnings"), F.countDistinct(chain).alias("n_chains")).withColumn("cross_chain", F.col("n_chains") > 1)
