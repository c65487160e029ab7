"""Feature scaling and nearest-neighbour similarity.

Exact cosine nearest neighbours come from the pruned index of ``vector_index``: no dense
global matrix, no cross join, and of all pairs only those that the triangle inequality of
angles cannot rule out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis import config
from fidelis.functions.columns import clean
from fidelis.operators.frames import attach
from fidelis.operators.sampling import sample_exact, sample_key
from fidelis.operators.vector_index import BLOCK_ROWS, CELL_ROWS, KEEP, build_index, drop_index, search


def scale_stats(reference: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean ``_m{i}`` and population std ``_s{i}`` per feature, and the row count ``_rows``."""
    return reference.agg(*[F.avg(clean(F.col(f"`{f}`"))).alias(f"_m{i}") for i, f in enumerate(features)],
                         *[F.stddev_pop(clean(F.col(f"`{f}`"))).alias(f"_s{i}") for i, f in enumerate(features)],
                         F.count(F.lit(1)).alias("_rows"))


def standard_scale(reference: DataFrame, df: DataFrame, features: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean_ref) / std_ref with the POPULATION std of the reference; a zero std
    divides by 1.  The one-row statistics (``scale_stats``, reusable) are attached by broadcast."""
    stats = stats if stats is not None else scale_stats(reference, features)
    j = attach(df, stats.drop("_rows"))
    scaled = []
    for i, f in enumerate(features):
        s = F.col(f"_s{i}")
        denom = F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
        scaled.append(((clean(F.col(f"`{f}`")) - F.col(f"_m{i}")) / denom).alias(f))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in features]
    return j.select(*keep, *scaled)


def vectorize(df: DataFrame, id_col: str, features: list[str], name: str = "vec") -> DataFrame:
    """``(id, array<double>)`` from scalar feature columns."""
    return df.select(F.col(f"`{id_col}`"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias(name))


#: Samples of more rows are cut out by a filter instead of a heap in every task.
HEAP_ROWS = 10_000


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """K6: exactly min(n, rows) rows without replacement, chosen by a seeded hash order.

    Independent of partitioning (re-runs after executor loss pick the same rows).  A small sample is a
    top-n heap per task (``TakeOrderedAndProject``); of a large one the cut-off of the hash is found
    first and the sample is a filter (``sampling.sample_exact``), which gives the same rows."""
    if n > HEAP_ROWS:
        return sample_exact(df, id_col, n, seed)
    return df.orderBy(sample_key(id_col, seed), F.col(f"`{id_col}`")).limit(n)


def nn_search(candidate: DataFrame, reference: DataFrame, cand_id: str, ref_id: str, vec_col: str,
              k: int = 1, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` most cosine-similar reference rows of every candidate row.

    Output ``(<cand_id>, rank, ref_id, similarity)``; a candidate with no reference row
    (empty reference) gets one row with similarity 0.0 and a NULL reference id.

    Exact at any size: the reference is indexed (``vector_index``) and a candidate meets only
    the cells that may hold a nearer row.  Build the index yourself to search it again.
    """
    index = build_index(reference, ref_id, vec_col, cell_rows=cell_rows, keep=max(k, KEEP))
    if not index.n_rows:
        drop_index(candidate.sparkSession, index)
        return candidate.select(F.col(f"`{cand_id}`").cast("long").alias(cand_id), F.lit(1).cast("long").alias("rank"),
                                F.lit(None).cast("long").alias("ref_id"), F.lit(0.0).alias("similarity"))
    found, _ = search(index, candidate, cand_id, vec_col, k, block_rows=block_rows)
    drop_index(candidate.sparkSession, index)
    return found.select(F.col("id").alias(cand_id), "rank", F.col("rid").alias("ref_id"), "similarity")


def nn_cosine(candidate: DataFrame, reference: DataFrame, cand_id: str, ref_id: str, vec_col: str,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best cosine similarity of every candidate row to any reference row."""
    out = nn_search(candidate, reference, cand_id, ref_id, vec_col, 1, block_rows)
    return out.drop("rank").withColumnRenamed("similarity", "max_similarity")


def semi_by_id(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in ``ids`` (left semi join; AQE broadcasts a small id list)."""
    return df.join(ids.select(F.col(f"`{id_col}`")).distinct(), id_col, "left_semi")


def flag_rows(best: DataFrame, threshold: float = config.SIMILARITY_THRESHOLD, sim_col: str = "max_similarity") -> DataFrame:
    """``flagged = best similarity < threshold``, similarity rounded to 4 places."""
    return best.withColumn("flagged", F.col(sim_col) < F.lit(threshold)).withColumn(sim_col, F.round(sim_col, 4))


def anomaly_rate(flags: DataFrame, escalate: float = config.SIMILARITY_ESCALATE_RATE) -> DataFrame:
    """M1 + N3: sampled, anomalies, rate = anomalies / max(sampled, 1), score = max(0, 1 - rate),
    escalated iff rate > ``escalate``, passed iff rate <= ``escalate``; rounded to 4."""
    a = flags.agg(F.count(F.lit(1)).alias("sampled"), F.count_if("flagged").alias("anomalies"))
    rate = F.col("anomalies") / F.greatest(F.col("sampled"), F.lit(1))
    return a.select("sampled", "anomalies", F.round(rate, 4).alias("anomaly_rate"),
                    (rate > escalate).alias("escalated"), F.round(F.greatest(F.lit(0.0), 1 - rate), 4).alias("score"),
                    (rate <= escalate).alias("passed"), F.lit("exact_blocked").alias("backend"))


def escalation_context(summary: DataFrame) -> DataFrame:
    """The escalation text (count and rate), NULL unless escalated; ``flagged_ids`` has the ids."""
    txt = F.format_string("similarity check: %d of %d rows flagged (%.1f%%)",
                          F.col("anomalies"), F.col("sampled"), F.col("anomaly_rate") * 100)
    return summary.select("escalated", F.when(F.col("escalated"), txt).alias("context"))


def flagged_ids(summary: DataFrame, flags: DataFrame, id_col: str) -> DataFrame:
    """Every flagged id, one row each, with the context text (a long table at any count)."""
    return attach(flags.where("flagged").select(F.col(f"`{id_col}`")), escalation_context(summary))
