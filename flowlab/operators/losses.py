"""Training losses as table operators (PR15-PR18, AG19-AG22).

Per-row losses are column expressions; per-batch means are a
``groupBy(epoch, batch_id)`` aggregate.  NT-Xent needs every pair inside a
batch: the batch (bounded by the batch size) is one ``applyInPandas`` group
and the 2B x 2B similarity matrix lives only inside that task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions import arrays as A

# Fixed values (code defaults): confidence 0.90, class-0 cut +0.05,
# class-1 cut -0.20, focal gamma 2, NT-Xent temperature 0.1.
CONFIDENCE = 0.90
CUT_DELTA = (0.05, -0.20)
FOCAL_GAMMA = 2.0
NTXENT_T = 0.1


def cross_entropy(logits: Column, y: Column) -> Column:
    """-log softmax(logits)[y] via log-sum-exp."""
    m = F.array_max(logits)
    lse = m + F.ln(A.vsum(F.transform(logits, lambda x: F.exp(x.cast("double") - m))))
    return lse - F.element_at(logits, (y + 1).cast("int")).cast("double")


def focal_loss(logits: Column, y: Column, weight: Column | None = None, gamma: float = FOCAL_GAMMA) -> Column:
    """PR17: (1 - p_t)^gamma * CE (* class weight)."""
    p = A.softmax(logits)
    pt = F.element_at(p, (y + 1).cast("int"))
    loss = F.pow(F.lit(1.0) - pt, F.lit(gamma)) * cross_entropy(logits, y)
    return loss * weight if weight is not None else loss


def pseudo_label(weak_logits: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """PR18: (argmax, mask) where mask = max prob >= per-class cut."""
    return pseudo_label_from_probs(A.softmax(weak_logits), confidence)


def pseudo_label_from_probs(p: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """PR18 on already computed weak-view probabilities."""
    lab = A.argmax(p)
    cut = F.when(lab == 0, F.lit(confidence + CUT_DELTA[0])).otherwise(F.lit(confidence + CUT_DELTA[1]))
    mask = (F.array_max(p) >= cut).cast("double")
    return lab, mask


def fixmatch_batch_losses(df: DataFrame, labeled: str, logits_l: str, y: str, weight: str,
                          logits_weak: str, logits_strong: str, lambda_u: Column) -> DataFrame:
    """AG21: per (epoch, batch): mean focal loss over labeled rows, mean
    masked CE over unlabeled rows, total = Ls + lambda * Lu, mask rate."""
    df = df.withColumn("_pw", A.softmax(F.col(logits_weak)))
    lab, mask = pseudo_label_from_probs(F.col("_pw"))
    rows = df.select("epoch", "batch_id", F.col(labeled).alias("_lab"), lambda_u.alias("_lam"),
                     F.when(F.col(labeled), focal_loss(F.col(logits_l), F.col(y), F.col(weight))).alias("_ls"),
                     F.when(~F.col(labeled), cross_entropy(F.col(logits_strong), lab) * mask).alias("_lu"),
                     F.when(~F.col(labeled), mask).alias("_m"))
    g = rows.groupBy("epoch", "batch_id").agg(F.avg("_ls").alias("loss_s"), F.avg("_lu").alias("loss_u"),
                                              F.avg("_m").alias("mask_rate"), F.first("_lam").alias("_lam"))
    return g.select("epoch", "batch_id", "loss_s", "loss_u", (F.col("loss_s") + F.col("_lam") * F.col("loss_u"))
                    .alias("total_loss"), "mask_rate")


def epoch_history(batch_losses: DataFrame) -> DataFrame:
    """AG22: epoch means, NaN / null steps skipped."""
    ok = ~F.isnan(F.col("total_loss")) & F.col("total_loss").isNotNull()
    b = batch_losses.where(ok)
    return b.groupBy("epoch").agg(F.avg("loss_s").alias("loss_s"), F.avg("loss_u").alias("loss_u"),
                                  F.avg("total_loss").alias("total_loss"), F.avg("mask_rate").alias("mask_rate"))


def mixmatch_terms(probs_u: Column, pseudo: Column) -> Column:
    """AG20 unlabeled term: mean squared difference of probability vectors."""
    return A.mse(probs_u, pseudo)


def nt_xent(pairs: DataFrame, z1: str = "z1", z2: str = "z2", temperature: float = NTXENT_T) -> DataFrame:
    """AG19: NT-Xent per batch of positive pairs ``(batch_id, pos, z1, z2)``;
    returns ``(batch_id, loss, n_rows)`` (mean over the 2B rows)."""

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a = np.stack(pdf[z1].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        b = np.stack(pdf[z2].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())

        def l2n(m):
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        z = np.concatenate([l2n(a), l2n(b)])
        bsz = len(a)
        sim = z @ z.T / temperature
        np.fill_diagonal(sim, -np.inf)
        tgt = np.concatenate([np.arange(bsz, 2 * bsz), np.arange(bsz)])
        m = sim.max(axis=1, keepdims=True)
        lse = m[:, 0] + np.log(np.exp(sim - m).sum(axis=1))
        loss = lse - sim[np.arange(2 * bsz), tgt]
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "loss": [float(loss.mean())],
                             "n_rows": [2 * bsz]})

    return pairs.select("batch_id", "pos", z1, z2).groupBy("batch_id").applyInPandas(
        per_batch, "batch_id long, loss double, n_rows long")
