"""Problem 2: same or near-same records across splits.

Method: edit-distance segment join.  A string within k edits of another leaves
at least s of its k + s segments unchanged, so evaluation strings and training
strings are cut, equal segments make candidates, and the candidates are
verified.  64-bit hashes are strings of 64 letters that are only replaced,
never inserted: a segment's one allowed position is its own, and the band of
the dynamic programming is the diagonal, which is the number of differing
bits (``functions.bits``).  With s = 1 these are the k + 1 segments of the
textbook; as segments of ten letters select too little on large tables, s
grows with the sizes of the sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import bits, clean
from furrow.session import Scratch


def near_hashes(evaluation: DataFrame, training: DataFrame | None, k: int, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b, bits) of 64-bit numbers at most k bits apart, equal ones included.

    Both sides are reduced to distinct numbers in ``hash``; without
    ``training`` the join is of one side with itself, of pairs a < b.  Exact
    for every k.
    """
    return bits.close_pairs(evaluation, training, k, scratch or Scratch(evaluation.sparkSession))


def split_overlaps(records: DataFrame, k: int, scratch: Scratch | None = None) -> DataFrame:
    """Pairs of a training and an evaluation record that show the same photograph.

    Columns train_path, eval_path, split, source_folder (of the evaluation
    record), bits (NULL for pairs found by file name only).  Records
    without hash can only match by name, records without folder only by hash.
    Paths are unique, and so are the pairs.
    """
    scratch = scratch or Scratch(records.sparkSession)
    usable = scratch.save(records.where("split IS NOT NULL").select("path", "source_folder", "split", "hash", clean.photo_key("path").alias("photo")))
    evaluation = usable.where("split != 'train'").select(F.col("path").alias("eval_path"), "split", "source_folder", "hash", "photo")
    training = usable.where("split = 'train'").select(F.col("path").alias("train_path"), F.col("source_folder").alias("folder"), F.col("hash").alias("t_hash"), F.col("photo").alias("t_photo"))
    close = near_hashes(evaluation, training.select(F.col("t_hash").alias("hash")), k, scratch)
    by_hash = close.join(evaluation, F.col("a") == F.col("hash")).join(training, F.col("b") == F.col("t_hash"))
    # The same file name in the same folder: the join with k = 0, whose one segment is the whole string; what the hashes gave is left out.
    same = (F.col("source_folder") == F.col("folder")) & (F.col("photo") == F.col("t_photo"))
    near = F.coalesce(clean.hamming64("hash", "t_hash") <= k, F.lit(False))
    by_name = evaluation.join(training, same).where(~near).withColumn("bits", F.lit(None).cast("int"))
    columns = ["train_path", "eval_path", "split", "source_folder", "bits"]
    return by_hash.select(columns).unionByName(by_name.select(columns))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation records: pairs, records hit on either side, exact copies."""
    return pairs.groupBy("split", "source_folder").agg(
        F.count("*").alias("n_pairs"),
        F.countDistinct("eval_path").alias("n_eval"),
        F.countDistinct("train_path").alias("n_train"),
        F.count_if(F.col("bits") == 0).alias("n_exact"),
    )
