"""Labelled texts, all or a bounded sample of them, for training classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column

#: Labels that are broadcast at most; more are merged with the texts.
BROADCAST_LABELS = 500_000


def held_out(id_column: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether the CRC-32 of the id as text leaves `fold` when divided by `folds`; no null id does."""
    return F.coalesce(F.crc32(column(id_column).cast("string")) % folds == fold, F.lit(False))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label_column: str, part_bytes: int, id_column: str, text_column: str, usable=None,
    others: dict | None = None,
) -> DataFrame:
    """`id`, `order` (a hash of it), `label` (0 or 1), `text` and `others` (columns of `docs` by new name) of all labelled
    documents, whole, dealt by their ids into partitions of about `part_bytes` of text.

    Rows without id, text or label are left out, and so are ids with both labels; an id that stands in several rows
    counts once, with the text of least hash.  Texts without label are only shuffled where labels are too many to be
    broadcast.
    """
    known = labels.select(column(id_column).alias("id"), column(label_column).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    carried = [c.alias(name) for name, c in (others or {}).items()]
    texts = docs.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text"), *carried).filter(
        "id IS NOT NULL AND text IS NOT NULL"
    )
    if usable is not None:
        texts = texts.filter(usable)
    one_label = lambda rows: rows.groupBy("id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("id", "label")
    few = known.count() <= BROADCAST_LABELS
    marked = F.broadcast(one_label(known)) if few else one_label(known)
    size = texts.select("id", F.octet_length("text").alias("bytes")).join(marked, "id", "left").agg(
        F.sum("bytes").alias("all"), F.sum(F.when(F.col("label").isNotNull(), F.col("bytes"))).alias("labelled")
    ).first()
    parts = max(1, -(-(size["labelled"] or 0) // part_bytes))
    if few:
        met = texts.join(marked, "id").repartition(parts, "id")
    else:
        parts = max(parts, -(-(size["all"] or 0) // (10 * part_bytes)))
        met = texts.repartition(parts, "id").join(one_label(known.repartition(parts, "id")).hint("merge"), "id")
    kept = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", *(others or {}))).alias("row")
    one = met.groupBy("id").agg(F.first("label").alias("label"), kept)
    return one.select(
        "id", F.xxhash64("id", F.lit(7)).alias("order"), "label", "row.text", *[f"row.{name}" for name in others or {}]
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_column: str, rows: int, most_bytes: int, id_column: str, text_column: str,
    usable=None,
) -> DataFrame:
    """`text`, `label` (0 or 1) and `weight` of at most `rows` labelled documents, half of them of each label.

    Rows are chosen by a hash of their id, so always the same ones; `weight` gives each label the part it has
    among all usable labelled rows.  Documents of more than `most_bytes` aren't learnt from.  Rows without id, text
    or label are left out.  The sample is bounded by its two parameters, whatever the corpus holds.
    """
    known = labels.select(column(id_column).alias("id"), column(label_column).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    if usable is not None:
        known = known.filter(usable)
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("id", F.lit(7)), F.col("id")]
    parts = [known.filter(F.col("label") == k).orderBy(*order).limit(rows // 2) for k in (0, 1)]
    chosen = parts[0].union(parts[1])
    texts = docs.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text")).filter(
        F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)
    )
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, total.get(k, 0) / max(1, min(total.get(k, 0), rows // 2)))])
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label", share[F.col("label")].alias("weight"))
