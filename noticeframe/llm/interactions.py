"""Operator 11: how text filters interact, by a subset-zeta transform over failure masks.

One scan gives every document a mask with a bit per filter that it fails. Only counts go on: rows per
(part, mask), at most ``2 ** k`` a part for ``k`` filters, whatever the corpus. Per part the counts form
an array indexed by mask; the zeta transform (``k`` passes, each adding the entry without one bit) turns it into
the number of documents whose failures lie inside a set, so ``zeta[all ^ S]`` are the survivors of the filters ``S``. A
step of an order is then the difference between two neighbouring sets, for documents and labels alike, and a
filter's sum over all orders weights each such difference by the number of orders that pass through it.

The duplicate filter needs the table: the smallest key of a text comes from a partial aggregate over
SHA-256 digests of whole texts, and only digests with a larger key join back, hot ones by broadcast.

Null and empty texts count as empty and equal each other; a null part is the empty string. A null key has no smaller key, is
no smaller key and has no label. Repeated rows count each; the rows of a text's smallest key pass the duplicate filter
all. Several labels of one key: each flag holds if any of them has it; null flags don't. Labels of other keys are ignored. An
empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, whole_text, words_of

#: Failure conditions as SQL over a text ``t`` and its words ``w``. The next letter is the duplicate filter's.
FILTERS = {
    "A": "size(w) < 50",
    "B": "100 * cast(size(array_distinct(w)) AS bigint) < 65 * cast(size(w) AS bigint)",
    "C": "100 * cast(length(t) - length(regexp_replace(t, '[A-Z]', '')) AS bigint) > 5 * cast(length(t) AS bigint)",
    "D": "t RLIKE '[#$%&*|]'",
}
DUPLICATE = "E"
#: Labels and the value that counts.
LABELS = {"quality": 1, "toxic": 1}


def failures(docs: DataFrame, filters: dict[str, str] = FILTERS, duplicate: str | None = DUPLICATE, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(k, part, mask)`` for every row of ``docs``; bit ``i`` of the mask is the ``i``-th filter, the last the duplicate filter."""
    narrow = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("t"))
    split = narrow.withColumn("w", words_of(F.col("t")))
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(filters.values())) or "0"
    scanned = split.select("k", "part", F.expr(f"cast({bits} AS int)").alias("mask"), F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("h"))
    if duplicate is None:
        return scanned.drop("h")
    scanned = durable(scanned)
    shared = scanned.groupBy("h").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    return join_counted(scanned, shared, ["h"], "n").select(
        "k", "part", F.expr(f"mask + CASE WHEN k > least THEN {1 << len(filters)} ELSE 0 END").alias("mask")
    )


def mask_counts(masks: DataFrame, labels: DataFrame, flags: dict[str, int] = LABELS, key: str = "doc_id") -> DataFrame:
    """``(part, mask, n, one column per flag)``: documents, and those among them with each label."""
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.count("*").alias("_labels"), *[F.max(F.coalesce(F.col(c) == v, F.lit(False)).cast("long")).alias(f"l_{c}") for c, v in flags.items()]
    ).drop("_labels")
    return masks.join(marked, "k", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(f"l_{c}"), F.lit(0))).alias(f"l_{c}") for c in flags]
    )


def survivors(counts: DataFrame, k: int, measures: list[str]) -> DataFrame:
    """One row per part: for each measure an array whose entry ``m`` counts the documents that fail filters of ``m`` only.

    The survivors of the filters ``S`` are the entry ``all ^ S``.
    """
    rows = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("by"))
    found = rows.select("part", *[F.expr(f"transform(sequence(0, {2**k - 1}), m -> coalesce(try_element_at(by, m).{c}, 0L))").alias(c) for c in measures])
    for i in range(k):
        without = "transform({c}, (x, m) -> x + CASE WHEN m & {b} <> 0 THEN get({c}, m - {b}) ELSE 0L END)"
        found = found.select("part", *[F.expr(without.format(c=c, b=1 << i)).alias(c) for c in measures])
    return found


def order_steps(sets: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """Every step of every order of the filters ``letters``, as differences between neighbouring sets of ``survivors``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, ``<flag>_lost`` for each flag, shapley.
    """
    k, every = len(letters), 2 ** len(letters) - 1
    orders = " ".join("".join(p) for p in permutations(letters))
    weights = ", ".join(f"{factorial(s) * factorial(k - 1 - s)}L" for s in range(k))
    shares = (
        f"transform(sequence(0, {k - 1}), i -> aggregate(filter(sequence(0, {every}), s -> s & shiftleft(1, i) = 0), 0L, (a, s) -> a + "
        f"get(array({weights}), bit_count(s)) * (get(n, {every} ^ s) - get(n, {every} ^ s ^ shiftleft(1, i)))))"
    )
    steps = (
        sets.withColumn("shares", F.expr(shares))
        .withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("i", F.expr(f"instr('{letters}', substring(filter_order, step, 1)) - 1"))
        .withColumn("bit", F.expr("shiftleft(1, i)"))
        .withColumn("left", F.expr(f"aggregate(transform(sequence(1, step), j -> shiftleft(1, instr('{letters}', substring(filter_order, j, 1)) - 1)), {every}, (a, b) -> a ^ b)"))
    )
    gone = lambda c: F.expr(f"get({c}, left | bit) - get({c}, left)")
    return steps.select(
        "part", "filter_order", "step",
        F.expr("get(n, left)").alias("kept"),
        gone("n").alias("removed"),
        F.expr(f"get(n, {every}) - get(n, {every} ^ bit) - (get(n, left | bit) - get(n, left))").alias("redundant"),
        F.expr("get(n, bit) - get(n, 0)").alias("unique_fails"),
        *[gone(f"l_{c}").alias(f"{c}_lost") for c in flags],
        F.expr("get(shares, i)").alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, duplicate: str | None = DUPLICATE, flags: dict[str, int] = LABELS,
    key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """Every step of every order of ``filters`` (and ``duplicate``), per part. Letters are single characters; ``k`` filters have ``k!`` orders."""
    letters = "".join(filters) + (duplicate or "")
    counts = mask_counts(failures(docs, filters, duplicate, key, text, part), labels, flags, key)
    return order_steps(survivors(counts, len(letters), ["n", *[f"l_{c}" for c in flags]]), letters, list(flags))
