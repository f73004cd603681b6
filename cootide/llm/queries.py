"""Queries pN_ of the operators in this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cootide.session import read_table

INDEX_COLUMNS = ["i0", "i1", "i2", "i3"]
SAMPLE_ROWS = 100_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of each mode that fill at least 0.5 % of the rows with an index there."""
    from .frequent import frequent_exact

    return frequent_exact(read_table(spark, sf_dir, "nonzeros"), INDEX_COLUMNS, 5, 1000).select("mode_no", "idx")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts, as bounds, of the indices that may fill at least 0.1 % of a mode's rows."""
    from .frequent import frequent_items

    return frequent_items(read_table(spark, sf_dir, "nonzeros"), INDEX_COLUMNS, 0.001)


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of the frequent indices, and whether the sketch's bounds hold them."""
    from .frequent import frequent_exact, frequent_items

    x = read_table(spark, sf_dir, "nonzeros")
    exact = frequent_exact(x, INDEX_COLUMNS, 5, 1000)
    bounds = frequent_items(x, INDEX_COLUMNS, 0.005)
    holds = F.coalesce(F.col("n_rows").between(F.col("lower_count"), F.col("upper_count")), F.lit(False))
    return exact.join(bounds, ["mode_no", "idx"], "left").select("mode_no", "idx", "n_rows", holds.alias("holds"))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100,000 records of nonzeros, read delivery by delivery, every record equally likely."""
    from .reservoir import sample_records

    out = sample_records(read_table(spark, sf_dir, "nonzeros"), "nnz_id", "delivery_id", SAMPLE_ROWS, columns=[*INDEX_COLUMNS, "val"])
    return out.withColumn("first_piece", F.col("first_piece").cast("int")).withColumnRenamed("first_piece", "first_delivery_id")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per delivery its records and whether those sampled are as many as chance allows, and are its own records.

    The sample is of a tenth as many records as p2_sample takes, or of a tenth of all if that is fewer. The bound is five
    standard deviations of the hypergeometric number.
    """
    from .reservoir import sample_records

    x = read_table(spark, sf_dir, "nonzeros")
    first = x.where("nnz_id IS NOT NULL").groupBy("nnz_id").agg(F.min(F.coalesce("delivery_id", F.lit(1 << 30))).alias("first"), *[F.min(c).alias(c) for c in [*INDEX_COLUMNS, "val"]])
    n = first.count()
    k = min(SAMPLE_ROWS // 10, n // 10)
    got = sample_records(x, "nnz_id", "delivery_id", k, columns=[*INDEX_COLUMNS, "val"], seed=3)
    got = got.select("nnz_id", F.coalesce(F.col("first_piece").cast("int"), F.lit(1 << 30)).alias("first"), *INDEX_COLUMNS, "val", F.lit(1).alias("taken"))
    same = F.lit(True)
    for c in ("first", *INDEX_COLUMNS, "val"):
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = first.alias("a").join(got.alias("b"), "nnz_id", "left").select(F.col("a.first").alias("first_delivery_id"), "taken", same.alias("same"))
    per = joined.groupBy("first_delivery_id").agg(F.count(F.lit(1)).alias("records"), F.count("taken").alias("taken"), F.count_if(F.col("taken").isNotNull() & ~F.col("same")).alias("foreign"))
    p = F.col("records") / F.lit(max(n, 1))
    spread = F.sqrt(F.lit(float(k)) * p * (1 - p) * (1 - F.lit(k / max(n, 1))))
    return per.select("first_delivery_id", "records", (F.abs(F.col("taken") - k * p) <= 5 * spread + 1).alias("within_chance"), "foreign")


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_count

    return read_table(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("n_tokens"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of every capacity; a text is cut only if it alone exceeds the capacity."""
    from .packing import pack

    return pack(_document_tokens(spark, sf_dir), "doc_id", "n_tokens", read_table(spark, sf_dir, "pack_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, pieces, tokens and the share of space that is used."""
    limits = read_table(spark, sf_dir, "pack_limits")
    used = p7_packing(spark, sf_dir).groupBy("limit_id").agg((F.max("container_id") + 1).alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return used.join(limits, "limit_id").select("limit_id", "capacity_tokens", "containers", "pieces", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def p7_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing measured in characters: pieces and characters per capacity, and what must not occur: containers that hold too
    much or are missing in the numbering, items that lose characters or are cut without need; and whether containers stay
    within 11 / 9 of what is needed at least."""
    from .packing import pack

    limits = read_table(spark, sf_dir, "pack_limits")
    x = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_tokens"))
    packed = pack(x, "doc_id", "n_tokens", limits).join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id")
    boxes = packed.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("held"))
    boxes = boxes.groupBy("limit_id").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"), F.count(F.lit(1)).alias("containers"), (F.max("container_id") + 1 - F.count(F.lit(1))).alias("missing"))
    items = packed.groupBy("limit_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces")).join(x, "doc_id")
    wrong = (F.col("got") != F.col("n_tokens")) | (F.col("pieces") != F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    items = items.groupBy("limit_id").agg(F.count_if(wrong).alias("wrong"))
    need = F.greatest(F.ceil(F.sum("n_tokens") / F.first("capacity_tokens")), F.count_if(F.col("n_tokens") * 2 > F.col("capacity_tokens")))
    all_ = packed.groupBy("limit_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("letters"), need.alias("need"))
    return all_.join(boxes, "limit_id").join(items, "limit_id").select("limit_id", "pieces", "letters", "overfull", "missing", "wrong", (F.col("containers") * 9 <= F.col("need") * 11 + 9).alias("tight"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .mixing import mix, sized

    docs = _document_tokens(spark, sf_dir)
    return mix(sized(docs, "doc_id", "source", F.col("n_tokens")), read_table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of documents, with repeats, of every mix."""
    return _mix(spark, sf_dir)[0].select("mix_name", "source", F.col("key").alias("doc_id"), "copy_no", F.col("size").alias("n_tokens"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the selection reaches."""
    return _mix(spark, sf_dir)[1].withColumnRenamed("used_size", "tokens")


def p8_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target whether no document is taken more often than allowed, and whether the tokens taken are what the rate asks
    for, within five standard deviations of the fractional copies."""
    from .mixing import mix, sized, source_name

    docs = _document_tokens(spark, sf_dir)
    records = sized(docs, "doc_id", "source", F.col("n_tokens"))
    targets = read_table(spark, sf_dir, "mix_targets")
    selection, shares = mix(records, targets)
    caps = targets.select("mix_name", source_name("source").alias("source"), "max_repeats")
    most = selection.groupBy("mix_name", "source", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name", "source").agg(F.max("n").alias("most"))
    whole = records.groupBy("source").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("squares"))
    part = F.col("rate") - F.floor("rate")
    near = F.abs(F.col("used_size") - F.col("rate") * F.col("all")) <= 5 * F.sqrt(F.col("squares") * part * (1 - part)) + 1e-6 * F.col("all")
    x = shares.join(whole, "source", "left").join(most, ["mix_name", "source"], "left").join(caps, ["mix_name", "source"])
    return x.select("mix_name", "source", F.col("target_share"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("capped"), F.coalesce(near, F.col("used_size") == 0).alias("near_rate"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(read_table(spark, sf_dir, "lang_samples"), "lang", "sample_text", docs, "doc_id")
    return languages(docs, "doc_id", "text", model, label="lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label (cue_no 0), and the runs of documents in several languages."""
    from .langid import NONE, declared_language

    x = _languages(spark, sf_dir)
    wrong = F.when(F.col("cue_no") > 0, F.col("mixed")).otherwise((F.col("lang") != NONE) & ~declared_language("label").eqNullSafe(F.col("lang")))
    return x.where(wrong).select("doc_id", "cue_no", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text (cue_no 0) and of every stretch of texts in several languages."""
    return _languages(spark, sf_dir).select("doc_id", "cue_no", "n_cues", "lang", "confidence", "mixed")


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its rows for the whole text, whether stretches follow each other and hold no more cues than the text, and
    whether a text of nothing has no language."""
    from .langid import NONE

    x = _languages(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text")), "doc_id")
    whole, part = F.col("cue_no") == 0, F.col("cue_no") > 0
    per = x.groupBy("doc_id").agg(F.count_if(whole).alias("n_texts"), F.sum(F.when(part, F.col("n_cues"))).alias("cues"), F.max(F.when(whole, F.col("n_cues"))).alias("all_cues"), F.max(F.when(whole, F.col("lang"))).alias("lang"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    sound = (F.coalesce("cues", F.lit(0)) <= F.col("all_cues")) & ((F.col("n") > 0) | (F.col("lang") == NONE))
    return per.select("doc_id", "n_texts", sound.alias("sound"))


MIN_COSINE = 0.78


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cosine at least 0.78 of which one is among the five most similar of the other; exact search."""
    from .neighbours import nearest_rows

    near = nearest_rows(read_table(spark, sf_dir, "factor_rows"), "row_id", "mode_no", "vals", 5, min_cos=MIN_COSINE)
    return near.select(F.least("row", "near_row").alias("row_id_a"), F.greatest("row", "near_row").alias("row_id_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar rows of the same factor matrix for every usable row, pruning relaxed by a factor of 2."""
    from .neighbours import nearest_rows

    near = nearest_rows(read_table(spark, sf_dir, "factor_rows"), "row_id", "mode_no", "vals", 5, factor=2.0)
    return near.select(F.col("grp").cast("int").alias("mode_no"), F.col("row").alias("row_id"), F.col("near_row").alias("near_row_id"), "cosine")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per factor matrix its usable rows, and whether the relaxed search finds nine of ten rows that the exact one finds."""
    from .neighbours import nearest_rows

    x = read_table(spark, sf_dir, "factor_rows")
    exact = nearest_rows(x, "row_id", "mode_no", "vals", 5)
    found = nearest_rows(x, "row_id", "mode_no", "vals", 5, factor=2.0).select("grp", "row", "near_row", F.lit(1).alias("met"))
    both = exact.join(found, ["grp", "row", "near_row"], "left")
    per = both.groupBy("grp").agg(F.count_distinct("row").alias("n_rows"), (F.count("met") >= 0.9 * F.count(F.lit(1))).alias("enough"))
    return per.select(F.col("grp").cast("int").alias("mode_no"), "n_rows", "enough")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of three or more rows linked by cosines of at least 0.78, with the group's smallest row."""
    from .clusters import linked_groups

    return linked_groups(read_table(spark, sf_dir, "factor_rows"), "row_id", "mode_no", "vals", MIN_COSINE, least=3).select(F.col("row").alias("row_id"), F.col("first").alias("first_row_id"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by average linkage over all pairs of rows of a matrix: size and most typical rows."""
    from .clusters import average_clusters

    return average_clusters(read_table(spark, sf_dir, "factor_rows"), "row_id", "mode_no", "vals", MIN_COSINE).select(F.col("grp").cast("int").alias("mode_no"), "first_row_id", "size", "typical_row_ids")


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per factor matrix the rows that clusters hold, and what must hold of clusters: as many typical rows as there are, up to
    three, and each cluster within one group of linked rows."""
    x = p6_clusters(spark, sf_dir)
    groups = read_table(spark, sf_dir, "factor_rows").select("row_id").join(p6_found(spark, sf_dir), "row_id", "left")
    group = F.coalesce("first_row_id", "row_id").alias("grp")
    members = x.select("mode_no", F.col("first_row_id").alias("cluster"), "size", F.explode("typical_row_ids").alias("row_id")).join(groups.select("row_id", group), "row_id")
    inside = members.where("size > 2").groupBy("mode_no", "cluster").agg(F.count_distinct("grp").alias("n")).groupBy("mode_no").agg(F.count_if(F.col("n") > 1).alias("torn"))
    per = x.groupBy("mode_no").agg(F.sum("size").alias("n_rows"), F.count_if(F.size("typical_row_ids") != F.least("size", F.lit(3))).alias("untypical"))
    return per.join(inside, "mode_no", "left").select("mode_no", "n_rows", "untypical", F.coalesce("torn", F.lit(0)).alias("torn"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p1_bounds, p2_sample, p2_shares, p5_found, p5_nearest, p5_recall, p6_found, p6_clusters, p6_sizes, p7_packing, p7_fill, p7_letters, p8_mix, p8_shares, p8_reached, p9_found, p9_languages, p9_texts)}
