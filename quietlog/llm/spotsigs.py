"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A spot is a common word (an article, a preposition, ...) with the CHAIN content words after it, other common words passed over. A text's
signature is the set of its spots, hashed to 32 bits; a text without any spot has its words instead. Running text is rich in
anchors and menus, lists and boilerplate are poor in them, so the set follows the prose.

All of it is Spark SQL: words by split, common words by a hash set, chains from the positions of content words (the common words between two of
them share one chain, so time is linear however long their run), likeness by array_intersect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm.store import shuffle_width, written

COMMON = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con de del el ella en era es esta este ha la las lo los más me mi muy no para pero por que se si sin sobre su sus un una y ya"
)
CHAIN = 2
NEVER = -(2**63)
#: Keys of documents that one task puts in order.
RANGE_KEYS = 1_000_000


def with_signature(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the signature of a text column, null as empty."""
    words = f"filter(split(lower(coalesce({text}, '')), r'[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
    listed = ", ".join("'" + w + "'" for w in sorted(set(COMMON.split())))
    at = f"{to}_at"
    # Of each content word that CHAIN - 1 others follow, the common words since the content word before it are the anchors.
    chain = ", ".join(f"' ', {to}[{at}[k + {n}]]" for n in range(CHAIN))
    anchors = f"transform(sequence(coalesce(get({at}, k - 1), -1) + 1, p - 1), i -> cast(shiftright(xxhash64(concat('\\u0001', {to}[i], {chain})), 32) as int))"
    spots = f"flatten(transform({at}, (p, k) -> if(k + {CHAIN} <= size({at}) and p - coalesce(get({at}, k - 1), -1) > 1, {anchors}, cast(array() as array<int>))))"
    df = df.withColumn(to, F.expr(words))
    df = df.withColumn(at, F.expr(f"filter(transform({to}, (w, i) -> if(w in ({listed}), null, i)), i -> i is not null)"))
    df = df.withColumn(f"{to}_spots", F.expr(spots))
    return df.withColumn(to, F.expr(f"array_sort(array_distinct(if(size({to}_spots) > 0, {to}_spots, transform({to}, w -> cast(shiftright(xxhash64(w), 32) as int)))))")).drop(f"{to}_spots", at)


def as_text(spots: str) -> Column:
    """A signature as hexadecimal digits, eight a spot."""
    return F.expr(f"lower(array_join(transform({spots}, x -> lpad(hex(cast(x as bigint) & 4294967295), 8, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signatures; 1 for two empty ones."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double))")


def following(keys: DataFrame) -> DataFrame:
    """keys (did, th, n_chars, without repeats) with next_did, next_th: the next key in descending order, after the last the first.

    Keys are cut into ranges of about equal numbers, whatever the ids are, of at most RANGE_KEYS or so, so no task sees the whole order; only each range's first key is looked at across ranges."""
    spark = keys.sparkSession
    n = keys.count()
    ranges = max(1, min(shuffle_width(spark), n // 1024), -(-n // RANGE_KEYS))
    keys = written(keys.repartitionByRange(ranges, F.desc("did"), F.desc("th")).withColumn("range", F.spark_partition_id()), "order")
    key = F.struct("did", "th")
    inside = Window.partitionBy("range").orderBy(F.desc("did"), F.desc("th"))
    heads = keys.groupBy("range").agg(F.max(key).alias("head"))
    every = Window.partitionBy(F.lit(0))
    across = heads.select("range", F.coalesce(F.lead("head").over(every.orderBy("range")), F.max("head").over(every)).alias("then"))
    keys = keys.withColumn("after", F.lead(key).over(inside)).join(across, "range")  # a row per range: small enough for any join
    return keys.select("did", "th", "n_chars", F.coalesce("after.did", "then.did").alias("next_did"), F.coalesce("after.th", "then.th").alias("next_th"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (rounded down) replaced by as many first characters of the next document in descending doc_id, or all
    of it if shorter. A null text counts as empty. A null doc_id comes last. Rows with one doc_id are ordered by a hash of the text;
    rows equal in both are one document and get equal results. A single document follows itself. Other columns are not read.
    Texts are shuffled once, and the pieces that go from a document to the one before it once."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = rows.groupBy("did", "th").agg(F.first(F.length("text").cast("long")).alias("n_chars"))
    gives = following(keys).select(F.col("next_did").alias("did"), F.col("next_th").alias("th"), F.col("did").alias("to_did"), F.col("th").alias("to_th"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    given = with_signature(rows.join(gives, ["did", "th"]), "text", "next_spots")
    given = given.select(F.col("to_did").alias("did"), F.col("to_th").alias("th"), F.expr("left(text, need)").alias("piece"), "next_spots").dropDuplicates(["did", "th"])
    df = with_signature(rows.join(given, ["did", "th"]), "text", "spots")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(piece, cast(n_chars div 3 as int)))"))
    df = with_signature(df, "edited", "edited_spots")
    return df.select(
        F.nullif("did", F.lit(NEVER)).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("spots").alias("fingerprint"),
        as_text("edited_spots").alias("edited_fingerprint"), likeness("spots", "edited_spots").alias("near_edited"), likeness("spots", "next_spots").alias("near_next"),
    )


def similar_pairs(signatures: DataFrame, similar: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of distinct signatures (fp, spots) of at least that Jaccard similarity; a and b are their fp.

    Signatures fall into partitions of set length whose bounds grow by 1/similar: a set can only match sets in its own partition or the next.
    Of each, only the first |s| - ceil(similar * |s|) + 1 spots in the common order are joined, in which two such sets must meet. Equal signatures,
    of copies, are one row here. Empty ones match nothing."""
    sets = signatures.select("fp", "spots").dropDuplicates(["fp"]).where(F.size("spots") > 0)
    size = F.size("spots")
    sets = sets.withColumn("part", F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / similar)) + 1e-9).cast("int"))
    heads = sets.select("fp", "part", size.alias("size"), F.explode(F.slice("spots", F.lit(1), size - F.ceil(size * similar - 1e-9).cast("int") + 1)).alias("spot"))
    one = heads.select(F.col("fp").alias("a"), F.col("size").alias("na"), "spot", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    two = heads.select(F.col("fp").alias("b"), F.col("size").alias("nb"), "spot", "part")
    met = one.join(two, ["spot", "part"]).where("a <> b and (na < nb or (na = nb and a < b))").where(F.col("na") >= similar * F.col("nb") - 1e-9).select("a", "b").distinct()
    met = met.join(sets.select(F.col("fp").alias("a"), F.col("spots").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("spots").alias("sb")), "b")
    return met.withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= similar - 1e-9).select("a", "b", "likeness")


def op8_spotsigs_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
