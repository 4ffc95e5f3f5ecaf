"""Operator 4 (native): exact dedup by deterministic block naming.

A text, lower-cased in A-Z, is cut into blocks of fixed size. Equal blocks get one integer name, different blocks
different ones: occurrences are sorted by block, and the smallest occurrence number of a block is its name. Then
adjacent names are paired, and pairs are named in the same way, until each text has a single name. With the
number of blocks it is the text's identity; no hash takes part in it, so identities cannot collide.

A block may occur in a third of all rows. Blocks that occur in more than one in HOT of all occurrences (so fewer than HOT
blocks, a proven bound) are named first, from counts that collapse where the rows lie, and every scan task knows them; their
texts never cross the network. All other texts cross it once, and no task sees more than one in HOT of the occurrences of a block.
Everything after that moves integers. Rounds are written to the shared folder and deleted at the end.

Null texts count as empty (one empty block). Equal texts keep the row with the largest doc_id, null being
smaller than any; of rows that repeat both doc_id and text one stays, in dedup() the one with the smallest hash of all
its columns. Extra columns play no part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import id_keys, materialise, one_of_each, scratch, with_group

#: Characters of a block; blocks that are named ahead; occurrences below which a block is never hot.
BLOCK, HOT, FEW = 8192, 4096, 256


def fold(text: Column) -> Column:
    """The text with A-Z lower-cased. Where all characters are ASCII, lower() is the same and much faster."""
    upper, text = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _blocks(text: Column) -> Column:
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def _hot(rows: DataFrame, keys: list[str], rough: Column, exact: Column | None = None) -> DataFrame | None:
    """The keys of more than max(FEW, one in HOT) of all rows, at most HOT of them, each with a negative name.

    rough: a hash that equal keys share; exact: the key to name where rows hold it in another form than `keys` (one key only).
    """
    counts = materialise(rows.groupBy(rough.alias("_h")).agg(F.count("*").alias("_n")), "key-counts")
    least = max(FEW, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT)
    often = counts.filter(F.col("_n") > least).select("_h")
    if not often.limit(1).count():
        return None
    some = rows.withColumn("_h", rough).join(F.broadcast(often), "_h", "left_semi")
    if exact is not None:
        some = some.select(exact.alias(keys[0]))
    many = some.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    return materialise(many.select(*keys, (-1 - F.row_number().over(Window.orderBy(*keys))).cast("long").alias("_hot")), "hot-keys")


def _named(rows: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """rows: rid, pos, of (parts of the row), carry (a struct at pos 0) and keys -> rid, pos, of, carry, name of the keys."""
    if hot is None:
        is_hot, ahead, group = F.lit(False), F.lit(None).cast("long"), keys
    else:
        rows = rows.join(F.broadcast(hot), keys, "left")
        is_hot, ahead = F.col("_hot").isNotNull(), F.col("_hot")
        empty = {"string": F.lit("")}
        kinds = dict(rows.dtypes)
        # named already: the keys stay behind, and the rows are dealt by their number
        rows = rows.withColumns({k: F.when(is_hot, empty.get(kinds[k], F.lit(0))).otherwise(F.col(k)) for k in keys})
        rows = rows.withColumn("_deal", F.when(is_hot, F.xxhash64("rid", "pos")).otherwise(F.lit(0)))
        group = [*keys, "_deal"]
    rows = rows.withColumn("_occ", F.monotonically_increasing_id())
    name = F.when(is_hot, ahead).otherwise(F.min("_occ").over(Window.partitionBy(*group)))
    return rows.select("rid", "pos", "of", "carry", name.alias("name"))


def identities(docs: DataFrame) -> DataFrame:
    """Per row: rid (unique), doc_id, text_sha256, blocks and name; texts are equal where (blocks, name) is."""
    # blocks are counted by a hash that is the same for texts equal after folding, but cheaper to get
    plain = docs.select(F.explode(_blocks(F.coalesce("text", F.lit("")))).alias("raw"))
    hot = _hot(plain, ["block"], F.xxhash64(F.lower("raw")), fold(F.col("raw")))
    folded = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("text")).alias("t"))
    cut = folded.select("rid", F.struct("doc_id", F.sha2("t", 256).alias("sha")).alias("_carry"), _blocks(F.col("t")).alias("_blocks"))
    cut = cut.select("rid", "_carry", F.size("_blocks").alias("of"), F.posexplode("_blocks").alias("pos", "block"))

    def only_first(x: Column) -> Column:
        return F.when(F.col("pos") == 0, x).alias("carry")

    level = materialise(_named(cut.select("rid", "pos", "of", only_first(F.struct("_carry.*", F.col("of").alias("blocks"))), "block"), ["block"], hot), "block-names")
    done = [level.filter("of = 1")]
    longest = level.agg(F.max("of")).first()[0] or 1
    while longest > 1:
        order = F.array_sort(F.collect_list(F.struct("pos", "name")))
        rows = level.filter("of > 1").groupBy("rid").agg(F.max("carry").alias("_carry"), F.transform(order, lambda x: x["name"]).alias("names"))
        pairs = F.transform(F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)), lambda i: F.struct(F.get("names", i).alias("a"), F.get("names", i + 1).alias("b")))
        each = rows.select("rid", "_carry", F.size(pairs).alias("of"), F.posexplode(pairs).alias("pos", "pair"))
        # a last name without a neighbour is paired with a value that is no name
        each = each.select("rid", "pos", "of", only_first(F.col("_carry")), "pair.a", F.coalesce("pair.b", F.lit(-(2**62))).alias("b"))
        level = materialise(_named(each, ["a", "b"], _hot(each, ["a", "b"], F.xxhash64("a", "b"))), "pair-names")
        done.append(level.filter("of = 1"))
        longest = (longest + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("rid", "carry.doc_id", F.col("carry.sha").alias("text_sha256"), "carry.blocks", "name")


def classes(docs: DataFrame) -> DataFrame:
    """Per row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    with scratch(docs.sparkSession) as keep:
        best = F.max(F.struct("doc_id", "rid"))
        grouped = with_group(identities(docs), ["blocks", "name"], F.col("rid"), {"_best": (best, "max"), "group_size": (F.count("*"), "sum")})
        return keep(grouped.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("_best.rid")).alias("kept"), "text_sha256"), "classes")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all their columns."""
    stay = classes(docs).filter("kept").select(F.col("text_sha256").alias("_sha"), *[c.alias(n) for n, c in id_keys(F.col("doc_id")).items()])
    return one_of_each(docs, stay, **id_keys(F.col("doc_id")), _sha=F.sha2(fold(F.col("text")), 256))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""
