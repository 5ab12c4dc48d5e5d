"""Merkle manifest of a table: leaves by row, a tree for each group, a tree over the groups' roots, and a proof a row.

H is lowercase hex sha256.  A leaf is H of the row's columns one after the other, each `-` if null, else its number of
UTF-8 bytes, a colon and the value.  Within a group leaves ascend by key; every `fan` consecutive nodes (the last run may
be shorter) become their H, until one is left; the groups' roots, in order of the group (null first), likewise.

Window-based levels: a level's nodes are partitioned by (group, parent's number), and one ordered full-frame collect_list
gives the parent's preimage and each node's siblings at once; the first node of a run carries the parent to the next
level.  Then paths go down: each level joins its parents' paths, so a row gets all siblings up to the root.

Scale: rows get their numbers by ranges of (group, key, leaf), each range with its start, so a hot group spreads over as
many tasks as its rows need; window partitions have at most `fan` rows; a level has 1/fan of the rows below.  Texts are
read once and never shuffled; what is shuffled of a row are digests.  To the driver come the size of the largest group,
the number of groups and the root.

Defined results: null values hash as `-`; null groups are a group of their own, null keys come first; rows of equal key
are ordered by leaf, and rows equal in all hashed columns share leaf and get proofs of neighbouring places; a row without
any sibling has H of nothing as its proof; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm.common import parts_of, staged, table

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_hash(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def numbered(df: DataFrame, order: list[Column], by: str | None = None) -> DataFrame:
    """df with i (place in the order within each by, from 0) and n (rows of that by), by ranges with a start each."""
    ranged = df.repartitionByRange(parts_of(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = staged(ranged, "ranges")
    part = F.shiftrightunsigned("_id", 33)
    group = F.col(by) if by else F.lit(0)
    counts = ranged.groupBy(part.alias("_p"), group.alias("_g")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", "_g", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("_g")).alias("n"))
    same = (part == F.col("_p")) & group.eqNullSafe(F.col("_g"))
    return ranged.join(starts, same).select(*df.columns, (F.col("_id") - F.col("_first") + F.col("_start")).alias("i"), "n")


def _parent(fan: int) -> Column:
    return F.floor(F.col("i") / fan).cast("long")


def levels(nodes: DataFrame, most: int, fan: int = FAN) -> list[DataFrame]:
    """The levels of the trees over nodes (g, i, n, h and others, kept on the first level): each with before and after,
    the siblings' digests.  most: the nodes of the largest group."""
    out = []
    while True:
        run = Window.partitionBy("g", _parent(fan)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("i") % fan).cast("int")
        rows = nodes.withColumn("run", F.collect_list("h").over(run))
        before, after = F.array_join(F.slice("run", F.lit(1), at), ""), F.array_join(F.slice("run", at + 2, F.lit(fan)), "")
        rows = rows.withColumns({"before": before, "after": after, "up": F.when(at == 0, F.sha2(F.array_join("run", ""), 256))})
        out.append(staged(rows.drop("run"), f"level{len(out)}"))
        if most <= 1:
            return out
        most = -(-most // fan)
        nodes = out[-1].where((F.col("n") > 1) & (F.col("i") % fan == 0)).select("g", _parent(fan).alias("i"), F.ceil(F.col("n") / fan).cast("long").alias("n"), F.col("up").alias("h"))


def tops(tables: list[DataFrame]) -> DataFrame:
    """g, level, h of every group's root."""
    found = None
    for k, t in enumerate(tables):
        one = t.where("n = 1").select("g", F.lit(k).alias("level"), "h")
        found = one if found is None else found.unionByName(one)
    return found


def descend(tables: list[DataFrame], roots: DataFrame, carried: list[str], fan: int = FAN) -> DataFrame:
    """The first level's rows with path (their siblings up to the end of the root's own path) and what roots (g, level,
    path and the carried columns) carry."""
    above = None
    for k in reversed(range(len(tables))):
        keys = roots.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("p"), "path", *carried)
        if above is not None:
            keys = keys.unionByName(above.select("g", F.col("i").alias("p"), "path", *carried))
        rows = tables[k].withColumn("p", _parent(fan)).join(keys, ["g", "p"])
        step = F.array(F.struct("before", "after"))
        above = rows.withColumn("path", F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")))
    return above


def manifest(docs: DataFrame, *, columns=COLUMNS, group: str = "lang", key: str = "doc_id", fan: int = FAN, also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, path (array of before, after), subroot, root for every row of docs, and the further columns `also`,
    computed where docs are read.  fold(leaf, path) is root; anyone with a row and its path can check it."""
    also = also or {}
    kind = docs.schema[group].dataType
    values = {c: F.col(c) for c in columns}
    leaves = staged(docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf_of(list(values.values())).alias("h"), *(c.alias(n) for n, c in also.items())), "leaves")
    placed = staged(numbered(leaves, [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("h")], "grp"), "placed")
    sizes = placed.where("i = 0").select("grp", F.col("n").alias("size"))
    groups = staged(numbered(sizes, [F.col("grp").asc_nulls_first()]).select(F.col("grp").cast(kind).alias("_grp"), F.col("i").alias("g"), "size"), "groups")
    most, n_groups = groups.agg(F.max("size"), F.count("*")).first()
    empty = f"key {docs.schema[key].dataType.simpleString()}, leaf string, path array<{_STEP}>, subroot string, root string"
    spark = docs.sparkSession
    if not n_groups:
        return spark.createDataFrame([], empty).select("*", *(F.lit(None).cast(leaves.schema[n].dataType).alias(n) for n in also))
    nodes = placed.join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).select("g", "i", "n", "h", "key", *also)
    own = levels(nodes, most, fan)
    roots = staged(tops(own), "subroots")
    above = levels(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups).cast("long").alias("n"), "h", F.col("g").alias("member")), n_groups, fan)
    root = above[-1].where("n = 1").first()["h"]
    no_path = F.array().cast(f"array<{_STEP}>")
    upper = descend(above, spark.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(len(above) - 1).alias("level"), no_path.alias("path")), [], fan)
    joined = roots.join(upper.select(F.col("member").alias("g"), "path"), "g").select("g", "level", "path", F.col("h").alias("subroot"))
    out = descend(own, staged(joined, "paths"), ["subroot"], fan)
    return out.select("key", F.col("h").alias("leaf"), "path", "subroot", F.lit(root).alias("root"), *also)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the manifest of all documents; where 3 divides crc32(doc_id), the text is lower-cased before it is checked."""
    docs = table(spark, sf_dir, "documents")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lower = F.when(changed, leaf_of([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]))
    out = manifest(docs, also={"claimed": lower})
    back = folded(F.coalesce("claimed", "leaf"), F.col("path"))
    checked = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _oracle() -> str:
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    tree = lambda base: f"{base} UNION ALL SELECT l + 1, g, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {{name}}) WHERE n > 1 GROUP BY l, g, i // {FAN}"
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1]))"
    return f"""WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed, lang FROM documents, crc),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
placed AS MATERIALIZED (SELECT r, doc_id, leaf, claimed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
low AS ({tree("SELECT 0 AS l, g, i, leaf AS h FROM placed").format(name="low")}),
subroots AS (SELECT g, arg_max(h, l) AS h, max(l) AS l FROM low GROUP BY g),
high AS ({tree("SELECT 0 AS l, 0 AS g, g AS i, h FROM subroots").format(name="high")}),
nodes AS MATERIALIZED (SELECT l, g, i, h FROM low UNION ALL SELECT l, -1, i, h FROM high),
root AS (SELECT arg_max(h, l) AS h, max(l) AS l FROM high),
steps AS MATERIALIZED (SELECT p.r, k.l AS pos, p.g, p.i AS own, k.l AS l FROM placed p JOIN subroots s ON s.g = p.g JOIN range(0, 64) k(l) ON k.l < s.l
  UNION ALL SELECT p.r, s.l + k.l, -1, p.g, k.l FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN root JOIN range(0, 64) k(l) ON k.l < root.l),
family AS MATERIALIZED (SELECT t.r, t.pos, n.i, n.h, n.i = t.own // CAST({FAN} ** t.l AS BIGINT) AS self FROM steps t JOIN nodes n ON n.g = t.g AND n.l = t.l AND n.i // {FAN} = (t.own // CAST({FAN} ** t.l AS BIGINT)) // {FAN}),
proofs AS (SELECT r, sha256(string_agg(h, '' ORDER BY pos, i)) AS proof FROM family WHERE NOT self GROUP BY r),
fold AS (SELECT r, CAST(0 AS BIGINT) AS pos, coalesce(claimed, leaf) AS h FROM placed
  UNION ALL SELECT f.r, f.pos + 1, sha256(string_agg(CASE WHEN m.self THEN f.h ELSE m.h END, '' ORDER BY m.i)) FROM fold f JOIN family m ON m.r = f.r AND m.pos = f.pos GROUP BY f.r, f.pos),
ends AS (SELECT r, arg_max(h, pos) AS h FROM fold GROUP BY r)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN root JOIN ends e ON e.r = p.r LEFT JOIN proofs q ON q.r = p.r"""


ORACLE = _oracle()
