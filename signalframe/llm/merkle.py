"""Merkle manifest of a dataset by nested-interval labels.

Every node of a tree carries the interval of leaf ranks that it covers. A node's parent is the node one level up whose interval
contains it; the level's bucket ``lo / fanout^level`` finds it by an equality join. Within a parent, the parent's interval
less the node's own gives two pieces: the children in the left piece and those in the right piece are its siblings. From these
come proofs and roots folded from any leaf, without a walk over the tree per leaf.

Sources are trees of their own; their roots are the leaves of one more tree, so any number of sources and of rows is spread
over tasks. A group is one run of ``fanout`` nodes; nothing larger meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import table
from signalframe.operators.windows import exact_rank
from signalframe.session import durable

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 in lowercase hex of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(lo: Column, hi: Column) -> Column:
    """Digests of the children left and right of [lo, hi) in the parent's row: its interval less the node's."""
    side = lambda inside: F.array_join(F.transform(F.filter("children", inside), lambda c: c["digest"]), "")
    return F.struct(side(lambda c: c["hi"] <= lo).alias("left"), side(lambda c: c["lo"] >= hi).alias("right"))


def build(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, and the trees' roots, from leaves (tree, lo, digest and any other columns).

    Leaf ranks ``lo`` count from 0 within a tree. Level n (from 1) has a row per run of nodes of level n - 1: tree, lo, hi, children
    (in order: lo, hi, digest; on level 1 with the leaves' other columns), digest, and ``lone``: the run is a whole tree's last
    node, which is its root. A level is written before the next is made and is ``fanout`` times smaller.
    """
    carried = [c for c in leaves.columns if c not in ("tree", "lo", "digest")]
    nodes = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "digest", *carried)
    levels, width = [], 1
    while True:
        width *= fanout
        inner = ["lo", "hi", "digest", *(carried if not levels else [])]
        runs = (
            nodes.groupBy("tree", F.floor(F.col("lo") / width).alias("bucket"))
            .agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("children"))
            .withColumn("lo", F.col("children")[0]["lo"])
            .withColumn("hi", F.element_at("children", -1)["hi"])
            .withColumn("lone", (F.size("children") == 1) & (F.col("lo") == 0))
            .withColumn("digest", F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256))
        )
        runs = durable(runs.select("tree", "lo", "hi", "children", "lone", "digest"))
        levels.append(runs)
        nodes = runs.filter(~F.col("lone")).select("tree", "lo", "hi", "digest")
        if nodes.isEmpty():
            break
    roots = None
    for runs in levels:
        own = runs.filter("lone").select("tree", F.col("children")[0]["digest"].alias("root"))
        roots = own if roots is None else roots.unionByName(own)
    return levels, roots


def with_proofs(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Level 1 with ``path``, the siblings (left, right) of the run's node and of its ancestors, upwards, and what ``above`` has.

    ``above`` has tree, path (what is over the tree's root) and any other columns of a tree. Level by level from the top,
    every run is joined to the run one level up whose interval contains its own; a parent has at most ``fanout`` children, so
    no key is hot. Lone runs take what is above their tree: one row per tree.
    """
    none = F.array().cast(PATH)
    others = [c for c in above.columns if c not in ("tree", "path")]
    out = ["tree", "lo", "hi", "children", "lone", "path", *others]
    found = None
    for level in range(len(levels), 0, -1):
        runs = levels[level - 1]
        top = runs.filter("lone").join(above, "tree", "left").withColumn("path", F.coalesce("path", none)).select(*out)
        if found is None:
            found = top
            continue
        width = fanout ** (level + 1)
        rows = runs.filter(~F.col("lone")).select("tree", "lo", "hi", F.col("children").alias("kept"))
        rows = rows.withColumn("bucket", F.floor(F.col("lo") / width))
        parents = found.select(
            F.col("tree").alias("_tree"), F.floor(F.col("lo") / width).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
            "children", F.col("lone").alias("_lone"), F.col("path").alias("_path"), *others,
        )
        same = (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket"))
        inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        own = F.array(pieces(F.col("lo"), F.col("hi")))
        joined = rows.join(parents, same & inside).select(
            "tree", "lo", "hi", F.col("kept").alias("children"), F.lit(False).alias("lone"),
            F.when(F.col("_lone"), F.col("_path")).otherwise(F.concat(own, F.col("_path"))).alias("path"), *others,
        )
        found = joined.unionByName(top)
    return found


def leaf_proofs(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per leaf: its columns, tree, what ``above`` has, and ``path``: its siblings level by level up to the last root."""
    runs = with_proofs(levels, above, fanout)
    others = [c for c in above.columns if c not in ("tree", "path")]
    rows = runs.select("tree", "lone", "path", "children", *others, F.explode("children").alias("leaf"))
    own = F.array(pieces(F.col("leaf.lo"), F.col("leaf.hi")))
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(own, F.col("path")))
    return rows.select("tree", "leaf.*", path.alias("path"), *others)


def proof_digest(path: Column) -> Column:
    """H of the siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"]))), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings; a level without siblings still has its own H."""
    return F.aggregate(path, start, lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changes: dict[str, Column] | None = None,
    changed_where: Column | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, path (siblings upwards), folded_root, verified.

    Where ``changed_where`` holds, ``changes`` replaces fields by other columns for the leaf from which ``folded_root`` is
    folded; leaves, subroots, root and siblings are always those of the rows as they are. ``verified``: the folded root equals
    the root. Leaves ascend by id within a source, null ids last, equal ids by leaf; repeated rows are leaves of their own. A
    null source is a source, the first one. A lone leaf is its source's subroot, a lone subroot the root; their path is shorter
    by that. Very long texts are hashed whole. An empty table gives an empty result. Only the columns named are read.
    """
    values = {f: F.col(f) for f in fields}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        # Null sorts before all others, bytes decide the rest; the mark keeps null and an empty source apart.
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("tree"),
        leaf(*values.values()).alias("leaf"),
        F.when(changed_where, leaf(*{**values, **changes}.values())).alias("changed") if changes else F.lit(None).cast("string").alias("changed"),
    )
    # Written before it is sorted: the sort samples its input, and texts are to be hashed once.
    order = [F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("changed")]
    ranked = exact_rank(durable(rows), order, ("tree",), "rank")
    levels, subroots = build(ranked.select("tree", (F.col("rank") - 1).alias("lo"), F.col("leaf").alias("digest"), "doc_id", "changed"), fanout)

    # The tree of subroots, one leaf per source.
    ranked = exact_rank(subroots.select(F.col("tree").alias("of"), "root"), [F.col("of")], (), "rank")
    top = ranked.select(F.lit("").alias("tree"), (F.col("rank") - 1).alias("lo"), F.col("root").alias("digest"), "of")
    top_levels, root = build(top, fanout)
    nothing = docs.sparkSession.createDataFrame([], f"tree string, path {PATH}")
    above = durable(leaf_proofs(top_levels, nothing, fanout).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot")))
    whole = root.first()  # one digest

    found = leaf_proofs(levels, above, fanout).withColumn("root", F.lit(whole["root"] if whole else None).cast("string"))
    return (
        found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")
        .withColumn("folded_root", folded(F.col("path"), F.coalesce("changed", "leaf")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("changed")
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    found = manifest(table(spark, folder, "documents"), changes={"text": lower_ascii(F.col("text"))}, changed_where=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || {value}, '-')"


def _sql_tree(name: str, leaves: str) -> str:
    """Nodes of all levels of the trees over ``leaves`` (tree, i, digest), and each node's siblings."""
    return f"""
{name} as (
  select 0 as level, tree, i, digest, count(*) over (partition by tree) as size from {leaves}
  union all
  select level + 1, tree, i // 16, sha256(string_agg(digest, '' order by i)), (any_value(size) + 15) // 16
  from {name} where size > 1 group by level, tree, i // 16
),
{name}_beside as (
  select a.level, a.tree, a.i,
         coalesce(string_agg(b.digest, '' order by b.i) filter (where b.i < a.i), '') || '|'
         || coalesce(string_agg(b.digest, '' order by b.i) filter (where b.i > a.i), '') as beside
  from {name} a join {name} b on a.level = b.level and a.tree = b.tree and a.i // 16 = b.i // 16
  where a.size > 1 group by a.level, a.tree, a.i
),
{name}_path as (
  select l.tree, l.i, coalesce(list(s.beside order by s.level) filter (where s.level is not null), []) as path
  from {leaves} l left join {name}_beside s on l.tree = s.tree and s.i = l.i // cast(pow(16, s.level) as bigint)
  group by l.tree, l.i
)"""


_BITS = "lambda c, z: xor(c >> 1, 3988292384 * (c & 1))"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), "
    f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), {_BITS})))"
)
OP12_SQL = f"""
with recursive d as (
  select doc_id, coalesce('=' || source, '-') as tree,
         sha256({" || ".join(map(_sql_field, FIELDS))}) as digest,
         sha256({" || ".join(map(_sql_field, FIELDS[:-1]))} || {_sql_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as changed,
         {_CRC} % 5 = 0 as tampered
  from documents
),
l as (select *, row_number() over (partition by tree order by doc_id) - 1 as i from d),
{_sql_tree("n", "l")},
u as (select tree as of, digest, '' as tree, row_number() over (order by tree) - 1 as i from n where size = 1),
{_sql_tree("t", "u")},
r as (
  select l.doc_id, l.digest as leaf, u.digest as subroot, (select digest from t where size = 1) as root, list_concat(p.path, q.path) as path,
         case when l.tampered then l.changed else l.digest end as start
  from l join n_path p on l.tree = p.tree and l.i = p.i join u on u.of = l.tree join t_path q on u.tree = q.tree and u.i = q.i
)
select doc_id, leaf, subroot, root, sha256(replace(list_aggregate(list_prepend('', path), 'string_agg', ''), '|', '')) as proof_sha256,
       list_reduce(list_prepend(start, path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) as folded_root,
       folded_root = root as verified
from r
"""
