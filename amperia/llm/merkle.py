"""A manifest of hashes over a table of documents: a tree for each source, a tree of the sources' roots, and each document's proof.

Spark hashes the rows, numbers them in each source and gathers aligned blocks of ARITY ** LEVELS consecutive nodes, one row each. On the executors DuckDB turns Arrow batches of blocks into block roots (string_agg in order, then sha256, level by level); these are the nodes of the next round, until every source has one node. Going down again, the proofs of blocks are joined to their blocks, and DuckDB takes the siblings of every node from the strings that its levels hash. A block never grows with the data, so neither does a task; the rounds are as many as the logarithm of the rows to base 4,096.

Rows are ordered in a source by doc_id (null first), ties by leaf: rows that repeat are leaves each. A null source is a source, before all others; null or empty texts are hashed as such. An empty table gives an empty result. Columns of other names are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Nodes in a run, and levels that are hashed inside a block.
ARITY, LEVELS = 16, 3
#: Blocks that DuckDB gets at once, if full.
BLOCKS_AT_ONCE = 8
#: Documents taken as tampered with: where this divides crc32 of doc_id as text.
TAMPERED = 5

#: The result of a slice of blocks and what a query found of it.
Slice = Callable[[pa.Table, pa.Table], pa.Table]


# -- leaves and their places ------------------------------------------------------------------------


def leaf(*values: Column) -> Column:
    """Hash of values, each as byte count, colon, text; a null as a hyphen."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """of (the source), doc_id, h (the leaf), other (the leaf of the tampered row, where it is another)."""
    own = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, leaf(*own, ascii_lower(F.col("text"))))
    return docs.select(F.struct("source").alias("of"), "doc_id", leaf(*own, F.col("text")).alias("h"), changed.alias("other"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place in of by order, from 0, and n, how many of has.

    Rows are sorted in range partitions and numbered there; then one row for each partition and of tells where it begins.
    """
    ranged = rows.repartitionByRange("of", *order).sortWithinPartitions("of", *order)
    placed = written(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "merkle-rows")
    parts = placed.groupBy("of", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by = W.partitionBy("of")
    before = F.sum("_n").over(by.orderBy("_first").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("of", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(by).alias("n"))
    return placed.join(starts, ["of", "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias("pos"), "n")


def blocks(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    """One row for each aligned block of ARITY ** levels nodes (of, pos, n, h): of, block, n, and h and columns as arrays in order of pos."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "h", *columns)))
    rows = nodes.groupBy("of", F.expr(f"pos div {ARITY**levels}").alias("block")).agg(F.first("n").alias("n"), packed.alias("nodes"))
    return written(rows.select("of", "block", "n", *(F.col(f"nodes.{x}").alias(x) for x in ("h", *columns))), "merkle-blocks")


# -- the block engine: DuckDB over Arrow batches ----------------------------------------------------


def height(n: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def _leveled(t: pa.Table, most: int) -> pa.Table:
    """An Arrow table of blocks with b, their numbers, and levels, how many are hashed inside each."""
    levels = [min(most, height(n)) for n in t.column("n").to_pylist()]
    return t.append_column("b", pa.array(range(t.num_rows), pa.int64())).append_column("levels", pa.array(levels, pa.int64()))


def _level_queries(levels: int, *columns: str) -> list[str]:
    """l0: nodes of blocks; for each level k, r{k}: the strings of runs, l{k}: their hashes."""
    more = "".join(f", unnest({x}) AS {x}" for x in columns)
    ctes = [f"l0 AS (SELECT b, levels, generate_subscripts(h, 1) - 1 AS i, unnest(h) AS h{more} FROM blocks)"]
    for k in range(1, levels + 1):
        ctes.append(f"r{k} AS MATERIALIZED (SELECT b, levels, i // {ARITY} AS i, string_agg(h, '' ORDER BY i) AS run FROM l{k - 1} WHERE levels >= {k} GROUP BY ALL)")
        ctes.append(f"l{k} AS (SELECT b, levels, i, sha256(run) AS h FROM r{k})")
    return ctes


def _sides(run: str, pos: str) -> tuple[str, str]:
    """What stands before and after a node in the string of its run."""
    return f"left({run}, 64 * {pos})", f"substr({run}, 64 * {pos} + 65)"


def _place(k: int) -> str:
    return f"((i // {ARITY ** (k - 1)}) % {ARITY})"


def _root_query(levels: int) -> str:
    """b and the root of every block."""
    tops = " UNION ALL ".join(f"SELECT b, h FROM l{k} WHERE levels = {k}" for k in range(levels + 1))
    return f"WITH {', '.join(_level_queries(levels))} SELECT b, h FROM ({tops}) ORDER BY b"


def _with_runs(levels: int, *columns: str) -> str:
    """Every node of the blocks with the strings of the runs above it, run1, run2, ..., null where its tree is lower."""
    joins = "".join(f" LEFT JOIN r{k} ON r{k}.b = l0.b AND r{k}.i = l0.i // {ARITY**k}" for k in range(1, levels + 1))
    own = ", ".join(f"l0.{x}" for x in ("b", "i", "h", *columns))
    return f"WITH {', '.join(_level_queries(levels, *columns))} SELECT {own}, {', '.join(f'r{k}.run AS run{k}' for k in range(1, levels + 1))} FROM l0{joins}"


def _proof_query(levels: int) -> str:
    """i, places (in runs) and beside (what stands there, without the node) of every node, up to the root."""
    each = [(k, *_sides(f"run{k}", _place(k))) for k in range(1, levels + 1)]
    at = ", ".join(_place(k) for k, _, _ in each)
    beside = ", ".join(f"{left} || {right}" for _, left, right in each)
    return f"SELECT n.b, i, list_concat(list_slice([{at}], 1, levels), o.places)::BIGINT[] AS places, list_concat(list_slice([{beside}], 1, levels), o.beside) AS beside FROM ({_with_runs(levels)}) n JOIN blocks o ON n.b = o.b ORDER BY n.b, i"


def _leaf_query(levels: int, outer: int) -> str:
    """proof_sha256 and folded_root of every leaf; outer: levels above the blocks at most. A fold puts what was hashed before in its place among the siblings."""
    inner = [(f"run{k}", *_sides(f"run{k}", _place(k))) for k in range(1, levels + 1)]
    proof = " || ".join(f"coalesce({left} || {right}, '')" for _, left, right in inner)
    folds = [f"p0 AS (SELECT n.b, i, n.doc_id, n.h, sha256({proof} || array_to_string(o.beside, '')) AS proof_sha256, coalesce(n.other, n.h) AS f, {', '.join(x for x, _, _ in inner)}, o.places, o.beside FROM ({_with_runs(levels, 'doc_id', 'other')}) n JOIN blocks o ON n.b = o.b)"]
    outside = [(f"beside[{k}]", f"left(beside[{k}], 64 * places[{k}])", f"substr(beside[{k}], 64 * places[{k}] + 1)") for k in range(1, outer + 1)]
    for k, (there, left, right) in enumerate([*inner, *outside], 1):
        folds.append(f"p{k} AS (SELECT * REPLACE (CASE WHEN {there} IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f) FROM p{k - 1})")
    return f"WITH {', '.join(folds)} SELECT b, doc_id, h, proof_sha256, f FROM p{len(folds) - 1} ORDER BY b, i"


def _engine(levels: int, query: Callable[[pa.Table], str], out: Slice) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that puts slices of blocks, of so many nodes or one block, through a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, most = duckdb.connect(config={"threads": 1}), BLOCKS_AT_ONCE * ARITY**levels
        for batch in batches:
            t = _leveled(pa.Table.from_batches([batch]), levels)
            sizes, begin = pc.list_value_length(t.column("h")).to_pylist(), 0
            while begin < t.num_rows:
                end, n = begin + 1, sizes[begin]
                while end < t.num_rows and n + sizes[end] <= most:
                    n, end = n + sizes[end], end + 1
                some = t.slice(begin, end - begin)
                some = some.set_column(some.schema.get_field_index("b"), "b", pa.array(range(some.num_rows), pa.int64()))
                con.register("blocks", some)
                found = con.sql(query(some)).to_arrow_table()
                con.unregister("blocks")
                yield from out(some, found).to_batches()
                begin = end
        con.close()

    return run


def _roots(size: int) -> Slice:
    def out(blocks: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("b")
        up = pa.array([-(-n // size) for n in blocks.column("n").to_pylist()], pa.int64())
        return pa.table({"of": blocks.column("of").take(at), "pos": blocks.column("block").take(at), "n": up.take(at), "h": found.column("h")})

    return out


def _proofs(size: int) -> Slice:
    def out(blocks: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("b")
        pos = pc.add(pc.multiply(blocks.column("block").take(at), size), found.column("i").cast(pa.int64()))
        return pa.table({"of": blocks.column("of").take(at), "pos": pos, "root": blocks.column("root").take(at), "places": found.column("places"), "beside": found.column("beside")})

    return out


def _digests(blocks: pa.Table, found: pa.Table) -> pa.Table:
    return pa.table({"doc_id": found.column("doc_id"), "leaf": found.column("h"), "subroot": blocks.column("root").take(found.column("b")), "proof_sha256": found.column("proof_sha256"), "folded_root": found.column("f")})


# -- trees ------------------------------------------------------------------------------------------


def _of(df: DataFrame) -> str:
    return df.schema["of"].dataType.simpleString()


def grown(lowest: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, from the lowest ones up, and the roots: of, pos (0), n (1), h."""
    rounds, up = [lowest], _engine(levels, lambda _: _root_query(levels), _roots(ARITY**levels))
    while True:
        nodes = written(rounds[-1].select("of", "block", "n", "h").mapInArrow(up, f"of {_of(lowest)}, pos long, n long, h string"), "merkle-roots")
        if nodes.filter("n > 1").isEmpty():
            return rounds, nodes
        rounds.append(blocks(nodes, levels))


def proven(rounds: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Proofs (root, places, beside) of the nodes (of, pos) that the rounds begin with; outer: those of the roots."""
    down = _engine(levels, lambda _: _proof_query(levels), _proofs(ARITY**levels))
    for r in reversed(rounds):
        joined = r.select("of", "block", "n", "h").join(outer.withColumnRenamed("pos", "block"), ["of", "block"])
        outer = joined.mapInArrow(down, f"of {_of(r)}, pos long, root string, places array<long>, beside array<string>")
    return outer


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot (of its source), root, proof_sha256 and folded_root of every row; blocks have ARITY ** levels nodes, whatever the tree."""
    rounds, subroots = grown(blocks(numbered(leaves(docs), ["doc_id", "h"]), levels, "doc_id", "other"), levels)
    tops = written(numbered(subroots.select(F.struct(F.lit(0)).alias("of"), F.col("of").alias("source"), "h"), ["source"]), "merkle-sources")
    upper, top = grown(blocks(tops, levels), levels)
    none = [F.expr(f"cast(array() as array<{kind}>)").alias(name) for name, kind in (("places", "long"), ("beside", "string"))]
    of_sources = tops.select("of", "pos", "source", "h").join(proven(upper, top.select("of", "pos", F.col("h").alias("root"), *none), levels), ["of", "pos"])
    # Proofs of sources go on to their blocks and leaves, with the source's own root.
    outer = of_sources.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("pos"), F.col("h").alias("root"), "places", "beside")
    joined = rounds[0].join(proven(rounds[1:], outer, levels).withColumnRenamed("pos", "block"), ["of", "block"])
    fold = lambda t: _leaf_query(levels, max(pc.list_value_length(t.column("places")).to_pylist(), default=0))
    rows = joined.mapInArrow(_engine(levels, fold, _digests), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return rows.crossJoin(F.broadcast(top.select(F.col("h").alias("root"))))  # one row


def op12_merkle(docs: DataFrame) -> DataFrame:
    return manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
