"""A Merkle manifest of a dataset whose proofs are made without a pass down the tree.

Every row is a leaf; the leaves of a source, in the order of their ids, and then the roots of all
sources, in the order of their names, are folded ``FANOUT`` at a time until one node is left. A
tree is dealt to blocks of ``FANOUT ** LEVELS`` neighbouring leaves. A block folds its own leaves.
Then blocks meet in a butterfly: in round r, blocks whose numbers differ only in digit r (to the
base ``FANOUT``) swap the nodes they hold. All of them hash the same parent, each for itself, and
note the nodes to both sides of their own. A round doubles no work but that hash, and after the
last one every block holds the root and the upper part of all its leaves' proofs.

Where the last node of a level covers fewer blocks than the others, its blocks also send it to
the groups they have no member in. Groups have at most ``FANOUT`` nodes, blocks a fixed number of
leaves; places of leaves come from a range sort, so a hot source is many blocks and no task.
Rounds are written to the shared folder, so a lost executor costs the tasks it had.

Defined cases: nulls in any column are fields of their own (``-``); a null source is a source of
its own, before all others; null ids come first in their source. Rows with equal ids follow each
other by their leaf; equal rows are leaves each. An only leaf is the root of its source, an only
source that of the dataset. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.ranks import sorted_once, with_places
from keepsake.session import settle

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"
STEPS = f"array<{STEP}>"


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows have the same bytes; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def block_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The node of each block ``t, block, n_blocks`` from leaves ``t, n, pos, hash``; runs have at most ``fanout`` nodes."""
    size = fanout ** levels
    nodes = leaves.select("t", "n", F.expr(f"pos div {size}").alias("block"), F.col("pos").alias("at"), "hash").repartition("t", "block")
    for k in range(levels):
        kids = nodes.groupBy("t", "block", "n", F.expr(f"at div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("kids"))
        # a tree is folded while it has several nodes
        folded = F.when(F.col("n") <= fanout ** k, F.col("kids")[0]["hash"]).otherwise(F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256))
        nodes = kids.select("t", "n", "block", F.col("up").alias("at"), folded.alias("hash"))
    return nodes.select("t", "block", F.ceil(F.col("n") / size).cast("long").alias("n_blocks"), F.col("hash").alias("node"))


def swapped(blocks: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: each node of a group of blocks reaches all of them, and they hash its parent.

    ``width`` is the number of blocks below a full node of this round.
    """
    number = F.expr(f"block div {width}")
    sent = blocks.select(
        "t", "n_blocks", "node", F.struct("block", "path").alias("own"),
        (number % fanout).alias("digit"), F.expr(f"block div {width * fanout}").alias("up"), (F.col("block") % width).alias("low"),
    )
    below = F.col("n_blocks") - (F.col("up") * fanout + F.col("digit")) * width
    short = sent.filter((F.col("digit") > 0) & (below < width) & (F.col("low") + below < width))
    lent = short.withColumn("low", F.explode(F.sequence(F.col("low") + below, F.lit(width - 1).cast("long"), below)))
    met = sent.union(lent.withColumn("own", F.lit(None).cast(sent.schema["own"].dataType)).select(*sent.columns))
    groups = met.groupBy("t", "n_blocks", "up", "low").agg(F.sort_array(F.collect_list(F.struct("digit", "node", "own"))).alias("kids"))
    groups = groups.withColumn("nodes", F.transform("kids", lambda x: x["node"]))
    members = groups.filter(F.exists("kids", lambda x: x["own"].isNotNull())).select(
        "t", "n_blocks", F.sha2(F.array_join("nodes", ""), 256).alias("node"), "nodes", F.posexplode("kids").alias("i", "kid"),
    ).filter("kid.own is not null")
    step = F.struct(
        F.array_join(F.slice("nodes", F.lit(1), F.col("i")), "").alias("before"),
        F.array_join(F.slice("nodes", F.col("i") + 2, F.lit(fanout)), "").alias("after"),
    )
    return members.select("t", F.col("kid.own.block").alias("block"), "n_blocks", "node", F.concat(F.col("kid.own.path"), F.array(step)).alias("path"))


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """Blocks ``t, block, n_blocks, node`` with their ``path`` to the root of their tree, which is then their ``node``."""
    blocks = settle(blocks.withColumn("path", F.lit(None).cast(STEPS)).withColumn("path", F.coalesce("path", F.array().cast(STEPS))), "blocks")
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while width < most:
        going = F.col("n_blocks") > width
        blocks = settle(swapped(blocks.filter(going), width, fanout).unionByName(blocks.filter(~going)), "round")
        width *= fanout
    return blocks


def steps_in_block(hashes: list[str], n: int, fanout: int, levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block, the nodes before and after its own on every level inside the block."""
    from hashlib import sha256

    rows, k = [hashes], 0
    while k < levels and n > fanout ** k:
        below = rows[-1]
        rows.append([sha256("".join(below[i:i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
        k += 1
    sides = []
    for level in rows[:k]:
        of_level = []
        for i in range(0, len(level), fanout):
            line = "".join(level[i:i + fanout])
            of_level += [(line[:64 * j], line[64 * j + 64:]) for j in range(len(level[i:i + fanout]))]
        sides.append(of_level)
    for i in range(len(hashes)):
        yield [of_level[i // fanout ** j] for j, of_level in enumerate(sides)]


def proved(leaves: DataFrame, uppers: DataFrame, answer, schema: str, fanout: int, levels: int, columns: list[str]) -> DataFrame:
    """Each leaf with its whole path, block by block: a block's upper part comes first, then its leaves in order.

    ``leaves`` has ``t, n, pos, hash`` and ``columns``, ``uppers`` ``t, block, path`` and other columns.
    ``answer(upper, rows, paths)`` gives the rows of a block as an Arrow batch; a block is all it holds.
    """
    size = fanout ** levels
    body = leaves.select("t", F.expr(f"pos div {size}").alias("block"), "pos", "n", "hash", *columns)
    head = uppers.withColumn("pos", F.lit(-1).cast("long"))
    rows = body.unionByName(head, allowMissingColumns=True).repartition("t", "block").sortWithinPartitions("t", "block", "pos")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            upper, own = table.slice(0, 1).to_pylist()[0], table.slice(1)
            if own.num_rows:
                above = [(s["before"], s["after"]) for s in upper["path"]]
                paths = (inner + above for inner in steps_in_block(own["hash"].to_pylist(), own["n"][0].as_py(), fanout, levels))
                return answer(upper, own, paths)
            return None

        for batch in batches:
            heads = [i for i, p in enumerate(batch.column(batch.schema.get_field_index("pos")).to_pylist()) if p == -1]
            start = 0
            for i in [*heads, batch.num_rows]:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if i < batch.num_rows and held:
                    out = flush()
                    held = []
                    if out is not None:
                        yield out
                start = i
        if held:
            out = flush()
            if out is not None:
                yield out

    return rows.mapInArrow(run, schema)


def tops(sources: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Sources ``s, subroot`` with the ``top`` part of their proofs and the ``root`` of the dataset."""
    ordered = with_places(sorted_once(settle(sources, "subroots"), "source-order", F.col("s").asc()).withColumn("t", F.lit("")), "t")
    leaves = ordered.withColumnRenamed("subroot", "hash")
    uppers = butterfly(block_roots(leaves, fanout, levels), fanout).select("t", "block", "path", F.col("node").alias("root"))

    def answer(upper, own, paths):
        found = [[{"before": a, "after": b} for a, b in p] for p in paths]
        step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(own["s"].to_pylist(), pa.string()), pa.array(own["hash"].to_pylist(), pa.string()), pa.array(found, step), pa.array([upper["root"]] * len(found), pa.string())],
            ["s", "subroot", "top", "root"],
        )

    return proved(leaves, uppers, answer, f"s string, subroot string, top {STEPS}, root string", fanout, levels, ["s"])


def manifest(docs: DataFrame, tampered: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root``.

    ``folded_root`` is recomputed along the proof from the leaf of the row's present content; where
    ``tampered`` holds, that is the row with its text in lower case.
    """
    source, values = F.col("source"), [F.col(c) for c in FIELDS]
    changed = [tampered_text(v) if c == "text" else v for c, v in zip(FIELDS, values)]
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("t"),
        leaf(*values).alias("hash"), F.when(tampered, leaf(*changed)).alias("present"),
    )
    order = F.col("t").asc(), F.col("doc_id").asc_nulls_first(), F.col("hash").asc()
    leaves = with_places(sorted_once(settle(leaves, "leaves"), "leaf-order", *order), "t")
    blocks = butterfly(block_roots(leaves, fanout, levels), fanout)
    roots = settle(tops(blocks.filter("block = 0").select(F.col("t").alias("s"), F.col("node").alias("subroot")), fanout, levels), "tops")
    uppers = blocks.join(roots, blocks["t"] == roots["s"]).select(
        "t", "block", F.concat("path", "top").alias("path"), "subroot", "root",
    )

    def answer(upper, own, paths):
        from hashlib import sha256

        proofs, folded = [], []
        for first, present, path in zip(own["hash"].to_pylist(), own["present"].to_pylist(), paths):
            proofs.append(sha256("".join([x for step in path for x in step]).encode()).hexdigest())
            node = first if present is None else present
            for before, after in path:
                node = sha256(f"{before}{node}{after}".encode()).hexdigest()
            folded.append(node)
        many = len(proofs)
        text = lambda x: pa.array(x, pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(own["doc_id"].to_pylist(), pa.int64()), text(own["hash"].to_pylist()), text([upper["subroot"]] * many), text([upper["root"]] * many), text(proofs), text(folded)],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
        )

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return proved(leaves, uppers, answer, schema, fanout, levels, ["doc_id", "present"])
