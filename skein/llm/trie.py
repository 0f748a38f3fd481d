"""The prefix trie of conversations, built level by level.

Each conversation is rebuilt first: it opens with a few turns of its group's first conversation and goes on
with its own. Turns become digests of role and text at once, so texts never move. Rebuilt conversations that
are equal form one class, found by digests of digests; a class goes through the trie once, by its smallest
conv_id, whatever its number of members.

Then, per depth, the live classes are grouped by (parent node, next turn), and each group is a node, named by
its smallest conv_id, which is unique at its depth. Classes that are alone in their node leave: what follows
is a chain, written down without further levels. So there are as many levels as the longest prefix that two
different conversations share. Going back from the deepest level, a join with the sums of each node's children
rolls up leaves and savings.

Nothing grows with a group in one task: groups are summed before their shuffle; joins back to a node with very
many classes can be split; positions in a conversation, and sums over it, are counted within stretches first;
ids of a class are joined in blocks, which one stream hashes (SHA-256 has no parallel form).

Results: turns go by number, nulls first, equal ones by the digest of role and text; null roles and texts are
empty; rows with a null conv_id are no conversation. Repeated rows are further turns. A conversation without
turns ends at the root. No rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import column, dropped, written

#: Conversations of a group, and turns that one can take over from the group's first, at most.
GROUP, MOST_SHARED = 20, 3
#: Powers of two: turns of a stretch, and ids of a block.
STRETCH, BLOCK = 12, 16
#: Digests that are digested at once.
FANOUT = 1024
WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(x: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.left(F.sha2(x.cast("binary"), 256), F.lit(32)))


def before_stretch(rows: DataFrame, by: str, stretch: str, value: Column, name: str) -> DataFrame:
    """(by, stretch, ``name``_before, ``name``_all): sums of ``value`` over the earlier stretches, and over all."""
    sums = rows.groupBy(by, stretch).agg(value.alias(name))
    w = Window.partitionBy(by)
    earlier = F.sum(name).over(w.orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(by, stretch, F.coalesce(earlier, F.lit(0)).alias(f"{name}_before"), F.sum(name).over(w).alias(f"{name}_all"))


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, conversations) of ``turns`` (conv, turn, role, text). placed: conv, pos (from 1), turn's digest
    and words, of all (the conversation's number of turns). conversations: conv, own."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.filter("conv is not null").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.select("conv", "turn", digest(said).alias("said"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    rows = written(rows.withColumn("stretch", F.coalesce(F.shiftright(F.col("turn").cast("long"), STRETCH), F.lit(-(1 << 60)))), "turns")
    stretches = before_stretch(rows, "conv", "stretch", F.count("*"), "n")
    own = stretches.groupBy("conv").agg(F.max("n_all").alias("own"))
    place = F.row_number().over(Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "said"))
    placed = rows.withColumn("place", place).join(stretches, ["conv", "stretch"])
    return placed.select("conv", (F.col("n_before") + F.col("place")).alias("pos"), "said", "words"), own


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the rebuilt conversations: conv, pos, said, words; conv, length."""
    placed, own = placed_turns(turns)
    placed, own = written(placed, "placed"), written(own, "own")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)
    first = own.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.least("own", F.lit(MOST_SHARED)).alias("has"))
    convs = own.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base")).join(first, "base", "left")
    convs = convs.withColumn("got", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "got", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    theirs = placed.filter((F.col("conv") % GROUP == 0) & (F.col("pos") <= MOST_SHARED)).withColumnRenamed("conv", "base")
    taken = theirs.join(convs.filter("got > 0").select("base", "conv", "h"), "base").filter("pos <= h").select("conv", "pos", "said", "words")
    kept = placed.join(convs.select("conv", "h", "got"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "said", "words")
    return written(kept.unionByName(taken), "rebuilt"), convs.select("conv", "length")


def sequences(rows: DataFrame, longest: int) -> DataFrame:
    """(conv, whole): a digest of each conversation's turns in order, by levels of FANOUT digests."""
    level = rows.select("conv", F.col("pos") - 1, F.col("said")).toDF("conv", "pos", "whole")
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "whole")))
        level = level.groupBy("conv", F.floor(F.col("pos") / FANOUT).alias("block")).agg(digest(F.concat(F.lit("|"), F.array_join(F.transform(ordered, lambda x: F.hex(x["whole"])), ""))).alias("whole"))
        longest = -(-longest // FANOUT)
        if longest <= 1:
            return level.select("conv", "whole")
        level = level.withColumnRenamed("block", "pos")


def _class_rows(kind: pa.DataType):
    """Over blocks sorted by (length, whole, block): a row per class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, out = None, None, []

        def rows() -> pa.RecordBatch:
            made = {"class": pa.array([r[0] for r in out], kind), "length": pa.array([r[1] for r in out], pa.int64()), "n": pa.array([r[2] for r in out], pa.int64()), "ends": pa.array([r[3].hexdigest() for r in out], pa.string())}
            return pa.RecordBatch.from_pydict(made)

        for b in batches:
            for length, whole, least, n, ids in zip(*(b.column(k).to_pylist() for k in ("length", "whole", "least", "n", "ids")), strict=True):
                if (length, whole) == key:
                    head[2] += n
                    head[3].update(b"," + ids.encode())
                else:
                    key, head = (length, whole), [least, length, n, hashlib.sha256(ids.encode())]
                    if len(out) >= 1000:
                        yield rows()
                        out = []
                    out.append(head)
        yield rows()

    return run


def classes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(class, length, n, ends): equal conversations, by the smallest conv_id; ends: the hash of their ids."""
    longest = convs.agg(F.max("length")).first()[0] or 0
    known = convs.join(sequences(rows, longest), "conv", "left")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = known.groupBy("length", "whole", F.shiftright(F.col("conv").cast("long"), BLOCK).alias("block")).agg(F.min("conv").alias("least"), F.count("*").alias("n"), ids.alias("ids"))
    kind = convs.schema["conv"].dataType
    made = blocks.repartition("length", "whole").sortWithinPartitions("length", "whole", "block")
    return written(made.mapInArrow(_class_rows(pa.int32() if kind.typeName() == "integer" else pa.int64()), f"class {kind.simpleString()}, length long, n long, ends string"), "classes")


def levels(turns: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """The nodes of each depth, from the root, until none is shared by classes: node, parent, n, classes, words,
    length (of a single class), ends (of the class that ends here), last (of a single class)."""
    depth, made = 0, []
    step = classes.select("class", "length", "n", "ends", F.lit(None).cast(classes.schema["class"].dataType).alias("parent"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("words"))
    while True:
        here = F.when(F.col("length") == depth, F.col("ends"))
        nodes = step.groupBy("parent", "said").agg(
            F.min("class").alias("node"), F.sum("n").alias("n"), F.count("*").alias("classes"), F.max("words").alias("words"), F.max("length").alias("length"), F.max(here).alias("ends"), F.max("ends").alias("last")
        )
        made.append(written(nodes, "nodes"))
        shared = made[-1].filter("classes > 1")
        if not shared.head(1):
            return made
        depth += 1
        live = step.filter(F.col("length") >= depth)  # classes that end in a node have no next turn
        below = shared.select(F.col("parent").alias("p"), F.col("said").alias("s"), "node")
        live = live.join(below, F.col("parent").eqNullSafe(F.col("p")) & (F.col("said") == F.col("s"))).select("class", "length", "n", "ends", F.col("node").alias("parent"))
        before, step = step, written(live.join(turns.filter(F.col("pos") == depth).select("class", "said", "words"), "class"), "level")
        if depth > 1:
            dropped(before)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Only the four named columns are read."""
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows, convs = rebuilt(turns.select(*(column(c).alias(k) for k, c in named.items())))
    classes = classes_of(rows, convs)
    own = rows.withColumnRenamed("conv", "class").join(classes.select("class", "length", "n"), "class")
    own = written(own.repartitionByRange("pos", "class").sortWithinPartitions("pos", "class"), "class-turns")  # a level reads its own row groups
    nodes = levels(own.select("class", "pos", "said", "words"), classes)

    # chains: a class alone in its node goes on by itself
    alone = [x.filter("classes = 1").select(F.col("node").alias("class"), F.lit(d).cast("long").alias("depth"), "last") for d, x in enumerate(nodes)]
    single = alone[0]
    for x in alone[1:]:
        single = single.unionByName(x)
    chain = own.join(single, "class").filter("pos > depth").withColumn("stretch", F.shiftright("pos", STRETCH))
    chain = written(chain.select("class", "pos", "words", "length", "n", "last", "depth", "stretch"), "chains")
    stretches = before_stretch(chain, "class", "stretch", F.sum("words"), "w")
    inside = F.sum("words").over(Window.partitionBy("class", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = chain.withColumn("so_far", inside).join(stretches, ["class", "stretch"])
    rest = F.col("w_all") - F.col("w_before") - F.col("so_far") + F.col("words")  # of this turn and all after it
    more = F.col("pos") < F.col("length")
    links = summed.select(
        F.col("class").alias("conv_id"), F.col("pos").alias("depth"), F.col("class").alias("parent_conv_id"), F.col("n").alias("n_convs"), more.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * rest).alias("saved_tokens"), F.when(~more, F.col("last")).otherwise(NOTHING).alias("ends_sha256"),
    )
    # what hangs below a node that one class has alone
    tails = written(chain.groupBy(F.col("class").alias("node"), "depth").agg(F.sum((F.col("n") - 1) * F.col("words")).alias("tail")), "tails")

    out, below = links, None
    for d in range(len(nodes) - 1, -1, -1):
        at = nodes[d].join(tails.filter(F.col("depth") == d).select("node", "tail"), "node", "left")
        children, leaves, saved = (F.col("tail").isNotNull().cast("long"), F.lit(1).cast("long"), F.coalesce("tail", F.lit(0)))
        if below is not None:
            sums = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            at = at.join(sums, "node", "left")
            children, leaves, saved = F.coalesce("children", children), F.coalesce("leaves", leaves), F.coalesce("saved", saved)
        shown = at.select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), leaves.alias("n_leaves"),
            ((F.col("n") - 1) * F.col("words") + saved).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
        )
        below = written(shown, "rolled-up")
        out = out.unionByName(below)
    return out
