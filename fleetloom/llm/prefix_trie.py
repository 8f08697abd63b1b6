"""Prefix trie of conversations by fixed-length block hashing.

Conversations are grouped by the digests of successive blocks of several turns. Where all members of a block's start go
through the same block, its turns need no grouping: they have the members of the block. Turn boundaries are refined only
inside blocks where siblings diverge, and there over the distinct blocks with their counts, not over the members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.ordered import joined_sha256, with_position
from fleetloom.session import cut_lineage

#: Turns of a block, and blocks whose running digests one window forms.
BLOCK = 4
CHUNK = 1024
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_WORD = r"[^\x20\x09-\x0D]+"


def conversation_ids(conversations: DataFrame) -> DataFrame:
    """The distinct ids."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of every conversation in order, without their texts.

    Order is by turn, null first; turns of equal number by a digest of role and text. A null role or text is empty.
    Repeated rows are turns of their own. Rows without a conversation's id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    return with_position(rows.where("conv_id is not null"), "conv_id", ["turn", "digest"]).select("conv_id", "pos", "digest", "words")


def shared_heads(turns: DataFrame, ids: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Turns of rebuilt conversations: the first h turns of the group's leader, then the own turns after the first h.

    The leader of c is c - c % ``group``; h is the unsigned CRC-32 of c in decimal, modulo ``heads``. An absent leader
    gives no turns, a short one all that it has.
    """
    length = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    leader = lambda c: F.col(c) - F.col(c) % group
    leads = turns.where((F.col("conv_id") == leader("conv_id")) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "leader")
    leads = cut_lineage(leads)
    asked = ids.select("conv_id", leader("conv_id").alias("leader"), length("conv_id").alias("h"))
    first = asked.join(leads, "leader").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "digest", "words")
    held = leads.groupBy("leader").agg(F.count(F.lit(1)).alias("held"))
    own = turns.select("*", leader("conv_id").alias("leader"), length("conv_id").alias("h")).where(F.col("pos") >= F.col("h"))
    own = own.join(held, "leader", "left")
    moved = F.col("pos") - F.col("h") + F.least(F.col("h"), F.coalesce("held", F.lit(0)))
    return first.unionByName(own.select("conv_id", moved.cast("long").alias("pos"), "digest", "words"))


def _running(blocks: DataFrame) -> DataFrame:
    """Blocks with the digest (pa, pb) and words (pw) of all turns before them; a long conversation is done in chunks."""
    rows = blocks.withColumn("chunk", F.floor(F.col("k") / CHUNK))

    def before(over: Window, a: str, b: str, w: str) -> list[Column]:
        zero = F.lit(0).cast("long")
        return [F.coalesce(f(c).over(over), zero) for f, c in ((F.bit_xor, a), (F.bit_xor, b), (F.sum, w))]

    inside = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    pa, pb, pw = before(inside, "da", "db", "w")
    rows = rows.select("*", pa.alias("pa"), pb.alias("pb"), pw.alias("pw"))
    sums = rows.where((F.col("chunk") > 0) | (F.col("k") == CHUNK - 1)).select("conv_id").distinct()
    sums = blocks.withColumn("chunk", F.floor(F.col("k") / CHUNK)).join(sums, "conv_id", "left_semi").groupBy("conv_id", "chunk")
    sums = sums.agg(F.bit_xor("da").alias("ca"), F.bit_xor("db").alias("cb"), F.sum("w").alias("cw"))
    ca, cb, cw = before(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1), "ca", "cb", "cw")
    sums = sums.select("conv_id", "chunk", ca.alias("ca"), cb.alias("cb"), cw.alias("cw"))
    rows = rows.join(sums, ["conv_id", "chunk"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id", "k", "da", "db", "m", "w",
        F.col("pa").bitwiseXOR(F.coalesce("ca", zero)).alias("pa"),
        F.col("pb").bitwiseXOR(F.coalesce("cb", zero)).alias("pb"),
        (F.col("pw") + F.coalesce("cw", zero)).alias("pw"),
    )


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns, from the root (depth 0) on.

    ``turns`` are (conv_id, pos from 0 without gaps, digest, words), ``ids`` (conv_id) all conversations, also those
    without turns. Columns, all long but the last: conv_id, the smallest member; depth; parent_conv_id, the parent's
    conv_id (root: null); n_convs, the members; n_children; n_leaves, childless nodes below or here; saved_tokens, the sum
    of (n_convs - 1) * words of the last turn here and below; ends_sha256, the digest of the ids that end here, ascending
    and joined by commas. No conversation at all gives no rows, not even a root.

    A prefix is known by the xor of 128-bit hashes of (digest, place), so a block's start needs no pass over its turns.
    What a subtree sums up comes from its members alone: every node belongs to its smallest member, and what a member
    owns lies below every node that it is a member of, but for nodes it owns above, which are one run of its path. So
    sums over members (all words, owned words, owned leaves) replace any walk over the tree, however deep it is.
    """
    lane = lambda salt: F.xxhash64(F.lit(salt), "digest", "pos")
    t = turns.select("conv_id", "pos", "words", F.floor(F.col("pos") / block).cast("long").alias("k"), lane(1).alias("a"), lane(2).alias("b"))
    t = cut_lineage(t)
    sums = [F.bit_xor("a").alias("da"), F.bit_xor("b").alias("db"), F.count(F.lit(1)).alias("m"), F.sum("words").alias("w")]
    blocks = cut_lineage(_running(t.groupBy("conv_id", "k").agg(*sums)))
    # distinct blocks behind equal starts, with their members' count and smallest id, which stands for them
    variant = ["k", "pa", "pb", "da", "db", "m"]
    variants = blocks.groupBy(*variant).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("conv_id", "pw"), "conv_id").alias("r"))
    variants = cut_lineage(variants.select(*variant, "n", F.col("r.conv_id").alias("conv_id"), F.col("r.pw").alias("pw")))
    alone = variants.groupBy("k", "pa", "pb").agg(F.count(F.lit(1)).alias("ways")).where("ways = 1").withColumn("alone", F.lit(True)).drop("ways")
    told = variants.join(alone, ["k", "pa", "pb"], "left").join(t.select("conv_id", "k", "pos", "words", "a", "b"), ["conv_id", "k"])
    upto = Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run_a, run_b = (F.col(p).bitwiseXOR(F.bit_xor(c).over(upto)) for p, c in (("pa", "a"), ("pb", "b")))
    steps = told.select(
        "k", "conv_id", "n", "words", F.coalesce("alone", F.lit(False)).alias("alone"), (F.col("pos") + 1).alias("depth"),
        run_a.alias("na"), run_b.alias("nb"), run_a.bitwiseXOR(F.col("a")).alias("qa"), run_b.bitwiseXOR(F.col("b")).alias("qb"),
        (F.col("pw") + F.sum("words").over(upto) - F.col("words")).alias("before"),
    )
    steps = cut_lineage(steps)

    node = ["depth", "na", "nb"]
    columns = [*node, "qa", "qb", "words", "before", "conv_id", "n"]
    smallest = [F.min(c).alias(c) for c in ("qa", "qb", "words", "before", "conv_id")]
    refined = steps.where("not alone").groupBy(*node).agg(*smallest, F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(*[none.alias(c) for c in columns[:7]], "conv_id", "n")
    nodes = cut_lineage(steps.where("alone").select(*columns).unionByName(refined.select(*columns)).unionByName(root))
    up = [(F.col("depth") - 1).alias("depth"), F.col("qa").alias("na"), F.col("qb").alias("nb")]
    children = nodes.where("depth > 0").select(*up).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", none)))

    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    all_words = blocks.groupBy("conv_id").agg(F.sum("w").alias("total"))
    member = ids.join(all_words, "conv_id", "left").join(owned, "conv_id", "left")
    member = cut_lineage(member.select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("total", "owned", "leaves")]))
    add = [F.sum(c).alias(f"all_{c}") for c in ("total", "owned", "leaves")]
    through = blocks.join(member, "conv_id").groupBy(*variant).agg(*add, F.min("conv_id").alias("conv_id")).drop("pa", "pb", "da", "db", "m")
    below = steps.select("conv_id", "k", *node).join(through, ["conv_id", "k"]).groupBy(*node)
    below = below.agg(*[F.sum(f"all_{c}").alias(f"all_{c}") for c in ("total", "owned", "leaves")])
    below = below.unionByName(member.agg(*add).select(*[none.alias(c) for c in node], *[f"all_{c}" for c in ("total", "owned", "leaves")]))

    last = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("a").alias("na"), F.bit_xor("b").alias("nb"))
    last = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in node])
    ends = joined_sha256(last, node, "conv_id").withColumnRenamed("sha256", "ends_sha256")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("na").alias("qa"), F.col("nb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, node).join(ends, node, "left").join(member.select("conv_id", "total", "owned"), "conv_id")
    out = out.join(parents, ["depth", "qa", "qb"], "left")
    # words of all members' nodes from here on, less those of the distinct nodes
    distinct = F.col("all_owned") - F.col("owned") + F.col("total") - F.col("before")
    saved = F.col("all_total") - F.col("n") * F.col("before") - distinct
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("all_leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`trie` of the conversations as they are. Other columns than conv_id, turn, role and text are not read."""
    return trie(turn_table(conversations), conversation_ids(conversations), block)


def shared_prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, block: int = BLOCK) -> DataFrame:
    """:func:`trie` of the conversations rebuilt by :func:`shared_heads`."""
    turns, ids = cut_lineage(turn_table(conversations)), cut_lineage(conversation_ids(conversations))
    return trie(shared_heads(turns, ids, group, heads), ids, block)
