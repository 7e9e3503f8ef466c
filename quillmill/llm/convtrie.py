"""Prefix trie of rebuilt conversations, by partition refinement.

Turns are put in order by one range sort, so a conversation of any length may lie in several
tasks; their positions are shifted by the counts of the ranges before. A turn is known by 128 bits of SHA-256 over
its role and text, a whole conversation by 128 bits over its turns' places and digests; equal
conversations are one sequence with a count, and all that follows works on different sequences.

Refinement starts with one class. In each round the active classes are split by the next turn; each
class is a node. A class of one sequence is retired: the rest of it is a unary chain. A class that holds no
more than ``MOST`` turns is refined to its end, by the same rounds, in one task that takes many
such classes; the others go on to the next turn. Then nodes fold back: leaves and savings of
children are summed into their parents, deepest first.

Classes with more than a thousandth of all sequences are joined by broadcast (see ``heavy``), so a first
turn that a third of all conversations share fills no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heavy import join_unique
from .scratch import cut

#: First turns that a conversation may take from the one it follows: fewer than this number.
HEADS = 9
#: Turns of a class that one task may refine, and of the classes that it refines together.
MOST = 4096
BATCH = 16384

_NODES = "top binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long"
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _short(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _placed(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns, runs): turns with their place and bytes so far, and what each range holds of each conversation."""
    words = {name: F.coalesce(F.col(c).cast("string"), F.lit("")) for name, c in (("role", role), ("text", text))}
    made = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *(x.alias(n) for n, x in words.items())).where("conv_id is not null")
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = made.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", _short(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"),
    )
    ordered = cut(ordered.withColumn("part", F.shiftright("at", 33)), "ordered")
    runs = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    runs = cut(runs.select(
        "conv_id", "part", "begin", F.coalesce(F.sum("n").over(before), none).alias("n_before"), F.coalesce(F.sum("b").over(before), none).alias("b_before"),
        F.sum("n").over(whole).alias("n"), F.sum("b").over(whole).alias("b"),
    ), "runs")
    so_far = F.sum("bytes").over(Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    turns = ordered.withColumn("so_far", so_far).join(runs.select("conv_id", "part", "begin", "n_before", "b_before"), ["conv_id", "part"])
    return cut(turns.select("conv_id", "part", (F.col("at") - F.col("begin") + F.col("n_before")).alias("pos"), "digest", "bytes", (F.col("so_far") + F.col("b_before")).alias("upto")), "placed"), runs


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x["bytes"])


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): ``turns`` are (conv_id, part, pos, digest, bytes, upto) of each rebuilt conversation,
    ``lengths`` (conv_id, part, n, total) of each of its parts; part -1 is what it takes from another."""
    turns, runs = _placed(conversations, conv_id, turn, role, text)
    heads = turns.where(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    heads = cut(heads, "heads")
    sizes = runs.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("b").alias("b"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    convs = heads.join(sizes, "conv_id").withColumn("h", h).withColumn("from", F.col("conv_id") - F.col("conv_id") % 5)
    convs = convs.join(heads.select(F.col("conv_id").alias("from"), F.col("head").alias("other")), "from", "left")
    empty = F.expr("filter(head, x -> false)")
    convs = convs.withColumn("taken", F.when(F.col("h") > 0, F.slice(F.coalesce("other", empty), 1, F.greatest("h", F.lit(1)))).otherwise(empty))
    convs = convs.withColumn("left", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))).otherwise(empty))
    shift, bytes_shift = F.size("taken") - F.col("h"), _total(F.col("taken")) - _total(F.col("left"))
    convs = cut(convs.select(
        "conv_id", "h", "taken", shift.cast("long").alias("shift"), bytes_shift.alias("bytes_shift"),
        (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"), (F.col("b") + bytes_shift).alias("total"),
    ), "convs")
    prefix = F.transform("taken", lambda x, i: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"), _total(F.slice("taken", 1, i + 1)).alias("upto")))
    begun = convs.select("conv_id", F.lit(-1).cast("long").alias("part"), F.posexplode(prefix).alias("pos", "x")).select("conv_id", "part", F.col("pos").cast("long").alias("pos"), "x.*")
    by_part = runs.select("conv_id", "part").join(convs, "conv_id")
    own = turns.join(by_part.select("conv_id", "part", "h", "shift", "bytes_shift"), ["conv_id", "part"]).where("pos >= h")
    own = own.select("conv_id", "part", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "bytes", (F.col("upto") + F.col("bytes_shift")).alias("upto"))
    lengths = by_part.select("conv_id", "part", "n", "total").union(convs.select("conv_id", F.lit(-1).cast("long"), "n", "total"))
    return cut(begun.unionByName(own), "rebuilt"), cut(lengths, "lengths")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each sequence's copies, from rows sorted by (rep, conv_id): a state, not a list."""
    rep, state = None, None
    for batch in batches:
        reps, shas = [], []
        for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if r != rep:
                if state is not None:
                    reps.append(rep), shas.append(state.hexdigest())
                rep, state = r, hashlib.sha256(str(c).encode())
            else:
                state.update(f",{c}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])


def refine(top: np.ndarray, depth: np.ndarray, conv: np.ndarray, rep: np.ndarray, times: np.ndarray, digest: np.ndarray, size: np.ndarray) -> tuple[dict, dict]:
    """Nodes below some classes, by partition refinement.

    One entry a turn, sorted by (class, sequence, place): the class' number, depth and smallest
    member, the sequence's id and number of copies, the turn's number and bytes. Returns the columns of
    all nodes below the classes, and of the classes' own sums.
    """
    begin = np.flatnonzero(np.concatenate([[True], (rep[1:] != rep[:-1]) | (top[1:] != top[:-1])]))
    length = np.diff(np.append(begin, len(rep)))
    classes = int(top[-1]) + 1
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    name, many = rep[begin], times[begin]
    rest = np.concatenate([np.cumsum(size[::-1])[::-1], [0]])  # bytes from a turn to the end of all
    node_of = top[begin].copy()  # node of each member; the classes come first
    kind = int(digest.max()) + 1
    columns = {"parent": [np.full(classes, -1)], "conv_id": [conv[first]], "depth": [depth[first]], "n_convs": [np.zeros(classes, np.int64)], "bytes": [np.zeros(classes, np.int64)], "ended": [np.full(classes, -1)], "own": [np.zeros(classes, np.int64)]}
    chains = []
    active, made, step = np.arange(len(begin)), classes, 0
    while len(active):
        active = active[length[active] > step]
        if not len(active):
            break
        turn = begin[active] + step
        _, one, which, count = np.unique(node_of[active] * kind + digest[turn], return_index=True, return_inverse=True, return_counts=True)
        n = len(one)
        members, smallest, ended = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.add.at(members, which, many[active])
        np.minimum.at(smallest, which, name[active])
        stop = length[active] == step + 1
        ended[which[stop]] = active[stop]
        parent = node_of[active[one]]
        alone = count == 1
        last = begin[active[one]] + length[active[one]]
        own = np.where(alone, (members - 1) * (rest[turn[one] + 1] - rest[last]), 0)  # a chain's savings below its top
        for key, values in (("parent", parent), ("conv_id", smallest), ("depth", depth[begin[active[one]]] + step + 1), ("n_convs", members), ("bytes", size[turn[one]]), ("ended", ended), ("own", own)):
            columns[key].append(values)
        node_of[active] = made + which
        chains.append((active[one][alone], np.full(int(alone.sum()), step + 1)))
        active, made, step = active[~alone[which]], made + n, step + 1
    nodes = {key: np.concatenate(values) for key, values in columns.items()}
    who, since = (np.concatenate(x) for x in zip(*chains, strict=True))
    below = length[who] - since
    children, leaves = np.zeros(made, np.int64), np.zeros(made, np.int64)
    children[node_of[who]] = below > 0
    leaves[node_of[who]] = 1
    saved = (nodes["n_convs"] - 1) * nodes["bytes"] + nodes["own"]
    saved[:classes] = 0
    bounds = np.cumsum([0, *(len(x) for x in columns["parent"])])
    for lo, hi in zip(bounds[-2:0:-1].tolist(), bounds[:1:-1].tolist(), strict=True):  # the deepest first
        leaves[lo:hi] = np.maximum(leaves[lo:hi], children[lo:hi] == 0)
        parent = nodes["parent"][lo:hi]
        np.add.at(children, parent, 1)
        np.add.at(leaves, parent, leaves[lo:hi])
        np.add.at(saved, parent, saved[lo:hi])
    # Chains: one node for each turn that is left of a retired sequence.
    of = np.repeat(np.arange(len(who)), below)
    step = np.arange(len(of)) - np.repeat(np.cumsum(below) - below, below)
    member = who[of]
    turn = begin[member] + since[of] + step
    end = step + 1 == below[of]
    own_name = np.append(name, -1)
    out = {
        "conv_id": [nodes["conv_id"][classes:], name[member]],
        "depth": [nodes["depth"][classes:], nodes["depth"][node_of[member]] + 1 + step],
        "parent_conv_id": [nodes["conv_id"][nodes["parent"][classes:]], name[member]],
        "n_convs": [nodes["n_convs"][classes:], many[member]],
        "n_children": [children[classes:], (~end).astype(np.int64)],
        "n_leaves": [leaves[classes:], np.ones(len(of), np.int64)],
        "saved_tokens": [saved[classes:], (many[member] - 1) * (rest[turn] - rest[begin[member] + length[member]])],
    }
    found = {key: np.concatenate(values).astype(np.int64) for key, values in out.items()}
    holder = np.concatenate([nodes["ended"][classes:], np.where(end, member, -1)])
    found["ended"] = np.ma.array(own_name[holder], mask=holder < 0)
    return found, {"n_children": children[:classes], "n_leaves": leaves[:classes], "saved_tokens": saved[:classes]}


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes below the classes of a task, and a row with ``top`` for each class itself; rows come sorted by class."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        kinds = column["cls"].dictionary_encode()
        top = kinds.indices.to_numpy().astype(np.int64)
        digest = column["digest"].dictionary_encode().indices.to_numpy().astype(np.int64)
        found, sums = refine(top, *(column[c].to_numpy() for c in ("depth", "conv", "rep", "m")), digest, column["bytes"].to_numpy())
        n, m = len(found["conv_id"]), len(kinds.dictionary)
        cols = [pa.concat_arrays([pa.nulls(n, pa.binary()), kinds.dictionary.cast(pa.binary())])]
        for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"):
            cols.append(pa.concat_arrays([pa.array(found[c]), pa.array(sums[c]) if c in sums else pa.nulls(m, pa.int64())]))
        ended = pa.array(found["ended"].data, mask=np.ma.getmaskarray(found["ended"]))
        return pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([ended, pa.nulls(m, pa.int64())])], names=[x.split()[0] for x in _NODES.split(", ")])

    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows > BATCH:
            cls = held.column("cls").combine_chunks()
            new = np.flatnonzero(pc.not_equal(cls[1:], cls[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(new):
                yield built(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1]))
    if held is not None and held.num_rows:
        yield built(held)


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = MOST
) -> DataFrame:
    """One row a node of the trie of rebuilt conversations; see ``rebuilt`` and ``_RESULT``.

    A conversation's turns are ordered by (turn, role, text), null turns first, null roles and texts empty;
    repeated rows are turns like others. Rows with a null id belong to no conversation and take no part. A
    conversation takes the first ``crc32(id) % 9`` turns of conversation ``id - id % 5`` (the remainder has the sign of
    ``id``), then its own after as many. Other columns are not read, whatever their names. Very long conversations
    and texts are split over tasks by turns. An empty table has no node, not even a root.
    """
    turns, lengths = rebuilt(conversations, conv_id, turn, role, text)
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "pos", "digest")).alias(f"f{i}") for i in range(2)]
    none = F.lit(0).cast("long")
    prints = lengths.where("part = -1").join(turns.groupBy("conv_id").agg(*marks), "conv_id", "left")
    prints = cut(prints.select("conv_id", "n", "total", *(F.coalesce(f"f{i}", none).alias(f"f{i}") for i in range(2))), "prints")
    same = ["n", "total", "f0", "f1"]
    copies = cut(prints.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("m")), "copies")
    often = join_unique(prints, copies.where("m > 1"), same, "m").select("rep", "conv_id")
    ends = often.repartition("rep").sortWithinPartitions("rep", "conv_id").mapInArrow(_ends, "rep long, ends_sha256 string")
    ends = cut(ends.unionByName(copies.where("m = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))), "ends")
    reps = copies.select("rep", "m", "n", "total")
    parts = lengths.select(F.col("conv_id").alias("rep"), "part").join(reps, "rep")
    rows = turns.withColumnRenamed("conv_id", "rep").join(parts, ["rep", "part"])
    rows = cut(rows.select("rep", "part", "pos", "digest", "bytes", (F.col("total") - F.col("upto")).alias("rest"), "m", "n"), "sequences")

    nodes = reps.agg(
        F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("n_reps"), F.sum("n").alias("turns"),
        F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("ended"), F.max("total").alias("rest"), F.max("n").alias("n"),
    ).where("n_reps > 0").select(F.lit(b"").alias("cls"), "*", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id"), none.alias("bytes"))
    step = cut(reps.select("rep", "m", "n", F.lit(b"").alias("cls")), "split")  # written, so that the root is joined by its key
    levels, small = [], []
    while True:
        depth = len(levels)
        nodes = cut(nodes.withColumn("large", (F.col("n_reps") > 1) & (F.col("turns") > most)), "nodes")
        levels.append(nodes)
        shared = nodes.where("n_reps > 1").select("cls", F.col("conv_id").alias("conv"), "large", "n_reps")
        found = nodes.agg(F.max(F.col("large").cast("int")), F.max((~F.col("large") & (F.col("n_reps") > 1)).cast("int"))).first()
        if not (found[0] or found[1]):
            break
        members = join_unique(step.select("rep", "m", "n", "cls"), shared, ["cls"], "n_reps")
        if found[1]:
            small.append(members.where("not large").select("rep", "cls", "conv", F.lit(depth).cast("long").alias("depth")))
        if not found[0]:
            break
        following = rows.where(F.col("pos") == depth).select("rep", "digest", "bytes", "rest")
        step = members.where("large").join(following, "rep").select(
            "rep", "m", "n", _short(F.concat("cls", "digest")).alias("cls"), F.col("cls").alias("parent"), F.col("conv").alias("parent_conv_id"), "bytes", "rest"
        )
        step = cut(step, "split")
        nodes = step.groupBy("cls").agg(
            F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("n_reps"), F.sum(F.col("n") - depth - 1).alias("turns"),
            F.max(F.when(F.col("n") == depth + 1, F.col("rep"))).alias("ended"), F.max("rest").alias("rest"), F.max("n").alias("n"),
            F.first("parent").alias("parent"), F.first("parent_conv_id").alias("parent_conv_id"), F.first("bytes").alias("bytes"),
        )
    made = None
    if small:
        held = small[0]
        for more in small[1:]:
            held = held.unionByName(more)
        asked = rows.join(held, "rep").where("pos >= depth")
        asked = asked.select("cls", "depth", "conv", "rep", "pos", "m", "digest", "bytes").repartition("cls").sortWithinPartitions("cls", "rep", "pos")
        made = cut(asked.mapInArrow(_refined, _NODES), "refined")
    # Fold back: what children sum to, deepest first.
    total = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")]
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        known = levels[depth].where("not large")
        chain = [(F.col("n") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("below")]
        all_ = known.where("n_reps = 1").select("*", *chain)
        if made is not None:
            sums = made.where("top is not null").select(F.col("top").alias("cls"), "n_children", "n_leaves", F.col("saved_tokens").alias("below"))
            all_ = all_.unionByName(known.where("n_reps > 1").join(sums, "cls"))
        if below is not None:
            all_ = all_.unionByName(levels[depth].where("large").join(below.withColumnRenamed("parent", "cls"), "cls"))
        level = cut(all_.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes") + F.col("below")).withColumn("depth", F.lit(depth).cast("long")), "folded")
        below = level.groupBy("parent").agg(*total)
        out.append(level.select(*_RESULT[:-1], "ended"))
        single = level.where("n_reps = 1").select(F.col("conv_id").alias("rep"))
        tails = lengths.select(F.col("conv_id").alias("rep"), "part").join(single, "rep")
        tail = rows.where(F.col("pos") >= depth).join(tails, ["rep", "part"])
        last = F.col("pos") + 1 == F.col("n")
        out.append(tail.select(
            F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"), (~last).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * (F.col("bytes") + F.col("rest"))).alias("saved_tokens"), F.when(last, F.col("rep")).alias("ended"),
        ))
    if made is not None:
        out.append(made.where("top is null").select(*_RESULT[:-1], "ended"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    ended = every.where("ended is not null").join(ends.withColumnRenamed("rep", "ended"), "ended").select(_RESULT)
    return ended.unionByName(every.where("ended is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).select(_RESULT))
