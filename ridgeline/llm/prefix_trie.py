"""Conversation prefix trie: the shared starts of rebuilt conversations.

A turn travels as a 128-bit hash of its role and text and the length of its
text; texts stay where they are. A conversation is the string of its turns'
hashes, so conversations that start alike are neighbours once sorted.

1. Conversations are dealt by range of (path, conv_id) to runs: a group of
   copies of any size is spread over several runs.
2. In a run, edges between sorted neighbours carry the length of their longest
   common prefix (LCP). Union-find takes them in descending depth: components
   that meet at a depth become one branching node there, and the chain of nodes
   between it and each component's own top is written down at once.
3. A run's forest is contracted to the nodes that the neighbouring runs may
   share, prefixes of its first and last path up to the LCP with the next run.
   Only these meet again: members, children, leaves and savings are sums over
   runs, since each node counts as a child, a leaf and a text in its last run alone.
4. Ends of one node in several runs are hashed as a stream in order.

Defined cases: rows without a conv_id are left out; turns with equal numbers are
ordered by role and text, and copies of a row stay; null turns come first; null
and empty roles and texts are alike; for a negative id, c % 5 is from 0 to 4; a
conversation may be left without turns and then ends at the root; a very long text
is hashed where it is read; a conversation's turns, 16 bytes each, are held by
one task; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sized_broadcast, stored

#: Conversations that share a start are each other's neighbours within a family of so many ids.
FAMILY = 5
HEADS = 9
KEY = 16
#: Open nodes that may be broadcast, and characters of ids that travel as one row.
BROADCAST_ROWS = 200_000
PART = 4096
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256().hexdigest()


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation with the first h turns of its family's
    first one in place of its own; path holds 16 bytes a turn, sizes its bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.octet_length(text).cast("long").alias("size")
    )
    twice = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).where("low <> high").select("conv_id", F.col("turn").alias("tied"))
    twice = sized_broadcast(stored(twice), BROADCAST_ROWS).withColumnRenamed("conv_id", "of")
    tied = rows.join(twice, (F.col("conv_id") == F.col("of")) & F.col("turn").eqNullSafe(F.col("tied")), "left")
    also = F.when(F.col("of").isNotNull(), F.struct("role", "text"))  # only what decides an order travels
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    turns = tied.select(family.alias("family"), "conv_id", F.struct("turn", also.alias("also"), "a", "b", "size").alias("x")).repartition("family")
    own = turns.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("family"))  # a family has at most five rows
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    new = F.concat(F.slice(F.coalesce(first, F.array().cast(own.schema["own"].dataType)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    out = own.select("conv_id", new.alias("new"))
    path = F.unhex(F.concat_ws("", F.transform("new", lambda t: F.concat(_hex(t["a"]), _hex(t["b"])))))
    return out.select("conv_id", path.alias("path"), F.transform("new", lambda t: t["size"]).alias("sizes"))


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that both paths start with; -1 without one of them."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:  # slices are compared as a whole
        mid = (low + high + 1) // 2
        if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_names(path: bytes, most: int) -> list[bytes]:
    """A 16-byte name for each prefix of 0 to ``most`` turns."""
    state, out = hashlib.sha256(), []
    for d in range(most + 1):
        out.append(state.digest()[:KEY])
        state.update(path[d * KEY : (d + 1) * KEY])
    return out


class Forest:
    """The nodes of one run, by union-find over its sorted paths.

    ``before`` and ``after`` are the neighbouring runs' last and first paths. Nodes
    that these start with are open: they get names, and their counts are this run's part."""

    COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "name", "parent_name")

    def __init__(self, paths: list[bytes], ids: list[list[int]], sizes: list[np.ndarray], before: bytes | None, after: bytes | None):
        self.paths, self.ids = paths, ids
        self.sizes = sizes
        self.left, self.right = shared_turns(before, paths[0]), shared_turns(paths[-1], after)
        self.first_names, self.last_names = prefix_names(paths[0], self.left), prefix_names(paths[-1], self.right)
        self.rows: dict[str, list] = {c: [] for c in self.COLUMNS}
        n = len(paths)
        self.up = list(range(n))
        self.low, self.high = list(range(n)), list(range(n))  # of a component: its first and last path
        self.top = [len(p) // KEY for p in paths]
        self.n, self.least = [len(x) for x in ids], [min(x) for x in ids]
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.end: list[int | None] = list(range(n))  # the path that ends at the top node
        self.below: list[list[int]] = [[] for _ in range(n)]  # rows whose parent is the top node
        edges = np.array([shared_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
        for i in np.argsort(-edges, kind="stable").tolist():
            self._unite(self._find(i), self._find(i + 1), int(edges[i]))
        last = self._find(0)
        self._lift(last, 0)
        self._write(last, 0)

    def _find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def _continues(self, c: int, d: int) -> bool:
        """Whether the next run also has this component's node of depth ``d``."""
        return d <= self.right and self.high[c] == len(self.paths) - 1

    def _name(self, c: int, d: int) -> bytes | None:
        if d <= self.left and self.low[c] == 0:
            return self.first_names[d]
        return self.last_names[d] if self._continues(c, d) else None

    def _write(self, c: int, to: int) -> None:
        """Rows of the chain from the top node up to depth ``to``; the top's children learn their parent."""
        top, rows, at = self.top[c], self.rows, len(self.rows["depth"])
        if not self.below[c] and not self._continues(c, top):
            self.leaves[c] = 1
        depths = range(top, to - 1, -1)
        names = [self._name(c, d) for d in depths]
        size, saved, n = self.sizes[self.low[c]], self.saved[c], self.n[c]
        for d in depths:  # a text is kept once, in the last run that has it
            saved += (n - (not self._continues(c, d))) * int(size[d - 1]) if d else 0
            rows["saved_tokens"].append(saved)
        self.saved[c], m = saved, len(names)
        rows["conv_id"] += [self.least[c]] * m
        rows["depth"] += depths
        rows["n_convs"] += [n] * m
        rows["n_children"] += [self.children[c]] + [int(not self._continues(c, d + 1)) for d in depths[1:]]
        rows["n_leaves"] += [self.leaves[c]] * m
        rows["end"] += [self.end[c]] + [None] * (m - 1)
        rows["name"] += names
        rows["parent_conv_id"] += [None if x else self.least[c] for x in names[1:]] + [None]
        rows["parent_name"] += [*names[1:], None]
        for r in self.below[c]:
            rows["parent_conv_id"][r], rows["parent_name"][r] = (None, names[0]) if names[0] else (self.least[c], None)
        self.children[c] = int(not self._continues(c, to))  # of the node above
        self.below[c] = [at + m - 1]

    def _lift(self, c: int, d: int) -> None:
        """Make the node of depth ``d`` the top of a component that lies deeper."""
        if self.top[c] > d:
            self._write(c, d + 1)
            self.top[c], self.end[c] = d, None

    def _unite(self, a: int, b: int, d: int) -> None:
        self._lift(a, d)
        self._lift(b, d)
        if len(self.below[a]) < len(self.below[b]):
            a, b = b, a
        self.up[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.least[a] = min(self.least[a], self.least[b])
        self.end[a] = self.end[b] if self.end[a] is None else self.end[a]
        for sums in (self.n, self.children, self.leaves, self.saved):
            sums[a] += sums[b]
        self.below[a] += self.below[b]
        self.below[b] = []


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, name binary, parent_name binary, run int, place int, ids string"


def _nodes(key, runs: pa.Table, sides: pa.Table) -> pa.Table:
    """Nodes of one run. Ends of open nodes follow as rows of their own, with their ids in parts."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())] + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("name", pa.binary()), ("parent_name", pa.binary()), ("run", pa.int32()), ("place", pa.int32()), ("ids", pa.string())])
    if not runs.num_rows:
        return schema.empty_table()
    raw, convs = runs.column("path").to_pylist(), runs.column("conv_id").to_pylist()
    sizes = runs.column("sizes").combine_chunks()
    starts, flat = np.append(0, np.cumsum(sizes.value_lengths().to_numpy())), sizes.flatten().to_numpy()
    paths, ids, own = [], [], []
    for i in sorted(range(len(raw)), key=lambda i: (raw[i], convs[i])):
        if not paths or paths[-1] != raw[i]:
            paths.append(raw[i])
            ids.append([])
            own.append(flat[starts[i] : starts[i + 1]])
        ids[-1].append(convs[i])
    side = sides.to_pylist()[0] if sides.num_rows else {}
    rows = Forest(paths, ids, own, side.get("before"), side.get("after")).rows
    text = [None if e is None else ",".join(map(str, ids[e])) for e in rows.pop("end")]
    rows["ends_sha256"] = [None if n and t else hashlib.sha256(t.encode()).hexdigest() if t else NOTHING for t, n in zip(text, rows["name"])]
    m, run = len(text), int(runs.column("run")[0].as_py())
    out = {c: rows.get(c, [None] * m) for c in schema.names}
    for t, name in zip(text, out["name"][:m]):
        for place, at in enumerate(range(0, len(t or "") if name else 0, PART)):
            for c in schema.names:
                out[c].append({"name": name, "run": run, "place": place, "ids": ("," if at == 0 else "") + t[at : at + PART]}.get(c))
    return pa.table(out, schema)


def _hashed(batches):
    """SHA-256 of the ids of each name, whose parts come in order."""
    name, state, names, digests = None, None, [], []
    for b in batches:
        for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != name:
                if name is not None:
                    names.append(name)
                    digests.append(state.hexdigest())
                name, state, text = n, hashlib.sha256(), text[1:]  # the first comma
            state.update(text.encode())
    if name is not None:
        names.append(name)
        digests.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "digest"])


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path, sizes)."""
    spark = paths.sparkSession
    own = stored(paths)
    runs = stored(own.repartitionByRange("path", "conv_id").withColumn("run", F.spark_partition_id()))
    ends = stored(runs.groupBy("run").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    order = sorted(r.run for r in ends.select("run").collect())  # a number for each run
    if not order:
        return runs.select(*[F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE_COLUMNS])
    next_to = F.broadcast(spark.createDataFrame(list(zip(order, [None, *order], [*order[1:], None])), "run int, earlier int, later int"))  # as many rows as runs
    sides = next_to.join(ends.select(F.col("run").alias("earlier"), F.col("last").alias("before")), "earlier", "left").join(ends.select(F.col("run").alias("later"), F.col("first").alias("after")), "later", "left").select("run", "before", "after")
    rows = stored(runs.groupBy("run").cogroup(sides.groupBy("run")).applyInArrow(_nodes, _NODE))
    nodes = rows.where("depth IS NOT NULL").drop("run", "place", "ids")
    hashed = rows.where("depth IS NULL").select("name", "ids", "run", "place").repartition("name").sortWithinPartitions("name", "run", "place").select("name", "ids").mapInArrow(_hashed, "name binary, digest string")
    shared = nodes.where("name IS NOT NULL").groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_name").alias("parent_name"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    shared = stored(shared.join(hashed, "name", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NOTHING))).drop("digest"))
    parents = sized_broadcast(shared.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id")), BROADCAST_ROWS)
    inner = nodes.where("name IS NULL AND parent_name IS NULL").select(*NODE_COLUMNS)
    top = shared.where("parent_name IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*NODE_COLUMNS)
    hung = nodes.where("name IS NULL AND parent_name IS NOT NULL").drop("parent_conv_id", "name").unionByName(shared.where("parent_name IS NOT NULL").drop("name"))
    return inner.union(top).union(hung.join(parents, "parent_name").select(*NODE_COLUMNS))


def trie_report(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))


#: ``{conversations}``: the table. CRC-32 is spelled out bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM {conversations} WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS family, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
new AS (
  SELECT c.conv_id, 0 AS own, t.k, role, text FROM convs c JOIN turns t ON t.conv_id = c.family AND t.k <= h
  UNION ALL SELECT c.conv_id, 1, t.k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > h),
paths AS (SELECT conv_id, list((role, text) ORDER BY own, k) AS path FROM new GROUP BY conv_id UNION ALL SELECT conv_id, [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM new)),
prefixes AS (SELECT conv_id, d, path[:d] AS p, len(path) = d AS ends, CASE WHEN d > 0 THEN strlen(path[d][2]) ELSE 0 END AS size FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
family AS (SELECT n.p, count(*) AS n_children FROM (SELECT p[:d - 1] AS p FROM nodes WHERE d > 0) n GROUP BY n.p),
above AS (SELECT n.p, n.d, n.n_convs, n.size, f.n_children IS NULL AS leaf, n.p[:a] AS top FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes) n LEFT JOIN family f ON f.p = n.p),
sums AS (SELECT top AS p, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM above GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (p) LEFT JOIN family USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[:n.d - 1]"""
