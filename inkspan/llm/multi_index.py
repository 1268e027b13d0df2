"""Near copies of embeddings with an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the pairs of codewords form a
grid of cells. A vector lives in its nearest cell and visits the cells nearest to it in
multi-sequence order, as many as find the target share of pairs at the threshold; what it meets
there is verified by cosine in double precision.

Vectors so close to one of their cell that all of them must be linked (within half the threshold
angle of it) become one node with a count and a radius, so a large group of near copies costs no
pairs. Two nodes are linked as wholes, or not at all, where their angle and radii decide it; where
they don't, the members are compared in blocks.

Vectors travel to the cells they visit as 16-bit codes whose error is known; a pair that the error
leaves undecided is compared by its vectors in double precision, like the members of nodes.

The codebooks and the number of visits are fitted to a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.graph import components
from inkspan.llm.sample import thin
from inkspan.llm.totals import attach
from inkspan.llm.words import column
from inkspan.session import cut_lineage

THRESHOLD = 0.9
ANGLE = math.acos(THRESHOLD)
CORE = math.cos(ANGLE / 2) + 1e-9  # cosine to a node's centre from which any two members are linked
SURE = 1e-7  # radians by which an angle must clear the threshold to decide for whole nodes
SAMPLE = 16_384  # vectors that codebooks are fitted to, about
FITTED, STRATA = 4096, 8  # of these, evenly over the ids, the number of visits is fitted to: to the worst of so many strata
PER_CELL = 64  # vectors a cell should hold
MOST_WORDS = 2048  # codewords of a half, at most; fuller cells are then cut in blocks
RECALL = 0.97  # of pairs at exactly the threshold, found from one of their ends
BLOCK = 4096  # rows of one side of a block


def _unit(batches):
    """Rows with their unit vector, null where it is null, empty, zero or not finite."""
    for batch in batches:
        units = []
        for e in column(batch, "embedding"):
            v = e.values.to_numpy(zero_copy_only=False).astype(float) if e.is_valid else np.zeros(0)
            ok = len(v) > 0 and np.isfinite(v).all() and v.any()
            if ok:
                v = v / np.abs(v).max()
            units.append(v / np.linalg.norm(v) if ok else None)
        dims = pa.array([None if u is None else len(u) for u in units], pa.int32())
        yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "vec_id"), dims, pa.array(units, pa.list_(pa.float64()))], ["rid", "vec_id", "d", "u"])


def _matrix(list_array):
    if isinstance(list_array, pa.ChunkedArray):
        list_array = list_array.combine_chunks()
    return list_array.flatten().to_numpy().reshape(len(list_array), -1) if len(list_array) else np.zeros((0, 0))


def _padded(list_array, width):
    """The vectors as a matrix, filled up with zeros, which change no cosine."""
    if isinstance(list_array, pa.ChunkedArray):
        list_array = list_array.combine_chunks()
    lengths = np.diff(list_array.offsets.to_numpy())
    out = np.zeros((len(list_array), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = list_array.flatten().to_numpy()
    return out


def _coded(x):
    """16-bit codes of vectors, their scales, and how far they are off at most."""
    scale = np.maximum(np.abs(x).max(1, initial=0), 1e-300) / 32767
    q = np.rint(x / scale[:, None]).astype(np.int16)
    return [r.tobytes() for r in q], scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-14


def _distances(x, words):
    return (x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None, :]


def _codebook(x, k, rounds=10):
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            words[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), words[:, j])
    return words


class Grid:
    """Two codebooks and the number of cells a vector visits."""

    def __init__(self, sample, n):
        self.cut = sample.shape[1] // 2
        k = int(np.clip(math.ceil(math.sqrt(n / PER_CELL)), 1, min(MOST_WORDS, max(1, len(sample) // 4))))
        self.words = [_codebook(sample[:, : self.cut], k), _codebook(sample[:, self.cut :], k)]
        self.k, self.visits = k, 1
        self.visits = self._needed(sample[np.linspace(0, len(sample) - 1, min(FITTED, len(sample))).astype(int)])

    def parts(self, x):
        return _distances(x[:, : self.cut], self.words[0]), _distances(x[:, self.cut :], self.words[1])

    def home(self, x):
        a, b = self.parts(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def _needed(self, x):
        """Visits that reach the home cell of a random vector at the threshold angle in the target share of cases."""
        if self.k == 1 or x.shape[1] < 2:
            return self.k * self.k
        r = np.random.default_rng(7).standard_normal(x.shape)
        r -= (r * x).sum(1)[:, None] * x
        r /= np.linalg.norm(r, axis=1)[:, None]
        home = self.home(THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * r)
        ranks = []
        for i in range(0, len(x), 256):
            a, b = self.parts(x[i : i + 256])
            h = home[i : i + 256]
            own = a[np.arange(len(h)), h // self.k] + b[np.arange(len(h)), h % self.k]
            a.sort(1)
            b.sort(1)
            ranks += [1 + sum(np.searchsorted(b[j], own[j] - a[j])) for j in range(len(h))]
        return max(int(np.quantile(r, RECALL, method="higher")) for r in np.array_split(np.array(ranks), min(STRATA, max(1, len(ranks) // 64))))

    def visited(self, x):
        """(vector, cell) of each vector's first cells in multi-sequence order.

        The cell of the p-th nearest first and q-th nearest second codeword comes after p * q - 1
        others at least, so only pairs with p * q up to the number of visits are looked at.
        """
        t = self.visits
        a, b = self.parts(x)
        p, q = np.meshgrid(np.arange(min(t, self.k)), np.arange(min(t, self.k)), indexing="ij")
        ok = (p + 1) * (q + 1) <= t
        p, q = p[ok], q[ok]
        oa, ob = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        row = np.arange(len(x))[:, None]
        total = a[row, oa[:, p]] + b[row, ob[:, q]]
        pick = np.argsort(total, 1, kind="stable")[:, :t]
        cells = (oa[:, p] * self.k + ob[:, q])[row, pick]
        home = a.argmin(1) * self.k + b.argmin(1)
        cells[:, 0] = home  # equal distances: the home cell comes first
        return cells


MEMBER = "rid bigint, vec_id bigint, d int, u array<double>, cell int"


def _nodes(vectors: DataFrame, grid_sent, width, rounds=2) -> DataFrame:
    """MEMBER rows with node_id (the rid of the node's centre) and near (the cosine to it)."""
    own = ["rid", "vec_id", "d", "u", "cell"]

    def place(batches):
        for batch in batches:
            x = _padded(column(batch, "u"), width)
            cell = np.concatenate([grid_sent.value.home(x[at : at + 1024]) for at in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in own[:3]], pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], own)

    def gather(batches):
        for batch in batches:
            near = (_matrix(column(batch, "u")) * _matrix(column(batch, "centre_u"))).sum(1)
            inside = (near >= CORE) | (column(batch, "rid").to_numpy() == column(batch, "centre").to_numpy())
            node = pa.array(column(batch, "centre").to_numpy(), mask=~inside)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in own], node, pa.array(np.minimum(near, 1.0))], [*own, "node_id", "near"])

    rest, out = cut_lineage(vectors.mapInArrow(place, MEMBER)), []
    for _ in range(rounds):
        centre = rest.groupBy("d", "cell").agg(F.min(F.struct("rid", "u")).alias("c")).select("d", "cell", F.col("c.rid").alias("centre"), F.col("c.u").alias("centre_u")).hint("rebalance")
        tried = cut_lineage(rest.join(centre, ["d", "cell"]).select(*own, "centre", "centre_u").mapInArrow(gather, f"{MEMBER}, node_id bigint, near double"))
        out.append(tried.where("node_id is not null"))
        rest = tried.where("node_id is null").select(*own)
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done.unionByName(rest.select(*own, F.col("rid").alias("node_id"), F.lit(1.0).alias("near")))


def _roots(n, a, b):
    """Smallest position reachable over the links (a, b) among n positions."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


FOUND = "a bigint, b bigint, links bigint, open boolean"


def _meet(table):
    """Links between the homes and the visitors of a strip of cells, and pairs of nodes left open."""
    table = table.combine_chunks()
    get = lambda name: table.column(name).to_numpy()
    is_home, node, n, r, home = get("is_home"), get("node_id"), get("n"), get("radius"), get("home")
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(len(node), -1)
    u, off, cells = codes * get("scale")[:, None], get("off"), table.column("cells").to_pylist()
    homes = np.flatnonzero(is_home)
    by_cell = {}
    for h in homes:
        by_cell.setdefault(home[h], []).append(h)
    visitors = {}
    for v in np.flatnonzero(~is_home):
        for c in cells[v]:
            visitors.setdefault(c, []).append(v)
    reach = {h: frozenset(cells[h]) for h in homes}
    links = np.zeros(len(node), np.int64)
    pa_, pb, oa, ob = [], [], [], []
    for c, hs in by_cell.items():
        if c not in visitors:
            continue
        hs, vs = np.array(hs), np.array(visitors[c])
        dot = u[vs] @ u[hs].T
        wide = r[vs][:, None] + r[hs][None, :]
        slack = off[vs][:, None] + off[hs][None, :] + off[vs][:, None] * off[hs][None, :] + 1e-12
        some = (dot + slack >= THRESHOLD) | (wide > 0)
        i, j = np.nonzero(some & (node[vs][:, None] != node[hs][None, :]))
        d, w, m = dot[i, j], wide[i, j], slack[i, j]
        far, close = np.arccos(np.clip(d - m, -1, 1)), np.arccos(np.clip(d + m, -1, 1))
        whole = np.where(w > 0, far + w <= ANGLE - SURE, d - m >= THRESHOLD)
        unsure = ~whole & np.where(w > 0, close - w <= ANGLE + SURE, d + m >= THRESHOLD)
        back = np.fromiter((home[v] in reach[h] for v, h in zip(vs[i], hs[j], strict=True)), bool, len(i))  # does h visit v, too?
        v, h = vs[i], hs[j]
        np.add.at(links, v[whole], n[h[whole]])
        np.add.at(links, h[whole & ~back], n[v[whole & ~back]])
        pa_.append(v[whole])
        pb.append(h[whole])
        once = unsure & (~back | (node[v] < node[h]))
        oa.append(np.minimum(node[v[once]], node[h[once]]))
        ob.append(np.maximum(node[v[once]], node[h[once]]))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    a, b = join(pa_).astype(np.int64), join(pb).astype(np.int64)
    lab = _roots(len(node), a, b)
    met = np.unique(np.concatenate([a, b]))
    oa, ob = join(oa), join(ob)
    return pa.table({"a": pa.array(np.concatenate([node[met], oa]), pa.int64()), "b": pa.array(np.concatenate([node[lab[met]], ob]), pa.int64()), "links": pa.array(np.concatenate([links[met], np.zeros(len(oa), np.int64)])), "open": pa.array(np.arange(len(met) + len(oa)) >= len(met))})


def _compare(table):
    """Members of two nodes, block by block: links per member, and whether the nodes are linked at all."""
    table = table.combine_chunks()
    left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    u, ids = _matrix(table.column("u")), table.column("rid").to_numpy()
    near = u[left] @ u[~left].T >= THRESHOLD
    links = np.zeros(len(ids), np.int64)
    links[left], links[~left] = near.sum(1), near.sum(0)
    some = links > 0
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    m = int(some.sum())
    return pa.table({"rid": pa.array(ids[some]), "links": pa.array(links[some]), "a": pa.array([a] * m, pa.int64()), "b": pa.array([b] * m, pa.int64())})


def _linked(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, n_links, component: the smallest rid reachable) of unit vectors (rid, vec_id, d, u).

    Vectors of different lengths share the grid, filled up with zeros, but never a cell.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max("d")).first()
    sample = _padded(thin(vectors, SAMPLE, "rid").orderBy("vec_id", "rid").select("u").toArrow().column("u"), width)
    if not len(sample):
        sample = _padded(vectors.orderBy("rid").select("u").limit(1).toArrow().column("u"), width)
    sent = spark.sparkContext.broadcast(Grid(sample, n))
    members = cut_lineage(_nodes(vectors, sent, width))
    stats = members.groupBy("node_id").agg(F.count("*").alias("n"), F.min("near").alias("near"))
    radius = F.when(F.col("n") > 1, F.acos(F.least(F.col("near"), F.lit(1.0))) + 1e-12).otherwise(0.0)
    nodes = members.where("rid = node_id").select("node_id", "d", "u", F.col("cell").alias("home")).join(stats, "node_id").select("node_id", "d", "u", "home", "n", radius.alias("radius"))
    nodes = cut_lineage(nodes)
    k = sent.value.k
    homes = {r[0]: r[1] for r in nodes.groupBy((F.col("home") / k).cast("int")).count().collect()}  # one row a codeword
    usual = sum(homes.values()) / max(1, k)
    cuts_h = {i: math.ceil(homes.get(i, 1) / BLOCK) for i in range(k)}
    cuts_v = {i: math.ceil(8 * max(homes.get(i, 1), usual) / BLOCK) for i in range(k)}

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from _strips(batch.slice(at, 512), sent.value, cuts_h, cuts_v)

    strips = nodes.mapInArrow(visit, "strip int, part_h int, part_v int, is_home boolean, node_id bigint, d int, code binary, scale double, off double, home int, n bigint, radius double, cells array<int>")
    found = cut_lineage(strips.groupBy("d", "strip", "part_h", "part_v").applyInArrow(_meet, FOUND))
    sure, unsure = found.where("not open"), found.where("open").select("a", "b").distinct()
    per_node = sure.groupBy(F.col("a").alias("node_id")).agg(F.sum("links").alias("links"))
    edges = sure.select("a", "b")
    per_vec = None
    if not unsure.isEmpty():
        parts = lambda side: F.greatest(F.ceil(F.col(f"n_{side}") / BLOCK), F.lit(1)).cast("int")
        sizes = lambda side: nodes.select(F.col("node_id").alias(side), F.col("n").alias(f"n_{side}"))
        pairs = cut_lineage(unsure.join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", parts("a").alias("pa"), parts("b").alias("pb")))
        own = lambda p: F.pmod(F.xxhash64("rid"), F.col(p)).cast("int")
        every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
        of = lambda side: pairs.join(members.select(F.col("node_id").alias(side), "rid", "u"), side)
        left = of("a").select("a", "b", own("pa").alias("i"), every("pb").alias("j"), F.lit(True).alias("left"), "rid", "u")
        right = of("b").select("a", "b", every("pa").alias("i"), own("pb").alias("j"), F.lit(False).alias("left"), "rid", "u")
        compared = cut_lineage(left.unionByName(right).groupBy("a", "b", "i", "j").applyInArrow(_compare, "rid bigint, links bigint, a bigint, b bigint"))
        per_vec = compared.groupBy("rid").agg(F.sum("links").alias("more"))
        edges = edges.unionByName(compared.select("a", "b").distinct())
    comp = components(edges)
    about = stats.select("node_id", "n").join(per_node, "node_id", "left").join(comp.select(F.col("node").alias("node_id"), "component"), "node_id", "left")
    about = about.select("node_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node_id").alias("component")).hint("rebalance")
    out = members.select("rid", "vec_id", "node_id").join(about, "node_id")
    if per_vec is not None:
        out = out.join(per_vec, "rid", "left").withColumn("links", F.col("links") + F.coalesce("more", F.lit(0)))
    return out.select("rid", "vec_id", F.col("links").cast("bigint").alias("n_links"), "component")


def _strips(batch, grid, cuts_h, cuts_v):
    x = _matrix(column(batch, "u"))
    cells = grid.visited(x)
    strip = cells // grid.k
    order = np.argsort(strip, 1, kind="stable")
    ids, home = column(batch, "node_id").to_numpy(), column(batch, "home").to_numpy()
    out = {name: [] for name in ("strip", "part_h", "part_v", "is_home", "row", "cells")}

    def add(s, ph, pv, is_home, i, c):
        for name, v in zip(out, (s, ph, pv, is_home, i, c), strict=True):
            out[name].append(v)

    for i in range(len(x)):
        s, c = strip[i][order[i]], cells[i][order[i]]
        own = int(home[i]) // grid.k
        for pv in range(cuts_v[own]):
            add(own, int(ids[i]) % cuts_h[own], pv, True, i, c)
        for cut in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
            g = int(s[cut[0]])
            for ph in range(cuts_h[g]):
                add(g, ph, int(ids[i]) % cuts_v[g], False, i, c[cut])
    row = np.array(out["row"], np.int64)
    codes, scale, off = _coded(x)
    whole = {"code": pa.array(codes, pa.binary()), "scale": pa.array(scale), "off": pa.array(off)}
    first = [pa.array(out[name], t) for name, t in (("strip", pa.int32()), ("part_h", pa.int32()), ("part_v", pa.int32()), ("is_home", pa.bool_()))]
    names = ["node_id", "d", "code", "scale", "off", "home", "n", "radius"]
    for at in range(0, len(row), 4096):  # batches of bounded size
        cut = lambda a: a.slice(at, 4096)  # noqa: B023, E731
        keep = [(whole[name] if name in whole else column(batch, name)).take(pa.array(row[at : at + 4096])) for name in names]
        yield pa.RecordBatch.from_arrays([*map(cut, first), *keep, pa.array(out["cells"][at : at + 4096], pa.list_(pa.int32()))], ["strip", "part_h", "part_v", "is_home", *names, "cells"])


def links(embeddings: DataFrame) -> DataFrame:
    """One row per row: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do
    vectors of different lengths with each other. Every row is a vector of its own, whatever its id:
    rows of a repeated id link with each other as their vectors say, and all that bear the smallest id
    are kept. A null id counts as none: a component without any other has a null component_id, and
    its rows are kept. An empty table gives no rows.
    """
    rows = embeddings.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut_lineage(rows.mapInArrow(_unit, "rid bigint, vec_id bigint, d int, u array<double>"))
    alone = rows.where("u is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    units, out = rows.where("u is not null"), alone
    if not units.isEmpty():
        found = cut_lineage(_linked(units))
        least = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        out = attach(found, least, "component").select(*alone.columns).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
