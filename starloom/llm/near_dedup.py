"""Near-duplicate documents by SuperMinHash, banding, verification and grouping.

1. One pass over the texts makes each document's shingle set, a digest of the
   set, and its SuperMinHash signature: every element walks the signature's
   slots in its own random order, the j-th slot it visits gets ``j + r``, and
   slots keep the least. The walk of a document stops at the first j that no
   slot can improve on.
2. Documents with equal sets form one class; from here on a class is one node.
3. Signatures are cut in bands. In each band bucket every node is paired with
   the bucket's smallest node, so pairs stay linear in the bucket.
4. Pairs are confirmed on full sets, and confirmed links are grouped.
5. Nodes of buckets that still hold several groups fall, by an exact filter on
   their rarest shingles, into families; these are compared block by block, so
   no link inside a bucket is passed over and no pairs are emitted but links
   that join groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, arrow_rows, small
from starloom.llm.graph import components

SLOTS, BAND_ROWS = 128, 4
#: About as many sets, and their elements, make a block.
BLOCK_SETS, BLOCK_ELEMENTS = 192, 1_000_000
#: Elements worked on at a time, remembered words of a task, texts of a batch: bounds on memory only.
CHUNK, VOCABULARY, BATCH_ROWS = 1 << 15, 1 << 17, 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    ASCII letters are lower-cased; a text of fewer words than ``width`` is one
    shingle; one without words, or null, has none.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(ids) - width + 1)
    parts = [ids[i : i + n] for i in range(width)] if len(ids) >= width else [ids[i : i + 1] for i in range(len(ids))]
    h = np.full(n, len(parts), np.uint64)
    for part in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs, slots) of the sets whose members are ``elements``, of document ``doc``.

    Values order as ``j + r``: j in the high byte, the fraction r below it.
    """
    sig = np.full((n_docs, slots), _EMPTY, np.uint64)
    flat = sig.reshape(-1)
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        r = _mix(elements + np.uint64((0xA0761D6478BD642F * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
        draw = _mix(elements + np.uint64((0xA0761D6478BD642F * (2 * j + 2)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)
        k = j + ((draw * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(elements))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(flat, doc * slots + slot, np.uint64(j << 56) | (r >> np.uint64(8)))
        open_docs = sig.max(axis=1) >= np.uint64((j + 1) << 56)
        keep = open_docs[doc]
        if perm is None:
            elements, doc, k = elements[keep], doc[keep], k[keep]
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
            perm[np.arange(len(elements)), k] = 0
        elif not keep.all():
            elements, doc, perm = elements[keep], doc[keep], perm[keep]
    return sig


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of several sets; a set beyond ``CHUNK`` elements is taken in parts, whose least values are its own."""
    out = np.full((len(sets), slots), _EMPTY, np.uint64)
    for i, s in enumerate(sets):
        if len(s) > CHUNK:
            for at in range(0, len(s), CHUNK):
                part = s[at : at + CHUNK]
                out[i] = np.minimum(out[i], superminhash(part, np.zeros(len(part), np.int64), 1, slots)[0])
    short = [i for i, s in enumerate(sets) if 0 < len(s) <= CHUNK]
    if short:
        elements = np.concatenate([sets[i] for i in short])
        doc = np.repeat(np.arange(len(short)), [len(sets[i]) for i in short])
        out[short] = superminhash(elements, doc, len(short), slots)
    return out


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    n, slots = sig.shape
    bands = sig.reshape(n, slots // rows, rows)
    h = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64) + np.uint64(1), bands.shape[:2]).copy()
    for i in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return h.view(np.int64)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def sketch(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Adds n_shingles, cls (digest of the shingle set), text_digest and bands to ``docs(rid..., text)`` less its text."""
    keys = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys), "n_shingles bigint", "cls binary", "text_digest binary", "bands array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, start = batch.column(batch.schema.get_field_index(text)), 0
            while start < len(texts):
                sets, size, end, digests = [], 0, start, []
                while end < len(texts) and size < CHUNK:
                    one = _binary(texts.slice(end, 1))[0]
                    sets.append(shingle_set(one, width, words))
                    digests.append(md5(one or b"", usedforsecurity=False).digest())
                    size += len(sets[-1])
                    end += 1
                keys_of = band_keys(signatures(sets))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys_of.size + 1, keys_of.shape[1]), pa.int32()), pa.array(keys_of.reshape(-1)))
                rows = [batch.column(batch.schema.get_field_index(c)).slice(start, end - start) for c in keys]
                rows += [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(digests, pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(rows, [*keys, "n_shingles", "cls", "text_digest", "bands"])
                start = end

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, members) of ``docs(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, nodes = batch.column(1), batch.column(0)
            for at in range(0, len(texts), 64):
                sets = [shingle_set(t, width, words).view(np.int64) for t in _binary(texts.slice(at, 64))]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([nodes.slice(at, len(sets)), members], ["node", "members"])

    return docs.select("node", text).mapInArrow(run, "node bigint, members array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, digest: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept; with ``digest``, also the text's MD5 by that name.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    distinct ``width``-word shingles; confirmed on full sets. component_id is the
    smallest id reachable over links, the row's own included; kept marks the row
    that carries it.

    Null or wordless texts have no shingles, link with nothing and are kept. A
    null id never becomes a component_id unless its whole group has no other;
    rows that repeat an id all carry kept if they carry the smallest id. Other
    columns are ignored, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        rows = ws.save(sketch(base, "text", width), "rows")
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("cls").agg(F.min("id").alias("least_id"), F.first("n_shingles").alias("n"), F.min("text_digest").alias("text_digest"), F.first("bands").alias("bands"))
    classes = ws.save(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")

    keyed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # Written first: a side that is a table, not an aggregate, lets a hot bucket of the other be split.
    shared = ws.save(keyed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("leader")).filter("m > 1"), "shared")
    members = ws.save(keyed.join(shared, "bucket"), "members")
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    sizes = classes.select(F.col("node").alias("leader"), F.col("n").alias("n2"))
    stars = members.filter("node <> leader").select("node", "n", "leader").distinct().join(sizes, "leader").filter(fits)
    stars = ws.save(stars.select(F.col("leader").alias("u"), F.col("node").alias("v")), "stars")
    nodes = stars.select(F.col("u").alias("node")).union(stars.select(F.col("v").alias("node"))).distinct()
    links = _confirm(ws, _full_sets(ws, base, rows, classes, nodes, width, "stars"), stars, percent, "links")
    group = ws.save(components(ws, links, "first"), "group")

    # What the stars leave open: members of a bucket that are in different groups.
    placed = members.filter("m > 2").join(group, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = ws.save(placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket"), "mixed")
    nodes = ws.save(placed.join(mixed, "bucket").select("node").distinct(), "open")
    sets = _full_sets(ws, base, rows, classes, nodes, width, "open")
    posts = _rare_shingles(ws, sets, percent)
    more = ws.save(_block_links(ws, sets, posts, percent), "block-links")
    group = components(ws, links.union(more), "last")

    ids = classes.join(group, "node", "left").select("cls", "least_id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = ws.save(ids.join(least, "root").select("cls", "component_id"), "ids")
    placed = rows.select("id", "n_shingles", "cls", "text_digest").join(ids, "cls", "left").select("id", "n_shingles", "text_digest", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = ws.save(placed.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("text_digest").alias(digest)] if digest else [])), "out")
    ws.keep("out")
    return out


def _full_sets(ws: Workspace, base: DataFrame, rows: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, label: str) -> DataFrame:
    """(node, members) of ``nodes(node)``, hashed again from one text of each class, written."""
    wanted = ws.save(classes.join(nodes.select("node"), "node").select("node", "text_digest"), f"{label}-wanted")
    texts = rows.select(F.col("id").alias("rid"), "text_digest").join(small(wanted), "text_digest").groupBy("node").agg(F.min("rid").alias("rid"), F.first("text_digest").alias("text_digest"))
    texts = ws.save(texts, f"{label}-texts")
    # A row's id finds its text; where ids repeat, the digest decides.
    found = base.join(small(texts.select(F.col("rid"), "node", "text_digest")), base.id.eqNullSafe(F.col("rid"))).select("node", "text", "text_digest")
    found = found.filter(F.unhex(F.md5(F.col("text"))) == F.col("text_digest")).select("node", "text")
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        sets = ws.save(_sets(found, "text", width).groupBy("node").agg(F.first("members").alias("members")), f"{label}-sets")
    ws.drop(f"{label}-wanted", f"{label}-texts")
    return sets


def _rare_shingles(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, pos, token) of each set's rarest shingles, those of one set only left out, written.

    Shingles are ordered rarest first. Two sets that share enough must share one
    of the first ``n - ceil(n * percent / 100) + 1`` of either.
    """
    token = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("df"))
    ranked = token.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = F.expr(f"slice(t, 1, n - cast(ceil(n * {percent} / 100) as int) + 1)")
    posts = ranked.select("node", "n", F.posexplode(first).alias("pos", "x")).filter("x.df > 1")
    return ws.save(posts.select("node", "n", "pos", F.col("x.token").alias("token")), "posts")


def _block_links(ws: Workspace, sets: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all alike sets which share a rare shingle, as few as join them.

    Sets that share rare shingles form a family, and no alike pair crosses
    families. A family is dealt into blocks of bounded size, and a task compares
    two blocks: it returns only links that join what it has not joined yet, so
    neither a task's input nor its output grows with the family. Block pairs are
    dealt out anew: rows that a join left together by family would else stay so.
    """
    hubs = small(ws.save(posts.groupBy("token").agg(F.min("node").alias("hub")), "hubs"))
    chain = posts.join(hubs, "token").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    family = ws.save(components(ws, chain, "family"), "family").withColumnRenamed("root", "family")
    placed = sets.join(family, "node")
    many = family.join(sets.select("node", F.size("members").alias("size")), "node").groupBy("family").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int")
    placed = placed.join(small(ws.save(many.select("family", blocks.alias("blocks")), "blocks")), "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node", "members")

    def compare(table: pa.Table) -> pa.Table:
        node, own = table["node"].to_numpy(), table["own"].to_numpy()
        column = table["members"].combine_chunks()
        size = np.diff(column.offsets.to_numpy())
        values, code = np.unique(column.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(node)), size)
        often = np.bincount(code, minlength=len(values)) > 1
        code, row = (np.cumsum(often) - 1)[code[often[code]]], row[often[code]]
        left, right = own == table["i"][0].as_py(), own == table["j"][0].as_py()
        common = np.zeros((left.sum(), right.sum()), np.float32)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            part = np.zeros((len(node), 4096), np.float32)
            part[row[lo:hi], code[lo:hi] - at] = 1
            common += part[left] @ part[right].T
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        x, y = np.nonzero((100 * common >= percent * (size[a][:, None] + size[b][None] - common)) & (a[:, None] != b[None]))
        parent = list(range(len(node)))

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        u_out, v_out = [], []
        for p, q in zip(a[x].tolist(), b[y].tolist(), strict=True):
            fp, fq = find(p), find(q)
            if fp != fq:
                parent[fp] = fq
                u_out.append(node[p])
                v_out.append(node[q])
        return pa.table({"u": pa.array(u_out, pa.int64()), "v": pa.array(v_out, pa.int64())})

    return dealt.repartition("family", "i", "j").groupBy("family", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def _confirm(ws: Workspace, sets: DataFrame, pairs: DataFrame, percent: int, label: str) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full sets are alike enough, written."""
    a = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    done = pairs.join(b, "v").join(a, "u").filter(100 * both >= percent * (F.size("a") + F.size("b") - both))
    return ws.save(done.select("u", "v"), label)
