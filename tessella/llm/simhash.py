"""SimHash near-duplicates with pivot distance tables.

Distinct fingerprints only are compared. Fingerprints at three or fewer differing bits agree on at least three of
six bit blocks, so each is filed under its 20 choices of three blocks (about 32 equal bits a file): every linked
pair meets, without a cross join. In a file, each fingerprint has a row of precomputed Hamming distances to PIVOTS reference
fingerprints; by the triangle inequality a pair with any coordinate more than three apart is not linked and is
discarded; survivors are verified by the exact distance. A file of more than FILE fingerprints is not compared:
its members are filed again by the same rule on the bits that are still free, which leaves about 16 and then
9 free bits, so the last files hold 512 distinct fingerprints at most. Files give spanning links, not all
pairs, and components follow from them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, ids_and_text, written
from .graph import components

BITS = 3
PIVOTS = 16
FILE = 1024
BLOCKS = 6


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of lower-cased (A-Z) word shingles under XXH64 with seed 42, as a signed 64-bit integer; no words: 0."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint) per row of docs."""
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])
    return arrow_map(ids_and_text(docs, id_col, text_col), lambda rows: ((i, fingerprint(t)) for i, t in rows), schema)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def choices(free: int) -> list[int]:
    """Masks of all choices of three of the six blocks into which the free bits are cut."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=object), BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - BITS)]


ALL = (1 << 64) - 1
FIRST = choices(ALL)


def mask_of(path: int) -> int:
    """The bits that are equal in a file of this path: 1 + choice at each level, as digits to the base 21."""
    fixed = 0
    for digit in digits(path):
        fixed |= choices(ALL & ~fixed)[digit - 1]
    return fixed


def digits(path: int) -> list[int]:
    out = []
    while path:
        path, d = divmod(path, 21)
        out.append(d)
    return out[::-1]


FILED = StructType([StructField("path", LongType()), StructField("value", LongType()), StructField("fp", LongType())])
#: a, b: a link, path null. Else a fingerprint (a) of a file that is to be filed again.
FOUND = StructType([StructField("path", LongType()), StructField("a", LongType()), StructField("b", LongType())])


def pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, np.uint64)


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices) of fingerprints that share a key; equal keys stand together.

    Pairs are met by their distance d in the order; the coordinates of the pivot table discard, the rest is verified.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    label = np.arange(len(fps))
    found_a, found_b = [], []
    at, d = np.arange(len(fps)), 0
    while True:
        d += 1
        at = at[at + d < len(fps)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        left = at
        for j in range(0, PIVOTS, 4):  # a few coordinates at a time: most pairs go with the first ones
            left = left[np.abs(table[left, j : j + 4] - table[left + d, j : j + 4]).max(axis=1) <= BITS] if len(left) else left
        left = left[np.bitwise_count(fps[left] ^ fps[left + d]) <= BITS]
        if len(left):
            found_a.append(left)
            found_b.append(left + d)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    while True:  # labels fall to the smallest index of the component
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(fps)))
    return child, label[child]


def compare(filed: DataFrame, limit: int) -> DataFrame:
    """Links of each file, and the members of files over the limit."""

    def run(batches):
        held: list[np.ndarray] = []  # path, value, fp of whole files and the open last one
        size, over = 0, None

        def out(path, a, b):
            return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["path", "a", "b"])

        def flush(rows: np.ndarray):
            if len(rows):
                change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
                keys = np.concatenate([[0], np.cumsum(change)])
                big = np.bincount(keys)[keys] > limit
                if big.any():
                    again = rows[big]
                    yield out(again[:, 0], again[:, 2], again[:, 2])
                    rows, keys = rows[~big], keys[~big]
                child, root = links(keys, rows[:, 2].astype(np.uint64)) if len(rows) else ([], [])
                if len(child):
                    yield out([None] * len(child), rows[child, 2], rows[root, 2])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if over is not None:  # the rest of a file that is known to be over the limit
                same = int(np.argmin(np.append(np.all(rows[:, :2] == over, axis=1), False)))
                if same:
                    yield out(rows[:same, 0], rows[:same, 2], rows[:same, 2])
                    rows = rows[same:]
                if not len(rows):
                    continue
                over = None
            held.append(rows)
            size += len(rows)
            if size >= 1 << 14:
                rows = np.concatenate(held)
                last = rows[-1, :2]
                start = len(rows) - int(np.argmin(np.append(np.all(rows[::-1, :2] == last, axis=1), False)))
                yield from flush(rows[:start])
                rest = rows[start:]
                if len(rest) > limit:
                    yield out(rest[:, 0], rest[:, 2], rest[:, 2])
                    held, size, over = [], 0, last
                else:
                    held, size = [rest], len(rest)
        if held:
            yield from flush(np.concatenate(held))

    return filed.repartition("path", "value").sortWithinPartitions("path", "value", "fp").mapInArrow(run, FOUND)


def refile(again: DataFrame) -> DataFrame:
    """Members of files over the limit, under the choices of their free bits."""

    def run(batches):
        known: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for path, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path not in known:
                    fixed = mask_of(path)
                    known[path] = fixed, choices(ALL & ~fixed)
                fixed, masks = known[path]
                rows = [(path * 21 + 1 + k, signed(fp & ALL & (fixed | m)), fp) for k, m in enumerate(masks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["path", "value", "fp"])

    return again.select("path", "a").mapInArrow(run, FILED)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """a, b: links that connect exactly the components of distinct fingerprints (fp) at BITS or fewer bits."""
    filed = distinct.select(F.explode(F.array(*(F.struct(F.lit(1 + k).cast("bigint").alias("path"), F.col("fp").bitwiseAND(signed(m)).alias("value"), "fp") for k, m in enumerate(FIRST)))).alias("f")).select("f.*")
    found = None
    for level in range(3):
        # 32, 16 and 9 free bits at most: the last files are bounded by 512 distinct fingerprints
        part = written(compare(filed, FILE if level < 2 else 1 << 30), "links")
        edges = part.where("path is null").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        again = part.where("path is not null")
        if level == 2 or again.isEmpty():
            return found
        filed = refile(again)
    return found


def labelled(fps: DataFrame) -> DataFrame:
    """fp, component (a fingerprint), component_id (smallest doc_id of the component), one row per distinct fp."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    stars = components(fingerprint_links(nodes.select("fp")))
    nodes = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return nodes.select("fp", "component").join(least, "component")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of docs.

    Null, empty and wordless texts have fingerprint zero and link like others; repeated rows give a row each; a null
    doc_id is never a component_id unless all ids of its component are null; an empty table gives no rows; other
    columns are not read.
    """
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    return fps.join(labelled(fps).select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (columns of documents) with one row of each component: that of its smallest doc_id."""
    columns = docs.columns
    taken = next(n for n in map("_fp{}".format, range(1 << 20)) if n not in columns)
    schema = StructType([*docs.schema.fields, StructField(taken, LongType())])
    at = columns.index("text")

    def run(rows):
        for row in rows:
            yield *row, fingerprint((row[at] or "").encode())

    marked = written(arrow_map(docs, run, schema), "marked")
    fps = marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(taken).alias("fp"))
    labels = labelled(fps)
    # one (doc_id, fp) a component: the smallest id, and of its fingerprints the smallest
    first = fps.join(labels, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.first("component_id").alias("winner"), F.min("fp").alias("winner_fp"))
    kept = marked.join(first.select("winner", "winner_fp"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("winner")) & (F.col(taken) == F.col("winner_fp")))
    return kept.dropDuplicates(["winner", "winner_fp"]).select(*columns)


def hex_of(fp: int) -> str:
    return f"{fp & ALL:016x}"

