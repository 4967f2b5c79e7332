"""Byte-level BPE with Spark's higher-order functions.

A text is cut into pre-tokens by the tokenizer's pattern. A distinct word is an array of byte ids; aggregate()
folds over it, each round merging the leftmost pair of lowest rank, with the ranks of neighbouring pairs kept
beside the pieces, so that a round looks up two ranks only. The rank map is a literal of the plan: from a pair of
ids to the rank of their bytes together, which is the id of the merged piece. Decoding looks each id up in a literal
array of pieces and concatenates them.

Ranks as training gives them are ordered(): the merges of a word go up in rank, so pairs of one rank are the same two pieces. Then the
fold's state is one array of numbers, each a neighbouring pair with its rank before it, and a turn finds the least and puts the two
pairs beside it anew. Other ranks are folded with pieces and ranks in two arrays.

Literals are flat bytes (one unsafe array each), so a task reads them in with one copy. Pieces are strings of code
points below 256, one for each byte.

Known words are looked up, not folded: the vocabulary's own strings, which the tokenizer's library takes whole, and the
WORDS most frequent words (of at most WORD_BYTES bytes) of a bounded sample of documents, each folded once. This only saves time: other words are
folded where they stand.
"""

from __future__ import annotations

import base64
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Addresses of the literal maps, a power of two.
SLOTS = 1 << 18
#: Rank of pairs that never merge.
NONE = (1 << 31) - 1
#: Bits of an id in a packed pair, and the id beside a word's ends; what is added to pairs that never merge.
BITS, END, NEVER = 17, (1 << 17) - 1, 1 << 62
#: A prime below SLOTS, which packed pairs are spread by.
PRIME = 262_139
#: Factors that join a pair of ids into a key and into an address.
KEY, ADDRESS = 1 << 20, 7919
#: Bounds of the frequent words and of the documents that they are counted in.
WORDS, SAMPLE = 3 << 17, 20_000
#: Bytes of a word that may be among the known ones, so the literal's size is bounded.
WORD_BYTES = 64

#: White space as the tokenizer's pattern language knows it.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    """The pattern with its white-space classes written out, as Java's are ASCII."""
    return pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ordered(ranks: dict[bytes, int]) -> bool:
    """Whether each string is two pieces (or a byte) once the merges of lower rank are made.

    If so, a merge never makes one of lower rank possible: those bytes would have been two pieces, and merged, before.
    """
    for text, rank in ranks.items():
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 2:
            beside = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            low = min(beside)
            if low >= rank:
                return False
            at = beside.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def constant(row: DataFrame) -> Column:
    """The one value of a one-row frame as a literal of flat bytes, however often the plan names it; nothing passes through Python."""
    jvm = row.sparkSession.sparkContext._jvm
    value = row._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0).copy()
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, row._jdf.schema().apply(0).dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def constant_map(entries: DataFrame) -> Column:
    """A literal array of SLOTS maps from the rows (slot, key, value), each with the entries of its slot."""
    maps = entries.groupBy(F.col("slot").cast("bigint").alias("id")).agg(F.collect_list(F.struct("key", "value")).alias("e"))
    rows = F.array_sort(F.collect_list(F.struct("id", "e")))
    every = entries.sparkSession.range(SLOTS).join(maps, "id", "left")
    return constant(every.agg(F.transform(rows, lambda r: F.map_from_entries(r["e"])).alias("slots")))


def word_slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(SLOTS - 1).cast("int")


def pair_slot(a: Column, b: Column) -> Column:
    return (a * ADDRESS + b).bitwiseAND(SLOTS - 1)


def pair_key(a: Column, b: Column) -> Column:
    return a.cast("bigint") * KEY + b


def joined(*arrays: Column) -> Column:
    """Arrays end to end; quicker in lambdas than concat()."""
    return F.flatten(F.array(*arrays))


def folded(word: Column, bytes_: Column, ranks: Column) -> Column:
    """The ids of a word (not empty): bytes_ has the id of each byte, ranks those of pairs of ids."""
    rank = lambda a, b: F.coalesce(F.element_at(F.get(ranks, pair_slot(a, b)), pair_key(a, b)), F.lit(NONE))
    pieces = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(bytes_, F.ascii(c)))
    beside = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), rank)
    start = F.get(F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), beside(p).alias("r"), F.lit(1).alias("at"))), F.lit(0))

    def step(acc: Column, turn: Column) -> Column:
        # at: where the lowest rank is, from 1; 0 once no pair merges
        p, r, at = acc["p"], acc["r"], acc["at"]
        found = F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.array_position(r, F.array_min(r)).cast("int"), F.lit(0)).alias("at"))
        new = F.get(r, at - 1)
        none = F.slice(r, F.lit(1), F.lit(0))
        left, before = F.when(at > 1, F.array(rank(F.get(p, at - 2), new))).otherwise(none), F.when(at > 2, F.slice(r, F.lit(1), at - 2)).otherwise(none)
        right = F.when(at < F.size(r), F.array(rank(new, F.get(p, at + 1)))).otherwise(none)
        merged = F.struct(
            joined(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
            joined(before, left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
            at.alias("at"),
        )
        ended = F.struct(p.alias("p"), r.alias("r"), F.lit(0).alias("at"))
        # odd turns choose the pair, even turns merge it
        return F.when(at == 0, acc).when(turn % 2 == 1, found).when(F.get(r, at - 1) == NONE, ended).otherwise(merged)

    turns = F.sequence(F.lit(1), F.octet_length(word) * 2 - 2)
    return F.when(F.octet_length(word) > 1, F.aggregate(turns, start, step, lambda acc: acc["p"])).otherwise(pieces)


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def folded_ordered(word: Column, bytes_: Column, pairs: Column) -> Column:
    """The ids of a word (not empty) by ordered ranks: pairs has, of pairs of ids (a << BITS | b), the same with their rank before it."""
    entry = lambda k: F.coalesce(F.element_at(F.get(pairs, (k % PRIME).cast("int")), k), k + NEVER)
    end = F.array(F.lit(END).cast("bigint"))
    pieces = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(bytes_, F.ascii(c)).cast("bigint"))
    start = bound(pieces, lambda p: F.transform(F.zip_with(joined(end, p), joined(p, end), lambda a, b: a * (1 << BITS) + b), entry))

    def merged(p: Column, low: Column, at: Column) -> Column:
        # the pair's rank is the new piece's id; a pair stands on either side, as the word's ends are paired too
        new = F.shiftright(low, 2 * BITS)
        before, behind = F.get(p, at - 2).bitwiseAND(END << BITS) + new, new * (1 << BITS) + F.get(p, at).bitwiseAND(END)
        return joined(F.slice(p, F.lit(1), at - 2), F.transform(F.array(before, behind), entry), F.slice(p, at + 2, F.size(p)))

    def step(p: Column, _: Column) -> Column:
        merge = lambda low: bound(F.array_position(p, low).cast("int"), lambda at: merged(p, low, at))
        return bound(F.array_min(p), lambda low: F.when(low >= NEVER, p).otherwise(merge(low)))

    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1))
    left = bound(F.aggregate(turns, start, step), lambda p: F.slice(p, F.lit(2), F.size(p) - 1))
    return F.transform(left, lambda x: F.shiftright(x, BITS).bitwiseAND(END).cast("int"))


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


class Tokenizer:
    """Ranks of a tokenizer and its pattern; the file is read where the plan is made."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.pattern = spark, pattern
        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("ranks must be 0, 1, 2 ... and hold every byte")

        self.bytes = F.lit([self.ranks[bytes([b])] for b in range(256)])

    @cached_property
    def ordered(self) -> bool:
        return len(self.ranks) <= END and ordered(self.ranks)

    def folded(self, word: Column, ranks: Column) -> Column:
        return (folded_ordered if self.ordered else folded)(word, self.bytes, ranks)

    def rank_map(self) -> Column:
        ranks = self.ranks
        pairs = ((ranks.get(t[:k]), ranks.get(t[k:]), v) for t, v in ranks.items() for k in range(1, len(t)))
        rows = self.spark.createDataFrame([x for x in pairs if x[0] is not None and x[1] is not None], "a int, b int, value int", verifySchema=False)
        a, b = F.col("a"), F.col("b")
        if self.ordered:
            key = a.cast("bigint") * (1 << BITS) + b
            return constant_map(rows.select((key % PRIME).cast("int").alias("slot"), key.alias("key"), (F.col("value").cast("bigint") * (1 << 2 * BITS) + key).alias("value")))
        return constant_map(rows.select(pair_slot(a, b).alias("slot"), pair_key(a, b).alias("key"), "value"))

    def pieces(self) -> Column:
        rows = self.spark.createDataFrame([(v, k.decode("latin-1")) for k, v in self.ranks.items()], "id int, piece string", verifySchema=False)
        return constant(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda r: r["piece"]).alias("pieces")))

    def vocabulary(self) -> DataFrame:
        """key, value: strings of the vocabulary and their one id."""
        rows = [(k.decode(errors="replace"), [v]) for k, v in self.ranks.items() if k.decode(errors="replace").encode() == k]
        return self.spark.createDataFrame(rows, "key string, value array<int>", verifySchema=False)

    def known(self, texts: DataFrame, ranks: Column) -> Column:
        """The literal map of known words, the frequent ones from a sample of about SAMPLE rows."""
        n = max(1, texts.count())
        words = (texts if n <= SAMPLE else texts.sample(SAMPLE / n, seed=4)).select(F.explode(words_of(F.col("text"), self.pattern)).alias("key")).where(F.octet_length("key") <= WORD_BYTES)
        own = self.vocabulary()
        counts = words.groupBy("key").count().join(own.select("key"), "key", "left_anti")
        top = counts.orderBy(F.desc("count"), "key").limit(WORDS).select("key").repartition(16)
        rows = own.unionByName(top.select("key", self.folded(F.col("key"), ranks).alias("value")))
        return constant_map(rows.select(word_slot(F.col("key")).alias("slot"), "key", "value"))

    def ids(self, text: Column, known: Column, ranks: Column) -> Column:
        """The ids of a text."""
        one = lambda w: F.coalesce(F.element_at(F.get(known, word_slot(w)), w), self.folded(w, ranks))
        return F.flatten(F.transform(words_of(text, self.pattern), one))

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        pieces = self.pieces()
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) per row of docs.

    Null and empty texts have no ids; repeated rows and null ids give a row each; an empty table gives none; other
    columns are not read.
    """
    tokenizer = Tokenizer(docs.sparkSession, path, pattern)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text, ranks = F.coalesce("text", F.lit("")), tokenizer.rank_map()
    return rows.select("doc_id", tokenizer.ids(text, tokenizer.known(rows.select(text.alias("text")), ranks), ranks).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary) from doc_id and ids; null ids decode to null."""
    return encoded.select("doc_id", "ids", Tokenizer(encoded.sparkSession, path, pattern).decoded(F.col("ids")).alias("decoded"))


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    """The contract's columns, and more columns of decoded."""
    return decoded.select("doc_id", *more, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
