"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over word ids of all items (items separated by restarts), so it holds
every run of words of every item once. Training words stream through it; at each word the
automaton knows the longest run ending there that also stands in some item. A run of at least
`window` words marks its words; items of fewer words are one window of their own length.

Items are dealt to shards of at most SHARD_WORDS words, a shard is broadcast as its items, and each worker builds
its automaton (at most 2 * SHARD_WORDS states) once. ROUND shards are scanned in one pass over the documents; a larger
benchmark takes more passes, each written to the shared folder, so neither a worker's nor a broadcast's memory grows
with it. Words are hit if any shard hits them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_map, ids_and_text, ship, utf8, worker_cache, written

SHARD_WORDS, ROUND = 200_000, 4
WINDOW = 10

#: Bytes outside words become spaces, A-Z become a-z; bytes of non-ASCII characters are kept.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Suffix automaton over word ids; each state knows the items in which its runs occur."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        items = [(key, words) for key, words in items if words]
        self.keys = [key for key, _ in items]
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._add(last, w)
        self._mark(coded)

    def _add(self, last: int, w: int) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        if w in nxt[last]:  # the run is already there, from an earlier item
            q = nxt[last][w]
            return q if longest[q] == longest[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if longest[q] == longest[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _mark(self, coded: list[list[int]]) -> None:
        """found[s]: (length, item) windows that end whenever s is reached with that length at least; via suffix links."""
        own: dict[int, dict[int, set[int]]] = {}
        for item, words in enumerate(coded):
            need = min(self.window, len(words))
            state = length = 0
            for w in words:
                state, length = self.next[state][w], length + 1
                while self.longest[self.link[state]] >= need:
                    state = self.link[state]
                    length = min(length, self.longest[state])
                if length >= need:
                    own.setdefault(state, {}).setdefault(need, set()).add(item)
        order = sorted(range(len(self.next)), key=self.longest.__getitem__)
        self.found: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(order)
        for s in order:
            above = self.found[self.link[s]] if s else ()
            merged = above + tuple((n, frozenset(x)) for n, x in sorted(own.get(s, {}).items()))
            self.found[s] = merged

    def scan(self, words: list[bytes]):
        """Yields (end word index exclusive, longest window length that ends there, item numbers of all windows that end there)."""
        nxt, link, longest, found = self.next, self.link, self.longest, self.found
        state = length = 0
        get = self.ids.get
        for at, w in enumerate(map(get, words), 1):
            if w is None:
                state = length = 0
                continue
            while (to := nxt[state].get(w)) is None and state:
                state = link[state]
                length = longest[state]
            if to is None:
                state = length = 0
                continue
            state, length = to, length + 1
            if found[state]:
                most, items = 0, None
                for n, x in found[state]:
                    if n <= length:
                        most = max(most, n)
                        items = x if items is None else items | x
                if most:
                    yield at, most, items

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans (start, end exclusive) inside any window, and the keys of the items met."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, n, found in self.scan(words):
            items |= found
            start = end - n
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
        return spans, {self.keys[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards_of(benchmark: DataFrame) -> list:
    """Broadcasts the items of each shard, in order: at most SHARD_WORDS words or a single item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), utf8("text").alias("text"))
    sent, held, size = [], [], 0
    # items stream through the driver; one shard is held at a time
    for key, text in items.orderBy("item_id", "text").toLocalIterator():
        words = words_of(bytes(text))
        if held and size + len(words) > SHARD_WORDS:
            sent.append((uuid.uuid4().hex, ship(benchmark.sparkSession, held)))
            held, size = [], 0
        held.append((key, words))
        size += len(words)
    if held:
        sent.append((uuid.uuid4().hex, ship(benchmark.sparkSession, held)))
    return sent


def automata(shards: list, window: int) -> list[Automaton]:
    """The shards' automata, built once in a worker's process, which keeps those of one round only."""
    cache = worker_cache().setdefault("automata", {})
    wanted = {(name, window): get for name, get in shards}
    for key in [k for k in cache if k not in wanted]:
        del cache[key]
    for key, get in wanted.items():
        if key not in cache:
            cache[key] = Automaton(get(), window)
    return [cache[key] for key in wanted]


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, text: int, schema: StructType, finish) -> DataFrame:
    """Rows finish(row, data, words, spans, items) of docs, with the hit spans of words and the ids of the items; finish gives None to drop a row.

    text: the number of the column that is searched, a string or UTF-8; null is empty.
    """
    columns = docs.columns
    sent = shards_of(benchmark)
    rounds = [sent[k : k + ROUND] for k in range(0, len(sent), ROUND)] or [[]]
    between = StructType([*docs.schema.fields, StructField("_spans", SPANS), StructField("_items", ArrayType(StringType()))])
    now = docs.withColumns({"_spans": F.array().cast(SPANS), "_items": F.array().cast("array<string>")})
    for n, shards in enumerate(rounds, 1):

        def run(rows, shards=shards, last=n == len(rounds)):
            own = automata(shards, window)
            for row in rows:
                data = row[text] or b""
                data = data.encode() if isinstance(data, str) else data
                words, spans, items = words_of(data), [tuple(s) for s in row[-2]], set(row[-1])
                for a in own:
                    new, met = a.hits(words)
                    spans += new
                    items |= met
                spans = merged(spans)
                out = finish(row[:-2], data, words, spans, sorted(items)) if last else (*row[:-2], spans, sorted(items))
                if out is not None:
                    yield out

        now = arrow_map(now.select(*columns, "_spans", "_items"), run, schema if n == len(rounds) else between)
        now = now if n == len(rounds) else written(now, "round")
    return now


SPANS = ArrayType(ArrayType(IntegerType()))
MATCHES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("spans", ArrayType(ArrayType(IntegerType()))),
        StructField("text", StringType()),
    ]
)

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first to its last word."""
    if not spans:
        return text
    bounds, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join([*out, text[at:]])


def match_items(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, clean: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans ([first, end) word pairs), text (with clean: without the hit spans, else null).

    Null texts have no words, null or wordless items no window; equal items with different ids are all
    reported; a null item id is reported as empty string. Repeated documents give a row each; an empty
    benchmark hits nothing; other columns are not read.
    """

    def finish(row, data, words, spans, items):
        return row[0], len(words), sum(b - a for a, b in spans), items, spans, without(data, spans).decode("utf-8", "replace") if clean else None

    return scanned(ids_and_text(docs, id_col, text_col), benchmark, window, 1, MATCHES, finish)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs (columns of documents) without benchmark spans; documents of which windows cover max_coverage or more of the words go.

    Null texts, texts without words and rows without a hit stay as they are; repeated rows are treated alike; an empty
    benchmark changes nothing; an empty table gives no rows; n_chars, where it is there, follows the text.
    """
    columns = docs.columns
    at = columns.index("text")
    length = columns.index("n_chars") if "n_chars" in columns else None

    def finish(row, data, words, spans, items):
        if not spans:
            return row
        if sum(b - a for a, b in spans) >= max_coverage * len(words):
            return None
        new = list(row)
        new[at] = without(data, spans).decode()
        if length is not None:
            new[length] = len(new[at])
        return tuple(new)

    return scanned(docs, benchmark, window, at, docs.schema, finish)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from match_items()."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
