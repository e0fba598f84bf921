"""Exact n-gram Jaccard join by signature trees, with its connected components.

A document's set holds its distinct n-word shingles (A-Z lower-cased; words are runs outside ``[\\x20\\x09-\\x0D]``); with fewer words the
whole sequence is its one shingle. Two documents link when den * |x & y| >= num * |x | y|.

1. Documents with equal sets are one class, represented by its row of the smallest doc_id (then of the smallest text hash); only representatives
   go on, under a number of their own, so that rows that share a doc_id but not a text stay apart.
2. All shingles have one global order, frequent ones last. Every task counts the shingles of all its documents and reports its HEAVY most
   frequent ones; the sums order the table's FREQUENT ones. Any order is exact. Sets that link share ``shared`` tokens (a few, by size) among the
   first |x| - ceil(|x| num / den) + shared of each. A representative's home is the token of the least hash of its whole set, which similar
   sets mostly have in common.
3. Rows of (token, document) without text show which documents share such tokens beyond one home; sizes and positions bound the overlap. One of
   two such documents visits the other's home, for each token the one of fewer at hand; of the tokens that a pair must share one of both goes for
   half at least, so that visits with fewer tokens, which are chance and grow with the square of the table, end here. Tokens of over RUN documents
   are dealt out in chunks of which every two meet; a visit for one of those needs no more.
4. In a home of over MAPS sets all are first compared with LEADS of them, in chunks to each of which those are added. What is connected to the first
   of them is one component already; only the others, the open ones, still have to meet all. In smaller homes all sets are open.
5. Bitmaps and sizes of members and visitors of a home tell which may link with a member at all, one of both being open; a home is dealt out in
   parts of which every two that may matter meet. Only those that may link get their texts; they are dealt out in chunks of bounded size, to each
   of which the home's first set is added. What that one is not connected to visits all chunks in a second round.
6. In each chunk a signature tree (OR-combined bitmaps, size ranges) is traversed against itself; node pairs go that cannot reach the least
   overlap, or whose members are connected already. Remaining pairs are compared exactly. Links are a spanning forest of the component.
7. Components over the links come from label propagation with pointer jumping on DataFrames, checkpointed every round. Links are contracted to stars
   before, by portions, wherever they lie; links of few portions take one round or two then.

Nothing is capped or dropped, and no unbounded group meets in one task: joins on homes, tokens and labels deal the rows of each key over
SALTS tasks, and classes of very many copies are joined by broadcast (BROAD of them at most).

Rows: null or empty texts, and texts without words, have an empty set, link with nothing and are their own component. Repeated rows give
a result each. Rows that share a doc_id but not a set are apart: each belongs to its own text's component. A row with a null doc_id gets the
component of an equal text that has one, else null, and links with nothing itself. Equal similarities need no order. An empty table gives
an empty result. Other columns are ignored, or carried along by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import SALTS, cut, grouped, portions, release, salted, stored
from gradelake.llm.signature_tree import Join
from gradelake.llm.textcore import column, mix, shingle_runs, shingle_sets
from gradelake.llm.url_filter import block_of, bloom, passes

#: Frequent shingles that a task reports, and tokens of the table that orders them; they bear on speed only.
HEAVY, FREQUENT = 1 << 13, 1 << 17
#: Shingles that a task counts at a time.
COUNTED = 1 << 20
#: Sets that link share a token of their prefixes for every so many shingles, and at most so many are asked for.
EACH, SHARED = 32, 8
#: Rows of a token that are compared in one task.
RUN = 8_192
#: Shingles in a chunk of a home, about, when texts are compared, and sets in a chunk when bitmaps are.
CHUNK, MAPS = 1_000_000, 512
#: Sets of a large home with which all are compared first.
LEADS = 16
#: Keys that are broadcast because they have very many rows; a key needs HOT rows for it, and more in large tables.
BROAD, HOT = 100_000, 256


def _rows(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))


def top_counts(token: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by token, of the ``most`` frequent tokens."""
    token, place = np.unique(token, return_inverse=True)
    count = np.bincount(place, count, len(token)).astype(np.int64)
    if len(token) > most:
        best = np.argpartition(count, len(count) - most)[len(count) - most :]
        token, count = token[best], count[best]
    return token, count


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of the shingles that are frequent over all documents, rarest first; FREQUENT of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            own, times = np.unique(np.concatenate(fresh), return_counts=True)
            fresh.clear()
            return top_counts(np.r_[token, own], np.r_[count, times], 4 * HEAVY)

        for batch in batches:
            for _, hashes, _ in shingle_runs(column(batch, "text"), n):
                fresh.append(hashes)
                if sum(map(len, fresh)) >= COUNTED:
                    token, count = fold()
        if fresh:
            token, count = fold()
        token, count = top_counts(token[count > 1], count[count > 1], HEAVY)
        yield _rows({"token": token.view(np.int64), "c": count})
        release()

    counts = cut(docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.least(F.sum("c"), F.lit(1 << 20)).alias("c")))
    least, room = None, FREQUENT
    for c, tokens in sorted(((x.c, x.n) for x in counts.groupBy(F.least("c", F.lit(1000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if tokens > room:
            break
        least, room = c, room - tokens
    if least is None:
        return np.zeros(0, np.uint64)
    top = counts.where(F.col("c") >= least).toArrow()
    token, often = top["token"].to_numpy(), top["c"].to_numpy()
    return token[np.lexsort((token, often))].view(np.uint64)


def shared(n):
    """How many tokens of its prefix a set of n shingles shares with one that it links with, if that one asks for as many."""
    return np.clip(n // EACH, 1, SHARED)


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits of a set's tokens, in a map of at least as many bits as tokens (a power of two)."""
    size = 64
    while size < len(tokens):
        size *= 2
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), n (size of the set), d1 and d2 (digest of the set), prefix (its first tokens), bits (its bitmap), home (its least token)."""
    place = np.argsort(frequent).astype(np.int32)
    known = frequent[place]
    told = docs.sparkSession.sparkContext.broadcast((known, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = told.value
        for batch in batches:
            ids, th = column(batch, "doc_id").cast(pa.int64()), column(batch, "th")
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
            size, d1, d2, prefix, bits, home = [], [], [], [], [], []
            for s, own, known_id in zip(shingle_sets(column(batch, "text"), n), plain, ids.is_valid().to_pylist(), strict=True):
                size.append(len(s))
                bits.append(bitmap(s))
                home.append(int(s[:1].view(np.int64)[0]) if len(s) else 0)
                if not len(s):
                    d1.append(own)
                    d2.append(0 if known_id else 1)
                    prefix.append(s.view(np.int64))
                    continue
                d1.append(int(mix(s ^ np.uint64(0x243F6A8885A308D3)).sum().view(np.int64)))
                d2.append(int(mix(s ^ np.uint64(0x13198A2E03707344)).sum().view(np.int64)))
                want = len(s) - -(-num * len(s) // den) + int(shared(len(s)))
                order = s
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    if often.any():
                        order = s[~often]
                        if len(order) < want:
                            order = np.r_[order, s[often][np.argsort(place[at[often]], kind="stable")]]
                prefix.append(order[:want].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)
            values = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, th, pa.array(size, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(bits, pa.binary()), pa.array(home, pa.int64())], ["doc_id", "th", "n", "d1", "d2", "prefix", "bits", "home"])
        release()

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n int, d1 long, d2 long, prefix array<long>, bits binary, home long")


class Visits:
    """From rows sorted by token: which document would visit which other home for it, and for how many tokens it has to. Rows of tokens with over ``most``
    of them are passed on."""

    def __init__(self, num: int, den: int, most: int) -> None:
        self.num, self.den, self.most = num, den, most

    def may_link(self, n1, p1, n2, p2) -> np.ndarray:
        """Whether two sets can link if one of their first common tokens, as many as they have to share, stands at these positions."""
        least = -(-self.num * (n1 + n2) // (self.num + self.den))
        return np.minimum(n1 - p1, n2 - p2) + shared(np.maximum(n1, n2)) - 1 >= least

    def needed(self, n: np.ndarray) -> np.ndarray:
        """For how many tokens a set of n visits at least, or is visited by the other, which has num / den of its shingles at least."""
        return (shared(-(-self.num * n // self.den)) + 1) // 2

    def run(self, token, rep, home, n, pos) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, home and size of the document, of complete runs of equal tokens; each once a token."""
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        out = []
        a = start[size == 2]
        b = a + 1
        go = (home[a] != home[b]) & self.may_link(n[a], pos[a], n[b], pos[b])
        a, b = a[go], b[go]
        lower = home[a] < home[b]
        out.append((np.where(lower, rep[a], rep[b]), np.where(lower, home[b], home[a]), np.where(lower, n[a], n[b])))
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = home[s : s + m]
            homes, which, count = np.unique(own, return_inverse=True, return_counts=True)
            if len(homes) == 1:
                continue
            order = np.argsort(n[s : s + m], kind="stable")
            which, r, k, p = which[order], rep[s : s + m][order], n[s : s + m][order], pos[s : s + m][order]
            weight, pairs = count[which], []
            for i in range(0, m, 64):
                j = min(m, i + 64)
                far = int(np.searchsorted(k, k[j - 1] * self.den // self.num, side="right"))
                x, y = np.nonzero((which[i:j, None] != which[None, i:far]) & self.may_link(k[i:j, None], p[i:j, None], k[None, i:far], p[None, i:far]))
                ahead = y > x
                x, y = x[ahead] + i, y[ahead] + i
                x_goes = (weight[x] < weight[y]) | (weight[x] == weight[y]) & (which[x] < which[y])
                pairs.append(np.unique(np.where(x_goes, x, y) * len(homes) + np.where(x_goes, which[y], which[x])))
            goes, to = np.divmod(np.unique(np.concatenate(pairs)), len(homes))
            out.append((r[goes], homes[to], k[goes]))
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "rep", "home", "at")
        empty: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in names)
        held, passed = empty, None  # the last token's rows, or that token if its rows are passed on

        def emit(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            token, rep, home, at = cols
            if not len(token):
                return
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[start, len(token)])
            far = np.repeat((size > self.most) | (token[start] == passed if passed is not None else False), size)
            if far.any():
                yield _rows({"home": home[far], "rep": rep[far], "token": token[far], "at": at[far]})
                token, rep, home, at = token[~far], rep[~far], home[~far], at[~far]
            if len(token):
                rep, home, n = map(np.concatenate, zip(*self.run(token, rep, home, at >> 32, at & 0xFFFFFFFF), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(self.needed(n))], ["home", "rep", "token", "at"])

        for batch in batches:
            new = [column(batch, c).to_numpy(zero_copy_only=False) for c in names]
            cols = tuple(np.r_[h, x] for h, x in zip(held, new, strict=True))
            if not len(cols[0]):
                continue
            last = cols[0][-1]
            end = int(np.searchsorted(cols[0], last))
            yield from emit(tuple(c[:end] for c in cols))
            held = tuple(c[end:] for c in cols)
            if last == passed or len(held[0]) > self.most:
                passed = last
                yield from emit(held)
                held = empty
        yield from emit(held)
        release()


def meetings(own: Column, k: Column) -> Column:
    """The chunks of a group of k parts that a row of one part is in; every two parts meet in one of them."""
    return F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.least(x, own) * k + F.greatest(x, own)))


def part_of(rep: str, k: Column) -> Column:
    return F.pmod(F.xxhash64(rep), k).cast("int")


def visits_of(reps: DataFrame, num: int, den: int) -> DataFrame:
    """home, rep: which document has to visit which other home. The rows of a token that has over RUN of them are dealt out in parts."""
    kind = "home long, rep long, token long, at long"
    tokens = reps.select(F.posexplode("prefix").alias("pos", "token"), "rep", "home", "n").select("token", "rep", "home", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))
    found = tokens.repartition("token").sortWithinPartitions("token").mapInArrow(Visits(num, den, RUN), kind).groupBy("home", "rep", "token", "at").agg(F.count(F.lit(1)).alias("c"))
    found = cut(found.where("token IS NOT NULL OR c >= at").drop("c"))
    far = found.where("token IS NOT NULL")
    out = found.where("token IS NULL").select("home", "rep")
    if far.isEmpty():
        return out
    parts = far.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / (RUN // 2)).cast("int").alias("k"))
    dealt = salted(far, parts, ["token"], "rep").withColumn("own", part_of("rep", F.col("k"))).select("token", "rep", "home", "at", meetings(F.col("own"), F.col("k")).alias("chunk"))
    dealt = dealt.select(F.xxhash64("token", "chunk").alias("token"), "rep", "home", "at")
    more = dealt.repartition("token").sortWithinPartitions("token").mapInArrow(Visits(num, den, 1 << 62), kind)
    return cut(out.union(more.select("home", "rep")).distinct())


def hopeful(n: np.ndarray, bits: list[bytes], member: np.ndarray, open_: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of a home may link, by sizes and bitmaps, with another one of it; one of both at least is a member, and one is open."""
    m = len(n)
    order = np.argsort(n, kind="stable")
    n, member, open_, maps = n[order], member[order], open_[order], [np.frombuffer(bits[i], np.uint64) for i in order]
    width = np.array([len(x) for x in maps])
    out = np.zeros(m, bool)
    for w in np.unique(width):  # sets of this width against those of it and, folded, of greater ones
        first = int(np.searchsorted(width, w))
        last = int(np.searchsorted(width, w, side="right"))
        end = int(np.searchsorted(n, n[last - 1] * den // num, side="right"))
        folded = np.stack([np.bitwise_or.reduce(x.reshape(-1, w)) for x in maps[first:end]])
        for i in range(first, last):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * den // num, side="right")))
            j = j[(member[j] | member[i]) & (open_[j] | open_[i]) & ~(out[j] & out[i])]
            if not len(j):
                continue
            own, other = folded[i - first], folded[j - first]
            most = np.minimum(n[i] - np.bitwise_count(own & ~other).sum(1).astype(np.int64), n[j] - np.bitwise_count(other & ~own).sum(1).astype(np.int64))
            j = j[most * (num + den) >= num * (n[i] + n[j])]
            if len(j):
                out[i] = True
                out[j] = True
    back = np.empty(m, bool)
    back[order] = out
    return back


def prune(stay: DataFrame, num: int, den: int) -> DataFrame:
    """home, chunk, rep, n, member, open, bits of stays in chunks of homes: the distinct (home, rep, n) that bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["home", "chunk"]):
            if table.num_rows < 2:
                continue
            n = table["n"].to_numpy().astype(np.int64)
            go = hopeful(n, table["bits"].to_pylist(), *(table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "open")), num, den)
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(table[c].to_numpy()[go]) for c in ("home", "rep", "n")], ["home", "rep", "n"])
        release()

    dealt = stay.repartition("home", "chunk").sortWithinPartitions("home", "chunk")
    return dealt.mapInArrow(run, "home long, rep long, n int").distinct()


def verify(work: DataFrame, docs: DataFrame, n: int, num: int, den: int, star: bool = False) -> DataFrame:
    """work: home, chunk, chunks, rep, doc_id and th (of the representative), resident (not to be compared with one another). Links (a, b, null), and (null,
    rep, home) for what stays loose from the home's first set in a home of several chunks, or (star) in every home."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("doc_id IS NOT NULL")
    wanted = work.select("doc_id", "th").distinct()
    if wanted.count() <= BROAD:  # only the texts that are wanted go through the shuffle
        texts = texts.join(F.broadcast(wanted), ["doc_id", "th"], "left_semi")
    rows = work.join(texts, ["doc_id", "th"]).select("home", "chunk", "chunks", "rep", "resident", "text").repartition("home", "chunk").sortWithinPartitions("home", "chunk", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["home", "chunk"]):
            reps = table["rep"].to_numpy()
            once = np.r_[True, reps[1:] != reps[:-1]]
            if not once.all():  # a repeated row
                table = table.filter(pa.array(once))
                reps = reps[once]
            if len(reps) < 2:
                continue
            sets = [s for chunk in table["text"].chunks for s in shingle_sets(chunk, n)]
            resident = table["resident"].to_numpy(zero_copy_only=False).astype(bool)
            join = Join(sets, num, den, resident)
            links = join.run()
            a, b = [int(reps[i]) for i, _ in links], [int(reps[j]) for _, j in links]
            home = [None] * len(links)
            if star or table["chunks"][0].as_py() > 1 and not resident.any():
                label = np.empty(len(reps), np.int64)
                label[join.order] = join.label
                loose = reps[label != label[np.argmin(resident)]].tolist()  # rows are sorted, so this is the home's first set in all chunks
                a, b, home = a + [None] * len(loose), b + loose, home + [table["home"][0].as_py()] * len(loose)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, home)], ["a", "b", "home"])
        release()

    return rows.mapInArrow(run, "a long, b long, home long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node of its component, and the node, of all other nodes of the links (a, b)."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for end in (label[x], label[y]):
            np.minimum.at(label, end, least)
        while (label[label] != label).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[label[own]], nodes[own]


def contracted(links: DataFrame) -> DataFrame:
    """Links that connect what ``links`` connects: stars around the least node, of portions of COUNTED links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in portions(batches, "a", 8 * COUNTED):
            a, b = forest(*(np.concatenate([column(x, c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b")))
            yield _rows({"a": a, "b": b})
        release()

    return links.where("a <> b").hint("rebalance", "a").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep, label (the smallest rep that it is connected to) for every end of a link. Rows of a node with very many links are dealt out."""
    links = cut(contracted(links.select("a", "b")))
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    hubs = cut(both.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HOT, both.count() // BROAD)).select("v", F.lit(SALTS - 1).alias("top")))
    top = F.coalesce("top", F.lit(0))
    both = cut(both.join(F.broadcast(hubs), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), top + 1).alias("salt")))
    label = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")))
    while True:
        told = label.select(F.col("u").alias("v"), "l").join(F.broadcast(hubs), "v", "left").select("v", "l", F.explode(F.sequence(F.lit(0).cast("bigint"), top.cast("bigint"))).alias("salt"))
        seen = both.join(told, ["v", "salt"]).groupBy("u").agg(F.min("l").alias("m"))
        lower = label.join(seen, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = salted(lower, label.select(F.col("u").alias("l"), F.col("l").alias("k")), ["l"], "u", "left")
        new = cut(jump.select("u", F.least("l", F.coalesce("k", "l")).alias("l"), "old"))
        if new.where("l <> old").isEmpty():
            return label.select(F.col("u").alias("rep"), F.col("l").alias("label"))
        label = new.select("u", "l")


def stars(crowd: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """crowd: home, rep, c (sets of the home). What ``verify`` finds in homes of over MAPS sets when all are compared with LEADS of them, one by a hash of the rep."""
    big = crowd.where(F.col("c") > MAPS).select("home", "rep", F.ceil(F.col("c") / MAPS).cast("int").alias("chunks"), part_of("rep", F.lit(LEADS)).alias("lead"))
    if big.isEmpty():
        return big.limit(0).select(F.lit(None).cast("long").alias("a"), F.col("rep").alias("b"), "home")
    first = big.groupBy("home", "lead").agg(F.min("rep").alias("rep"), F.first("chunks").alias("chunks"))
    lead = cut(first.select("home", "rep", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("resident")))
    others = big.join(first.select("home", "rep"), ["home", "rep"], "left_anti").select("home", "rep", "chunks", part_of("rep", F.col("chunks")).alias("chunk"), F.lit(True).alias("resident"))
    work = cut(lead.union(others).join(reps.select("rep", "doc_id", "th"), "rep"))
    return cut(verify(work, docs, n, num, den, star=True))


def parted(crowd: DataFrame, loose: DataFrame) -> DataFrame:
    """home, rep, member, open and chunk of every set that may still matter. The open sets and the others of a home are dealt out in parts; every part of
    open sets meets every part of the home in a chunk."""
    crowd = crowd.join(loose.withColumn("loose", F.lit(True)), ["home", "rep"], "left")
    crowd = crowd.select("home", "rep", "member", ((F.col("c") <= MAPS) | F.col("loose").isNotNull()).alias("open"))
    half = max(1, MAPS // 2)
    parts = [F.ceil(F.count_if(x) / half).cast("int").alias(k) for k, x in (("s", ~F.col("open")), ("o", F.col("open")))]
    dealt = salted(crowd, crowd.groupBy("home").agg(*parts).where("o > 0"), ["home"], "rep")
    k = F.col("s") + F.col("o")
    own = F.when(F.col("open"), F.col("s") + part_of("rep", F.greatest("o", F.lit(1)))).otherwise(part_of("rep", F.greatest("s", F.lit(1))))
    meet = F.transform(F.sequence(F.when(F.col("open"), 0).otherwise(F.col("s")), k - 1), lambda x: F.least(x, F.col("own")) * k + F.greatest(x, F.col("own")))
    return dealt.withColumn("own", own).select("home", "rep", "member", "open", F.explode(meet).alias("chunk"))


def similar_documents(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, th (hash of the text), n_shingles, rep, component_id and first (whether the row is its component's first) of every row; and
    links (a, b) between representatives that span every component."""
    sig = stored(signatures(docs, n, num, den, frequent_tokens(docs, n)).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th", "rid")))
    classes = sig.groupBy("n", "d1", "d2").agg(least.alias("r"), F.count(F.lit(1)).alias("c"))
    classes = cut(classes.select("n", "d1", "d2", "c", F.col("r.rid").alias("rep"), F.struct("r.doc_id", "r.th").alias("own")))
    reps = sig.where("n > 0").join(classes.where("rep IS NOT NULL").select(F.col("rep").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "rep")
    known = sig.withColumnRenamed("rid", "rep")  # for joins with what holds representatives only
    visits = visits_of(reps, num, den)
    members = reps.select("home", "rep", F.lit(True).alias("member")).union(visits.select("home", "rep", F.lit(False)))
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    crowd = cut(salted(members, sizes, ["home"], "rep"))
    star = stars(crowd, known, docs, n, num, den)
    crowd = parted(crowd, star.where("home IS NOT NULL").select("home", F.col("b").alias("rep")).distinct())
    stay = cut(prune(crowd.join(known.select("rep", "n", "bits"), "rep"), num, den))
    weight = stay.groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("rep").alias("least")).where("c > 1")
    weight = weight.select("home", F.ceil(F.col("w") / CHUNK).cast("int").alias("chunks"), "least")
    work = cut(salted(stay, weight, ["home"], "rep").select("home", "rep", "chunks", "least").join(known.select("rep", "doc_id", "th"), "rep"))
    chunk = part_of("rep", F.col("chunks"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cols = ["home", "chunk", "chunks", "rep", "doc_id", "th", "resident"]
    lead = work.where("rep = least AND chunks > 1").withColumn("chunk", everywhere)
    first = work.where("NOT (rep = least AND chunks > 1)").withColumn("chunk", chunk).unionByName(lead).withColumn("resident", F.lit(False))
    found = cut(verify(first.select(cols), docs, n, num, den))
    links = found.union(star).where("home IS NULL").select("a", "b")
    loose = found.where("home IS NOT NULL").select("home", F.col("b").alias("rep")).distinct()
    if not loose.isEmpty():
        open_ = loose.join(work, ["home", "rep"])
        guests = open_.withColumn("chunk", everywhere).where(F.col("chunk") != chunk).withColumn("resident", F.lit(False))
        hosts = salted(work, loose.select("home").distinct(), ["home"], "rep").withColumn("chunk", chunk).withColumn("resident", F.lit(True))
        links = links.union(cut(verify(guests.select(cols).union(hosts.select(cols)), docs, n, num, den)).select("a", "b"))
    linked = cut(components(links).join(classes.where("n > 0").select("rep", "own"), "rep"))
    heads = linked.groupBy("label").agg(F.min("own").alias("head"))
    heads = salted(linked.select("rep", "label"), heads, ["label"], "rep").select("rep", "head")
    joined = cut(classes.join(heads, "rep", "left").select("n", "d1", "d2", "c", "rep", F.coalesce("head", "own").alias("head")))
    rows = sig.select("doc_id", "th", "n", "d1", "d2")
    hot = joined.where(F.col("c") > max(HOT, (joined.agg(F.sum("c")).first()[0] or 0) // BROAD))
    keys = ["n", "d1", "d2"]
    many = rows.join(F.broadcast(hot), keys)
    few = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(joined, keys)
    own = (F.col("n") == 0) | (F.struct("doc_id", "th") == F.col("head"))
    out = [F.col("doc_id"), F.col("th"), F.col("n").cast("long").alias("n_shingles"), F.col("rep"), F.col("head.doc_id").alias("component_id"), own.alias("first")]
    return many.select(out).union(few.select(out)), links


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; rows without a doc_id stay. Of rows that share that doc_id and its text the one whose
    other columns come first, as JSON text, stays. Rows that go, and repeated ones, pass a Bloom filter; only what passes it is shuffled with its text."""
    members, _ = similar_documents(docs, n, num, den)
    own = ["__one_id", "__one_text"]
    pairs = members.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own[0]), F.col("th").alias(own[1])).agg(F.count_if("first").alias("rows"))
    odd = cut(pairs.where("rows <> 1").withColumn("key", F.xxhash64(*own)))
    filled, blocks = bloom(odd, "key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias(own[0]), F.xxhash64(docs["text"]).alias(own[1])).withColumn("key", F.xxhash64(*own))
    rows = rows.withColumn("block", block_of(F.col("key"), blocks)).join(F.broadcast(filled), "block", "left")
    odd_row = F.col(own[0]).isNotNull() & passes(F.col("key"))
    passed = rows.where(odd_row).select("row", *own)
    stay = rows.where(~odd_row).select("row").union(passed.join(odd, own, "left_anti").select("row"))
    again = odd.where("rows > 1")
    if not again.isEmpty():
        stay = stay.union(passed.join(again, own).groupBy(own).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return stay.select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 9, 10)
    return members.select("doc_id", "n_shingles", "component_id")


#: Links by a self-join on shingles, components by following links from every node; quadratic, for small tables.
OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, rid, [x FOR x IN string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), ' ') IF x <> ''] AS w FROM t
), s AS (
  SELECT doc_id, rid, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), c AS (SELECT s, min(rid) AS rep, count(*) AS copies FROM (SELECT rid, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
rows_ AS (SELECT t.doc_id, t.rid, c.rep FROM (SELECT doc_id, rid, list_sort(s) AS s FROM s WHERE len(s) > 0) t JOIN c USING (s)),
least AS (SELECT r.a AS rep, min(d.doc_id) AS component_id FROM reach r JOIN rows_ d ON d.rep = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN rows_ r ON r.rid = s.rid LEFT JOIN least l ON l.rep = r.rep
"""
