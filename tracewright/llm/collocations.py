"""Phrases of a corpus by language: an FM-index per shard over word ids, extended in both directions, summed across shards.

A shard holds some megabytes of one language's texts as word ids, pieces of text parted by a break. Its index is the pair of
Burrows-Wheeler transforms of these ids read forwards and backwards, of suffixes ordered by their first words only, as deep as
phrases are long: enough for counts of phrases of bounded length. A node is a phrase of the shard with its interval in both
orders. The symbols in one transform's interval are the phrase's extensions on one side with their counts; they give the
intervals of the longer phrases in both orders. Phrases grow in turn to the left and to the right, one word a level.

A level's local counts are summed over all shards; phrases below the least count go, and only nodes whose phrase is left grow
on, and only into phrases both of whose shorter parts are left. So a level's work follows the phrases that can still count.
A phrase is named by the ids of its two parts (all but its last word, all but its first): a pair of numbers at every
length, exact without comparing words again. Local counts travel in packets: a shard's phrases of one part of the hash
space, byte plane by byte plane, so that they take some four bytes each, and each part is summed by itself.

Nothing that grows with the corpus is broadcast or collected: words and phrases meet their shards by joins unless a level has few, and the
indexes lie in buckets by shard and are never shuffled. Nodes of two words are not kept; an index gives them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import runs_of

SHARD_BYTES = 4 << 20  # text of one language under one index; a longer document is indexed alone
HELD_BYTES = 12 << 20  # text of all languages that a task holds back
MOST_SENT = 300_000  # frequent words, or phrases of a level, that go to every task (some 10 MB); more of them meet their shards by a shuffle
PARTS = 1024  # of the hash space of phrases, for each WORDS_A_ROUND words of the corpus
WORDS_A_ROUND = 10**10
SALTS = 16  # parts in which a language's phrases are ranked before the parts' best are ranked together
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_APART = _BREAK | _BLANK


def word_ids(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the texts as their places plus 1 with a 0 before, between and after pieces."""
    _, _, buf, offs = next(K.text_slices(texts, 1 << 62))
    low = K.LOWER[buf]
    starts, ends, rows = K.cut_words(low, offs, _APART)
    if len(starts) == 0:
        return pa.array([], pa.string()), np.zeros(1, np.int32)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[low])])
    apart = np.ones(len(starts), bool)
    apart[1:] = (breaks[starts[1:]] != breaks[ends[:-1]]) | (rows[1:] != rows[:-1])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.ascontiguousarray(low[~_APART[low]])
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    at = np.arange(len(starts)) + np.cumsum(apart)
    out = np.zeros(int(at[-1]) + 2, np.int32)
    out[at] = coded.indices.to_numpy() + 1
    return coded.dictionary, out


SHARDS = "shard long, lang string, n long, words array<string>, counts array<long>, ids binary"


def shard_rows(batches, limit: int, most: int) -> Iterator[pa.RecordBatch]:
    """One row per shard of (lang, text) rows, of ``limit`` bytes of text: its words, their counts and its word ids. A task holds
    ``most`` bytes back until it writes the largest of its languages."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    part, made = TaskContext.get().partitionId(), 0

    def cut(lang: str) -> pa.RecordBatch:
        nonlocal made
        words, ids = word_ids(pa.concat_arrays(held.pop(lang)))
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        made, size[lang] = made + 1, 0
        row = [part << 32 | made, lang, int(counts.sum()), words, counts, ids.tobytes()]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

    for batch in batches:
        langs = pc.dictionary_encode(batch.column(0))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, i)).cast(pa.large_binary())
            offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            a = 0
            while a < len(texts):
                room = max(limit - size.get(lang, 0), 0)
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + room, "right")) - 1)
                held.setdefault(lang, []).append(texts.slice(a, b - a))
                size[lang] = size.get(lang, 0) + int(offs[b] - offs[a])
                if size[lang] >= limit or b < len(texts):
                    yield cut(lang)
                a = b
        while sum(size.values()) > most:
            yield cut(max(size, key=size.get))
    for lang in sorted(held):
        yield cut(lang)


def depth_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the (cyclic) ``ids`` in the order of the first ``depth`` or more symbols from there."""
    rank, known = ids.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -known)
        known *= 2
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        fresh = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
        rank = np.empty(len(key), np.int64)
        rank[order] = fresh


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """Symbols before the suffixes in their order."""
    return np.roll(ids, 1)[depth_order(ids, depth)]


def walk(symbols: np.ndarray) -> np.ndarray:
    """Where each suffix's predecessor stands in the order, as far as symbols tell (last-to-first mapping)."""
    out = np.empty(len(symbols), np.int64)
    out[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    return out


NODE = ("near", "far", "count", "head", "tail")  # intervals' starts in the order that the next level reads and in the other


def children(symbols: np.ndarray, near: np.ndarray, far: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extensions of nodes by one symbol on the side of ``symbols``: parent, symbol, count, first row, start in the other order."""
    node = np.repeat(np.arange(len(near)), count)
    row = runs_of(near, count)
    found = symbols[row].astype(np.int64)
    base = int(symbols.max(initial=0)) + 1
    key = node * base + found
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    parent, symbol = key[first] // base, key[first] % base
    size = np.diff(np.append(first, len(key)))
    before = np.cumsum(count) - count
    keep = symbol > 0  # a break ends a phrase
    return parent[keep], symbol[keep], size[keep], row[first][keep], (far[parent] + first - before[parent])[keep]


def matches(key_a: np.ndarray, key_b: np.ndarray, want_a: np.ndarray, want_b: np.ndarray) -> np.ndarray:
    """For each wanted pair its place among the (distinct) pairs of keys, or -1."""
    if len(key_a) == 0:
        return np.full(len(want_a), -1)

    def ranks(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        names = np.unique(keys)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return np.searchsorted(names, keys), np.where(names[at] == wanted, at, -1), len(names)

    a, want_a, _ = ranks(key_a, want_a)
    b, want_b, base = ranks(key_b, want_b)
    pairs, wanted = a * base + b, np.where((want_a >= 0) & (want_b >= 0), want_a * base + want_b, -1)
    order = np.argsort(pairs, kind="stable")
    place = np.minimum(np.searchsorted(pairs[order], wanted), len(pairs) - 1)
    return np.where(pairs[order][place] == wanted, order[place], -1)


def transforms(ids: np.ndarray, places: np.ndarray, names: np.ndarray, n_words: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a shard's frequent words (at ``places``), and both transforms of its texts as places among these, other words being breaks."""
    local = np.zeros(n_words + 1, np.int32)
    local[np.sort(places) + 1] = np.arange(1, len(places) + 1)
    ids = local[ids]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)  # breaks side by side are one
    ids = ids[keep]
    return names[np.argsort(places, kind="stable")], transform(ids, depth), transform(ids[::-1], depth)


def pair_nodes(names: np.ndarray, forward: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's phrases of two words, words extended to the left; the next level reads the backward order."""
    size = np.bincount(forward, minlength=len(names) + 1)
    start = (np.cumsum(size) - size)[1:]
    parent, symbol, count, row, other = children(forward, start, start, size[1:])
    return {"near": other, "far": walk(forward)[row], "count": count, "head": symbol, "tail": parent + 1, "p": names[symbol - 1], "q": names[parent]}


def grown(symbols: np.ndarray, nodes: dict[str, np.ndarray], names: np.ndarray, left: bool, last: bool) -> dict[str, np.ndarray]:
    """Nodes one word longer, on the left or right, of ``nodes`` with the global ids ``names``; all of them and both parts of each are frequent."""
    parent, symbol, count, row, other = children(symbols, nodes["near"], nodes["far"], nodes["count"])
    side, edge, middle = ("q", "head", "p") if left else ("p", "tail", "q")
    mate = matches(nodes[side], nodes[edge], nodes[middle][parent], symbol)
    keep = mate >= 0
    parent, symbol, count, row, other, mate = (x[keep] for x in (parent, symbol, count, row, other, mate))
    own, new = names[parent], names[mate]
    return {
        "near": other,
        "far": other if last else walk(symbols)[row],
        "count": count,
        "head": symbol if left else nodes["head"][parent],
        "tail": nodes["tail"][parent] if left else symbol,
        "p": new if left else own,
        "q": own if left else new,
    }


INDEX = "shard long, names binary, forward binary, backward binary"
NODES = "shard long, " + ", ".join(f"{c} binary" for c in (*NODE, "p", "q"))
PACKETS = "part int, p binary, q binary, c binary"
PLACES = "shard long, place int, p long, q long"
SUMS = "p long, q long, a long"


def _names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _binary_row(shard: int, cells: list[tuple[np.ndarray, str]], ddl: str) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int64()), *[pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in cells]]
    return pa.RecordBatch.from_arrays(columns, names=_names_of(ddl))


def _rows(batches) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(c)[i] for c, n in enumerate(batch.schema.names)}


def _numbers(cell: pa.Scalar, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _listed(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _indexed(depth: int, known: pa.Table | None):
    """Indexes of shards, whose frequent words are those of their language in ``known`` (lang, word, id), or else at their ``places``."""

    def run(batches):
        of: dict[str, pa.Table] = {}
        for row in _rows(batches):
            if known is None:
                places, names = _listed(row["places"]), _listed(row["names_met"])
            else:
                lang = row["lang"].as_py()
                if lang not in of:
                    of[lang] = known.filter(pc.equal(known.column("lang"), lang)).combine_chunks()
                at = pc.index_in(row["words"].values, value_set=of[lang].column("word").combine_chunks())
                places = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                names = of[lang].column("id").to_numpy()[at.drop_null().to_numpy(zero_copy_only=False)]
            found = transforms(_numbers(row["ids"]), places, names, row["n_words"].as_py(), depth)
            yield _binary_row(row["shard"].as_py(), list(zip(found, ("<i8", "<i4", "<i4"), strict=True)), INDEX)

    return run


def _indexes(shards: DataFrame, local: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """The index of each shard. Few frequent words go to every task; many meet their shards by a shuffle of places."""
    if words.count() <= MOST_SENT:
        known = words.select("lang", "word", "id").toArrow()
        return shards.select("shard", "lang", "words", "ids", F.size("words").alias("n_words")).mapInArrow(_indexed(depth, known), INDEX)
    met = _met(local, words, ["lang", "word"]).hint("shuffle_hash")
    return shards.select("shard", "ids", F.size("words").alias("n_words")).join(met, "shard").mapInArrow(_indexed(depth, None), INDEX)


def _nodes_of(row: dict[str, pa.Scalar]) -> dict[str, np.ndarray]:
    """A shard's nodes of a level: as they were kept, or those of two words out of its index."""
    if "near" in row:
        return {c: _numbers(row[c]).astype(np.int64) for c in NODE} | {c: _numbers(row[c], "<i8") for c in ("p", "q")}
    return pair_nodes(_numbers(row["names"], "<i8"), _numbers(row["forward"]))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes: the upper ones are nearly constant and take no room once compressed."""
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def part_of(p: np.ndarray, q: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix(K.mix(p.astype(np.uint64)) ^ q.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _packets(parts: int):
    """A shard's local counts, one row for each part of the hash space that it has phrases of."""

    def run(batches):
        for row in _rows(batches):
            nodes = _nodes_of(row)
            part = part_of(nodes["p"], nodes["q"], parts)
            order = np.lexsort((nodes["p"], nodes["q"], part))
            part, p, q, c = (x[order] for x in (part, nodes["p"], nodes["q"], nodes["count"]))
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [pa.array(part[cuts[:-1]], pa.int32()), *[pa.array([planes(x[a:b]) for a, b in spans], pa.binary()) for x in (p, q, c)]]
            yield pa.RecordBatch.from_arrays(columns, names=_names_of(PACKETS))

    return run


def _summed(least: int):
    """Sums over all packets of a part, and only those that reach ``least``."""

    def run(table: pa.Table) -> pa.Table:
        p, q, c = (np.concatenate([from_planes(x.as_buffer()) for x in table.column(n)]) for n in ("p", "q", "c"))
        order = np.lexsort((p, q))
        p, q, c = p[order], q[order], c[order]
        head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        a = np.add.reduceat(c, head)
        keep = a >= least
        return pa.table([p[head][keep], q[head][keep], a[keep]], names=_names_of(SUMS))

    return run


def _place_rows(batches) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        nodes = _nodes_of(row)
        n = len(nodes["p"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(nodes["p"]), pa.array(nodes["q"])], names=_names_of(PLACES))


def _grown(left: bool, last: bool, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Nodes one word longer. The frequent ones among a shard's nodes are those in ``known`` (p, q and id of all), or else at its ``places``."""

    def run(batches):
        for row in _rows(batches):
            nodes = _nodes_of(row)
            if known is None:
                at, names = _listed(row["places"]), _listed(row["names_met"])
                order = np.argsort(at, kind="stable")
                at, names = at[order], names[order]
            else:
                p, q, ids = known
                found = matches(p, q, nodes["p"], nodes["q"])
                at = np.flatnonzero(found >= 0)
                names = ids[found[at]]
            nodes = {c: x[at] for c, x in nodes.items()}
            more = grown(_numbers(row["symbols"]), nodes, names, left, last)
            yield _binary_row(row["shard"].as_py(), [(more[c], "<i4") for c in NODE] + [(more[c], "<i8") for c in ("p", "q")], NODES)

    return run


def _named(counted: DataFrame, name: str) -> DataFrame:
    """Frequent ones with an id each, written so that ids stay."""
    return common.staged(counted.withColumn("id", F.monotonically_increasing_id()), name)


def _met(local: DataFrame, frequent: DataFrame, on: list[str]) -> DataFrame:
    """Per shard, the places of its frequent entries and their ids."""
    met = local.select("shard", "place", *on).join(frequent.select(*on, "id"), on)
    return met.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("met")).select("shard", F.col("met.place").alias("places"), F.col("met.id").alias("names_met"))


def _longer(index: DataFrame, level: DataFrame, counted: DataFrame, size: int, longest: int) -> DataFrame:
    """The next level's nodes of each shard. Few frequent phrases go to every task; many meet their shards by a shuffle of places."""
    left = size % 2 == 1
    rows = index.select("shard", F.col("forward" if left else "backward").alias("symbols"))
    if level is index:
        rows = index.select("shard", "names", "forward", F.col("backward").alias("symbols"))
    else:
        rows = rows.join(level, "shard")
    if counted.count() <= MOST_SENT:
        found = counted.select("p", "q", "id").toArrow()
        known = tuple(found.column(c).to_numpy() for c in ("p", "q", "id"))
        return rows.mapInArrow(_grown(left, size + 1 == longest, known), NODES)
    held = index.select("shard", "names", "forward") if level is index else level
    met = _met(held.mapInArrow(_place_rows, PLACES), counted, ["p", "q"]).hint("shuffle_hash")
    return rows.join(met, "shard").mapInArrow(_grown(left, size + 1 == longest, None), NODES)


def phrase_levels(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language in total (lang, n), and frequent phrases of 1, 2, ... ``longest`` words: id, lang, phrase, word
    (its last one), a (its count), p and q (ids of the phrase without its last and first word), heads and tails (counts of
    the first and second part of each cut). All are written tables."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    limit, most = SHARD_BYTES, HELD_BYTES
    shards = common.bucketed(texts.mapInArrow(lambda batches: shard_rows(batches, limit, most), SHARDS), "shard", "phrase_shards", dealt=True)
    total = common.staged(shards.groupBy("lang").agg(F.sum("n").alias("n")), "phrase_totals")
    parts = PARTS * (1 + (total.agg(F.sum("n")).first()[0] or 0) // WORDS_A_ROUND)
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "of")).select("shard", "lang", "place", F.col("of.words").alias("word"), F.col("of.counts").alias("c"))
    words = _named(local.groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least), "phrase_words")
    none = F.array().cast("array<long>")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), "word", "a", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), none.alias("heads"), none.alias("tails"))]
    with common.small_batches(docs.sparkSession):
        index = common.bucketed(_indexes(shards, local, words, max(longest - 1, 2)), "shard", "phrase_index", dealt=True)
        common.drop_bucketed(shards)
        level, tables = index, []
        for size in range(2, longest + 1):
            held = level.select("names", "forward") if level is index else level
            counted = _named(held.mapInArrow(_packets(parts), PACKETS).groupBy("part").applyInArrow(_summed(least), SUMS), "phrase_sums")
            first = levels[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("start"), F.col("heads").alias("before"), F.col("a").alias("p_a"))
            second = levels[-1].select(F.col("id").alias("q"), "word", F.col("tails").alias("after"), F.col("a").alias("q_a"))
            phrase, heads, tails = F.concat_ws(" ", "start", "word"), F.concat("before", F.array("p_a")), F.concat(F.array("q_a"), "after")
            told = counted.join(first, "p").join(second, "q").select("id", "lang", phrase.alias("phrase"), "word", "a", "p", "q", heads.alias("heads"), tails.alias("tails"))
            levels.append(common.staged(told, "phrase_level"))
            if size < longest:
                level = common.bucketed(_longer(index, level, counted, size, longest), "shard", "phrase_nodes", dealt=True)
                tables.append(level)
        common.drop_bucketed(index, *tables)
    return total, levels


def _score(n: Column, a: Column, heads: Column, tails: Column) -> tuple[Column, Column, Column]:
    """l, r and score of the lowest cut: exact whole numbers of 38 digits, the earliest cut of equal ones."""
    wide = lambda x: x.cast("decimal(19,0)")
    cuts = F.zip_with(heads, tails, lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    scored = F.transform(cuts, lambda c, i: F.struct(F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(c["l"]) * wide(c["r"])).cast("long").alias("score"), i.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = F.array_min(scored)
    return best["l"], best["r"], best["score"]


def _best(df: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score (whole numbers).

    Phrases have 2 to ``longest`` words and occur ``least`` times or more; one that a longer one holds in all its
    occurrences is left out. A null language is ``und``; null, empty and blank texts hold no words; every row counts, also one
    that repeats another or has no doc_id, and ties are broken by count, then by the phrase's bytes. Texts of any length are
    read whole; an empty table gives an empty result. Columns other than lang and text are not read.
    """
    total, levels = phrase_levels(docs, least, longest)
    found = []
    for i, level in enumerate(levels[1:], 1):  # ids are of their level, so each one is held against the next
        more = [t.select(F.explode(F.array("p", "q")).alias("id"), F.col("a").alias("most")) for t in levels[i + 1 : i + 2]]
        if more:
            most = more[0].groupBy("id").agg(F.max("most").alias("most"))
            level = level.join(most, "id", "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
        found.append(level.select("lang", "phrase", "a", "heads", "tails"))
    every = reduce(DataFrame.unionByName, found).join(total.hint("broadcast"), "lang")
    l, r, score = _score(F.col("n"), F.col("a"), F.col("heads"), F.col("tails"))
    scored = every.select("lang", "phrase", "a", l.alias("l"), r.alias("r"), "n", score.alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("part"))
    return _best(_best(scored, ["lang", "part"], top).drop("rank"), ["lang"], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
