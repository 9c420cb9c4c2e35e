"""Line de-duplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line (smaller doc_id, or same document and smaller line number) is within the allowed edits
of it: none where the shorter of the two has under ``one_edit`` characters, one under ``two_edits``, two from there. Equal lines are one
class, known by two hashes and a length and pre-aggregated to its first place; only first places go on. Between them,
pairs come from a segment join: a line is split into one segment more than the edits allowed, so two near lines
share one of them whole; longer or equal lines probe the segments of shorter or equal ones with the substrings that the
multi-match-aware rule allows for each length and segment.

Keys are counted before anything is expanded: only a key that two different places have, one of them as owner of a segment,
goes on. A line needs one witness only, so it is first compared with the earliest line of each of its keys. Lines that these do not
settle get finer keys, a half of another segment besides the shared one (three halves for two edits, so one of them is whole
as well), which split what a frequent phrase has brought together; then come their earliest lines, and at last those
earlier lines of the finer keys whose counts of some letters are near enough for the edits allowed, which loses no near line.

Candidates lose their common beginning and end, and what is left is verified by the banded bit-parallel
edit distance (Hyyrö, 2003), five diagonals in one integer, one step per character.

Texts are written once, bucketed by doc_id, so that the steps that go back to them do not shuffle them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

MOST = 2  # edits at most
PLACE = ["doc_id", "line_no"]


def _probes(tau: int) -> list[tuple[int, int, int, int]]:
    """(tau, less, i, shift): where a line may hold segment i of a line ``less`` characters shorter."""
    return [(tau, less, i, shift) for less in range(tau + 1) for i in range(tau + 1) for shift in range(max(-i, less - tau + i), min(i, less + tau - i) + 1)]


PROBES = _probes(1) + _probes(MOST)  # a line's own segments are those with less = shift = 0


def _segment(length: Column, tau: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and size of the i-th of tau + 1 even segments of a line; the last ones are one longer."""
    n = tau + 1
    small, over = (length / n).cast("int"), length % n
    return small * i + F.greatest(F.lit(0), over - (n - i)) + 1, small + (n - i <= over).cast("int")


def _piece(wide: Column, start: Column, size: Column) -> Column:
    """Characters of a line in UTF-32, where they stand at fixed places."""
    return F.substring(wide, (4 * (start - 1) + 1).cast("int"), (4 * size).cast("int"))


def _lines(texts: DataFrame, *others: str) -> DataFrame:
    return texts.select("doc_id", *others, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def _wide(lines: DataFrame, *others: str) -> DataFrame:
    return lines.select(*PLACE, *others, F.encode("line", "UTF-32").alias("wide"), F.char_length("line").alias("len"))


def _keys(wide: DataFrame, edits) -> DataFrame:
    """key, doc_id, line_no, probe (number in PROBES) of all segments and probes of the lines."""
    specs = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((*p, k), ("tau", "less", "i", "shift", "probe"), strict=True)]) for k, p in enumerate(PROBES)])
    long = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((*p, k), ("tau", "less", "i", "shift", "probe"), strict=True)]) for k, p in enumerate(PROBES) if p[0] == MOST])
    rows = wide.select(*PLACE, "wide", "len", F.inline(F.when(edits(F.col("len") - MOST) == MOST, long).otherwise(specs)))
    other = F.col("len") - F.col("less")
    start, size = _segment(other, F.col("tau"), F.col("i"))
    at = start + F.col("shift")
    rows = rows.where((edits(other) == F.col("tau")) & (at >= 1) & (at + size - 1 <= F.col("len")))
    return rows.select(F.xxhash64(_piece(F.col("wide"), at, size), other, F.col("i"), F.col("tau")).alias("key"), *PLACE, "probe")


def _finer_keys(rows: DataFrame) -> DataFrame:
    """The same with a half of another segment in the key; ``rows`` has key, place, probe, wide and len."""
    of = lambda n: F.element_at(F.array(*[F.lit(p[n]) for p in PROBES]), F.col("probe") + 1)
    rows = rows.withColumns({"tau": of(0), "less": of(1), "i": of(2), "own": _owns()})
    rows = rows.select("key", *PLACE, "wide", "len", "tau", "less", "i", "own", F.inline(F.array(*[F.struct(F.lit(h).alias("half"), F.lit(d).alias("shift")) for h in range(3) for d in range(-MOST, MOST + 1)])))
    pick = (F.col("half") / 2).cast("int")
    j = pick + (pick >= F.col("i")).cast("int")
    start, size = _segment(F.col("len") - F.col("less"), F.col("tau"), j)
    first = (size / 2).cast("int")
    late = F.col("half") % 2 == 1
    at = start + F.when(late, first).otherwise(0) + F.col("shift")
    size = F.when(late, size - first).otherwise(first)
    rows = rows.where((j <= F.col("tau")) & (at >= 1) & (at + size - 1 <= F.col("len")))
    return rows.select(F.xxhash64(_piece(F.col("wide"), at, size), "key", "half").alias("key"), *PLACE, (F.col("own") & (F.col("shift") == 0)).alias("own"))


def _owns() -> Column:
    return F.col("probe").isin([k for k, p in enumerate(PROBES) if p[1] == p[3] == 0])


def _shared(rows: DataFrame, own: Column, name: str) -> DataFrame:
    """Rows of keys that two different places have, one of them as owner; rows are dealt by key once, and counted and chosen there."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    counted = dealt.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("line_no").alias("c"), F.max("line_no").alias("d"), F.max(own.cast("int")).alias("o"))
    live = counted.where("o = 1 and (a < b or c < d)").select("key").hint("shuffle_hash")
    # An inner join with distinct keys: a semi-join would be moved below the shuffle, which then runs twice.
    return common.staged(dealt.join(live, "key").withColumn("own", own), name)


def _earliest(shared: DataFrame) -> DataFrame:
    """Pairs (t, u) of a place and the earliest place that may be near it in one of its keys, where that is earlier."""
    place = F.struct(*PLACE)
    first = shared.groupBy("key").agg(F.min(place).alias("any"), F.min(F.when(F.col("own"), place)).alias("owner"))
    found = shared.join(first, "key").select(place.alias("t"), F.when(F.col("own"), F.col("any")).otherwise(F.col("owner")).alias("u"))
    return found.where("u < t").distinct()


def _with_lines(places: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, line_no, line of distinct ``places``; texts are bucketed, so only the places move."""
    wanted = places.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    return _lines(texts.join(wanted, "doc_id"), "wanted").where(F.array_contains("wanted", F.col("line_no"))).select(*PLACE, "line").distinct()


LETTERS = "aehilnorstud"  # any letters do: one edit changes the counts of at most two of them by one


def _bag(line: str) -> Column:
    return F.struct(*[(F.char_length(line) - F.char_length(F.translate(line, c, ""))).alias(c) for c in LETTERS])


_STEPS = [1 << s for s in range(20, -1, -1)]


def _shared_ends(a: Column, b: Column, la: Column, lb: Column) -> tuple[Column, Column]:
    """Lengths of the common beginning and, behind it, of the common end of two lines in UTF-32 (each up to 2**21 - 1)."""
    steps = F.array(*[F.lit(s) for s in _STEPS])
    least = F.least(la, lb)
    head = F.aggregate(steps, F.lit(0), lambda x, s: F.when((x + s <= least) & (_piece(a, x + 1, s) == _piece(b, x + 1, s)), x + s).otherwise(x))
    tail = lambda h: F.aggregate(steps, F.lit(0), lambda x, s: F.when((x + s <= least - h) & (_piece(a, la - x - s + 1, s) == _piece(b, lb - x - s + 1, s)), x + s).otherwise(x))
    return head, tail


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: as a generated row they are not merged into the functions that use them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def edit_distance(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``distance`` of the string columns ``x`` and ``y``: the edit distance where it is at most MOST, else something above MOST."""
    size = F.struct(F.char_length(x).alias("n"), F.encode(x, "UTF-32").alias("w")), F.struct(F.char_length(y).alias("n"), F.encode(y, "UTF-32").alias("w"))
    ranked = _once(pairs, _p=F.least(*size), _t=F.greatest(*size))
    head, tail = _shared_ends(F.col("_p.w"), F.col("_t.w"), F.col("_p.n"), F.col("_t.n"))
    ranked = _once(ranked, _h=head)
    ranked = _once(ranked, _e=tail(F.col("_h")))
    ranked = _once(ranked, _m=F.col("_p.n") - F.col("_h") - F.col("_e"), _n=F.col("_t.n") - F.col("_h") - F.col("_e"))
    chars = lambda side, count: F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: _piece(F.col(f"{side}.w"), F.col("_h") + i, F.lit(1)))
    ranked = _once(ranked, _a=chars("_p", F.col("_m")), _b=chars("_t", F.col("_n")))
    full = (1 << (2 * MOST + 1)) - 1

    def match(char: Column, j: Column) -> Column:
        """Bits of the rows j - MOST .. j + MOST (the first is the lowest bit) of the shorter line that hold the j-th character (from 0) of the longer one."""
        bits = [F.when((j + b < F.col("_m")) & F.get(F.col("_a"), j + b).eqNullSafe(char), 1 << (b + MOST)).otherwise(0) for b in range(-MOST, MOST + 1)]
        return sum(bits[1:], bits[0])

    def step(s: Column, pm: Column) -> Column:
        vp, vn, j = s["vp"], s["vn"], s["j"]
        d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full)
        hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        row = F.least(F.col("_m") - j + MOST, F.lit(2 * MOST + 1))  # of the last row in this column
        bit = lambda v, at: F.getbit(v, at)
        more = F.when(j + MOST <= F.col("_m"), 1 - bit(d0, F.lit(2 * MOST))).when(row < 0, F.lit(1)).otherwise(bit(hp, row) - bit(hn, row))
        return F.when(s["dist"] > 3 * MOST, s).otherwise(
            F.struct(
                hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["dist"] + more.cast("int")).alias("dist"),
                (j + 1).alias("j"),
            )
        )

    ranked = _once(ranked, _s=F.transform(F.col("_b"), match))
    start = F.struct(F.lit(((1 << (MOST + 1)) - 1) << MOST).alias("vp"), F.lit(0).alias("vn"), F.least(F.col("_m"), F.lit(MOST)).cast("int").alias("dist"), F.lit(1).alias("j"))
    found = F.aggregate("_s", start, step, lambda s: s["dist"])
    distance = F.when(F.col("_n") - F.col("_m") > MOST, MOST + 1).when(F.col("_n") == 0, 0).otherwise(found)
    return ranked.withColumn("distance", distance).drop("_p", "_t", "_h", "_e", "_m", "_n", "_a", "_b", "_s")


def _close(pairs: DataFrame, texts: DataFrame, edits, name: str) -> DataFrame:
    """Places t of the pairs (t, u) whose lines are near."""
    pairs = common.staged(pairs, f"{name}-pairs")
    found = _with_lines(pairs.select("t.*").union(pairs.select("u.*")).distinct(), texts)
    left = found.select(F.struct(*PLACE).alias("t"), F.col("line").alias("line_t"))
    right = found.select(F.struct(*PLACE).alias("u"), F.col("line").alias("line_u"))
    both = edit_distance(pairs.join(left, "t").join(right, "u"), "line_t", "line_u")
    near = both.where(F.col("distance") <= edits(F.least(F.char_length("line_t"), F.char_length("line_u"))))
    return common.staged(near.select("t").distinct(), name)


def dedup_lines(docs: DataFrame, one_edit: int = 15, two_edits: int = 40, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_text (remaining lines joined by line feeds); with ``carry`` also ``row``, a
    struct of all columns of the row it comes from.

    Lines are cut at line feeds; blank lines are never removed. A null or empty text has one blank line; very long texts and lines are
    handled whole. Ties do not arise, as places are ordered; rows that repeat a doc_id are one document for places, so the same line number in two
    of them is one place, and each row is cut alike. Rows without doc_id are left out; an empty table gives an empty
    result; other columns are ignored.
    """
    edits = lambda n: F.when(n < one_edit, 0).when(n < two_edits, 1).otherwise(MOST)
    own = common.id_text(docs.withColumn("row", F.struct(*[docs[f"`{c}`"] for c in docs.columns])), "row") if carry else common.id_text(docs)
    texts = common.bucketed(own, "doc_id", "lines")
    keyed = _lines(texts).select(*PLACE, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.char_length("line").alias("len"))
    classes = keyed.groupBy("h", "g", "len").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = keyed.join(classes, ["h", "g", "len"]).where(F.struct(*PLACE) != F.col("first"))
    repeats = common.staged(repeats.groupBy("doc_id").agg(F.collect_set("line_no").alias("again")), "line-repeats")

    once = _lines(texts.join(repeats, "doc_id", "left"), "again").where((F.char_length("line") >= one_edit) & ~F.coalesce(F.array_contains("again", F.col("line_no")), F.lit(False)))
    shared = _shared(_keys(_wide(once), edits), _owns(), "line-keys")
    first = common.staged(_earliest(shared), "line-first")
    settled = _close(first, texts, edits, "line-settled")

    places = lambda near: near.select("t.*")
    held = common.staged(shared.join(places(settled), PLACE, "left_anti").select("key").distinct(), "line-open-keys")
    several = shared.join(held, "key", "left_semi").select("key", *PLACE, "probe")
    lines = common.staged(_with_lines(several.select(*PLACE).distinct(), texts), "line-open")
    finer = _shared(_finer_keys(several.join(_wide(lines), PLACE)), F.col("own"), "line-finer-keys")
    second = _earliest(finer).join(first, ["t", "u"], "left_anti").where(F.col("t").isNotNull())
    second = common.staged(second.join(settled, "t", "left_anti"), "line-second")
    settled = settled.union(_close(second, texts, edits, "line-finer"))

    place = F.struct(*PLACE)
    finer = finer.join(lines.select(*PLACE, _bag("line").alias("bag")), PLACE)
    waiting = finer.join(places(settled), PLACE, "left_anti").select("key", F.col("own").alias("own_t"), place.alias("t"), F.col("bag").alias("bag_t"))
    earlier = finer.select(F.col("key").alias("key_u"), F.col("own").alias("own_u"), place.alias("u"), F.col("bag").alias("bag_u"))
    apart = sum(F.abs(F.col(f"bag_t.{c}") - F.col(f"bag_u.{c}")) for c in LETTERS)
    rest = waiting.join(earlier, (F.col("key") == F.col("key_u")) & (F.col("u") < F.col("t")) & (F.col("own_t") | F.col("own_u")) & (apart <= 2 * MOST)).select("t", "u").distinct()
    settled = settled.union(_close(rest.join(first.union(second), ["t", "u"], "left_anti"), texts, edits, "line-rest"))

    gone = repeats.select("doc_id", F.explode("again").alias("line_no")).union(places(settled))
    gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    every = F.split("text", "\n")
    none = F.array().cast("array<int>")
    carried = ["row"] if carry else []
    joined = texts.join(gone, "doc_id", "left").select("doc_id", *carried, every.alias("every"), F.coalesce("gone", none).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("every")).otherwise(F.filter("every", lambda _, i: ~F.array_contains("gone", i)))
    return joined.select("doc_id", F.size("every").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"), *carried)
