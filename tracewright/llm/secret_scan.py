"""Secrets in texts: three fixed patterns, and a lexer that reads assignments of source and configuration files.

The lexer turns a text into pairs of a target name and the literals that make up its value. It reads

* ``name = "literal"``, ``:=``, ``=>``, ``:``, ``+=``, with attribute paths, subscripts, quoted keys and type annotations;
* bare values of configuration lines (``NAME=value``, ``name: value``), ``--name value`` and ``<name>value</name>``;
* a quoted name followed by a comma and a literal (``setenv("NAME", "literal")``), a ``name``/``key`` entry followed by a
  ``value`` entry, and the user part of a URL;
* values joined with ``+`` or ``.`` or by standing side by side, ``${name}`` and ``{name}`` inside literals, and names of
  constants set elsewhere in the same text, which are followed to their literals.

A name is scored by its words (password, token, api key ...), a value by its length, kinds of characters and entropy; a pair
that reaches ``THRESHOLD`` marks each of its literals as a secret, wherever the literal stands. Bare prose after a colon
does not reach it. Every text is read whole in one pass; no step looks further back or ahead than one value.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

# Fixed by the contract of the base patterns.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")  # the last is the lexer's
LEAST_ASSIGNED = 8

THRESHOLD = 5
STRONG = frozenset("password passwd passphrase passcode pwd secret secrets credential credentials apikey secretkey privatekey accesskey authkey signingkey encryptionkey masterkey token bearer".split())
COMPOUND = ("key", "phrase", "code", "word")  # second words of names that are split in two
WEAK = frozenset("key auth authorization pass pw pin salt cert certificate signature session cookie login connection dsn".split())
ABOUT = frozenset("length len count num max min size name names file filename path dir url uri host field label type types kind policy prompt hint placeholder help text message error title description public limit limits budget expiry expires ttl timeout prefix suffix column table format regex pattern id ids".split())
PLACEHOLDER = re.compile(r"example|change.?me|your[-_ ]?|placeholder|dummy|redacted|insert|todo|none$|null$|undefined|true$|false$|[*x.\-_]{4,}|<[^<>]*>$|\$\{|\{\{|%\(|lorem|test(?:ing)?$", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

SITE = re.compile(
    r"""(?<![A-Za-z0-9_$.\-])(?P<dash>--)?+(?P<tag><)?+["']?+(?P<name>[A-Za-z_$@][A-Za-z0-9_$.\-]*+(?:\[["'][A-Za-z0-9_.\-]*+["']\])?+)(?P<quote>["'])?+"""
    r"""(?:[\x20\t]*+(?P<op>:=|=>|\+=|=(?![=>~])|:(?![:/=])|<-|,(?=[\x20\t]*+["']))|(?P<space>[\x20\t]++)|(?P<close>>))"""
)
TYPE = re.compile(r"[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\], |?<>]{0,60}=(?!=)[\x20\t]*+")
BLANK = re.compile(r"[\x20\t]*+(?:\\?\n[\x20\t]*+(?=[\"'+]))?+")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
CHAIN = re.compile(r"([$]?[A-Za-z_][A-Za-z0-9_.$]*+)[\x20\t]*+=(?![=>~])")
REFERENCE = re.compile(r"[$]?[A-Za-z_][A-Za-z0-9_.$]*+$")
INSERTED = re.compile(r"[$#]?\{([A-Za-z_][A-Za-z0-9_.]*)\}")
URL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.]{1,20}://([^\s/:@\"'<>]{1,200}):([^\s/@\"'<>]{1,400})@")
ESCAPED = {q: re.compile(rf"[^\\{q}\n]*+(?:\\.[^\\{q}\n]*+)*+{q}") for q in "\"'`"}


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Matches of the fixed patterns; a match of ``assign`` with too short a value uses up its text but does not count."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def name_points(name: str) -> int:
    """How sensitive a target's name sounds: the strongest of its words and pairs of words, less where it speaks about one."""
    found = [w.lower() for w in NAME_WORD.findall(name)]
    if not found:
        return 0
    pairs = [a + b for a, b in pairwise(found) if b in COMPOUND]
    best = 3 if STRONG & {*found, *pairs} else 1 if WEAK & {*found} else 0
    return best - 3 * bool(best and ABOUT & {*found})


class Shape:
    """What is known of a value: how often each character occurs, and whether a part of it is a placeholder. Shapes of parts add up."""

    __slots__ = ("chars", "placeholder")

    def __init__(self, text: str = ""):
        self.chars, self.placeholder = Counter(text), bool(text and PLACEHOLDER.search(text))

    def add(self, other: Shape) -> None:
        self.chars.update(other.chars)
        self.placeholder |= other.placeholder

    def points(self) -> int:
        """How much the value looks like a secret."""
        n = self.chars.total()
        if n < 6 or self.placeholder:
            return -9
        lower, upper, digit = (any(map(test, self.chars)) for test in (str.islower, str.isupper, str.isdigit))
        kinds = lower + upper + digit + (not all(map(str.isalnum, self.chars)))
        entropy = -sum(c / n * math.log2(c / n) for c in self.chars.values())
        points = (n >= 8) + (n >= 20) + (kinds >= 2 and digit) + (entropy >= 3.0)
        return points - 2 * any(map(str.isspace, self.chars)) - (not digit and kinds < 3)


class Value(NamedTuple):
    """The pieces of a value: literals (start, end), constants by name (name, place) or, in a chain of targets, by the
    place of the next one (None, place)."""

    pieces: list[tuple]
    first: int  # where its first piece ends
    end: int
    bare: bool


class Site(NamedTuple):
    place: int
    name: str
    value: Value


class Lexer:
    """Name-literal pairs of one text. No place of the text is read by more than a few values, so the time is linear."""

    def __init__(self, text: str):
        self.text = text
        self.sites: list[Site] = []
        self.unclosed: dict[str, tuple[int, int]] = {}  # from where to where a quote has no end
        self.named: dict[str, list[int]] = {}

    def string(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of the content of the literal at ``at``, and the place after it."""
        text, start = self.text, at
        while start < at + 2 and text[start : start + 1].isalpha():
            start += 1
        quote = text[start : start + 1]
        if quote not in ESCAPED:
            return None
        triple = text.startswith(quote * 3, start)
        kind = quote * (3 if triple else 1)
        since, until = self.unclosed.get(kind, (0, 0))
        if since <= start < until:
            return None
        if triple:
            end = text.find(kind, start + 3)
            if end >= 0:
                return start + 3, end, end + 3
            self.unclosed[kind] = start, len(text)
            return None
        m = ESCAPED[quote].match(text, start + 1)
        if m is not None:
            return start + 1, m.end() - 1, m.end()
        line = text.find("\n", start)
        self.unclosed[kind] = start, len(text) if line < 0 else line
        return None

    def value(self, at: int, bare: bool) -> Value | None:
        """The value that begins at ``at``: literals and names joined by +, a full stop or nothing. Bare words count if ``bare``."""
        text, pieces, quoted, loose, first, end = self.text, [], False, False, 0, at
        at = BLANK.match(text, at).end()
        chain = CHAIN.match(text, at)
        if chain is not None:
            return Value([(None, chain.start())], at, at, False)
        while True:
            found = self.string(at)
            if found is not None:
                start, stop, end = found
                pieces += self.parts(start, stop)
                quoted = True
            else:
                m = BARE.match(text, at)
                if m is None or text.startswith("(", m.end()):
                    break
                word = m.group()
                if word[-1] in "+." and text[m.end() : m.end() + 1] in ESCAPED and REFERENCE.match(word[:-1]):
                    word = word[:-1]
                reference = REFERENCE.match(word) is not None
                if quoted and not reference:
                    break
                end = at + len(word)
                if reference:
                    pieces.append((word, at))
                if bare and not quoted:
                    pieces.append((at, end))
                    loose |= not reference
            first = first or end
            at = BLANK.match(text, end).end()
            joined = text[at : at + 1]
            if joined in ("+", "."):
                at = BLANK.match(text, at + 1).end()
            elif not quoted or joined not in ESCAPED:
                break
        return Value(pieces, first, end, loose) if pieces else None

    def parts(self, start: int, stop: int) -> list[tuple]:
        """A literal's own text and the constants named inside it."""
        out: list[tuple] = []
        for m in INSERTED.finditer(self.text, start, stop):
            if m.start() > start:
                out.append((start, m.start()))
            out.append((m.group(1), m.start()))
            start = m.end()
        if stop > start:
            out.append((start, stop))
        return out

    def read(self) -> None:
        """Collect every assignment, in the order of the text."""
        text = self.text
        entry = None  # the name in a name/key entry that a value entry may follow
        taken = (0, 0)  # further pieces of the last value, where no assignment begins
        for m in SITE.finditer(text):
            name, op, at, place = m["name"], m["op"], m.end(), m.start("name")
            if taken[0] <= place < taken[1]:
                continue
            if op is None:
                value = None
                if m["close"] and m["tag"]:
                    end = text.find("<", at)
                    if end > at and text.startswith(f"</{name}>", end):
                        value = Value([(at, end)], end, end, False)
                elif m["dash"] and m["space"]:
                    value = self.value(at, True)
                self.add(place, name, value)
                continue
            if op == "," and not m["quote"]:
                continue
            typed = TYPE.match(text, at) if op == ":" else None
            value = self.value(typed.end() if typed else at, op != ",")
            if name.lower() in ("value", "content") and entry:
                name = entry
            entry = None
            if value is not None:
                if name.lower() in ("name", "key", "id"):
                    entry = "".join(text[s:e] for s, e in value.pieces if isinstance(s, int) and e - s < 200)
                taken = (at, value.end) if value.bare else (value.first, value.end)
            self.add(place, name, value)
        for m in URL.finditer(text):
            self.sites.append(Site(m.start(2), "password", Value([(m.start(2), m.end(2))], m.end(2), m.end(2), False)))

    def add(self, place: int, name: str, value: Value | None) -> None:
        if value is not None:
            self.named.setdefault(name.lstrip("$"), []).append(len(self.sites))
            self.sites.append(Site(place, name, value))

    def target(self, name: str | None, place: int) -> int | None:
        """The site that a piece stands for: the last assignment of the name before ``place``, or else the first after it."""
        if name is None:
            i = bisect_left(self.sites, place, key=lambda s: s.place, hi=self.n_ordered)
            return i if i < self.n_ordered and self.sites[i].place == place else None
        at = self.named.get(name.lstrip("$"))
        if not at:
            return None
        i = bisect_left(at, place, key=lambda s: self.sites[s].place)
        return at[i - 1] if i else at[0]

    def resolve(self) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
        """For each site, the sites that its pieces stand for and its own literals. A bare word that names a constant is no literal."""
        self.n_ordered = sum(len(x) for x in self.named.values())
        goes, own = [], []
        for s in self.sites:
            targets = {p: self.target(*p) for p in s.value.pieces if not isinstance(p[0], int)}
            known = {p[1] for p, t in targets.items() if t is not None}
            goes.append([t for t in targets.values() if t is not None])
            own.append([p for p in s.value.pieces if isinstance(p[0], int) and p[0] not in known])
        return goes, own

    def shapes(self, goes: list[list[int]], own: list[list[tuple[int, int]]], wanted: list[int]) -> dict[int, Shape]:
        """Shapes of the whole values of ``wanted`` sites; a constant that stands for itself adds nothing the second time."""
        done: dict[int, Shape] = {}
        for start in wanted:
            todo, opened = [start], set()
            while todo:
                i = todo[-1]
                if i in done:
                    todo.pop()
                elif i not in opened:
                    opened.add(i)
                    todo += [t for t in goes[i] if t not in done and t not in opened]
                else:
                    todo.pop()
                    done[i] = Shape()
                    for s, e in own[i]:
                        done[i].add(Shape(self.text[s:e].strip()))
                    for t in goes[i]:
                        if t in done and t != i:
                            done[i].add(done[t])
        return done

    def secrets(self) -> Iterator[tuple[int, int, str, int]]:
        """(start, end, target name, points) of every literal that is part of a secret: the best of its targets."""
        self.read()
        sounding = [i for i, s in enumerate(self.sites) if name_points(s.name) > 0]
        if not sounding:
            return
        goes, own = self.resolve()
        shapes = self.shapes(goes, own, sounding)
        scored = sorted((-name_points(self.sites[i].name) - shapes[i].points(), i) for i in sounding)
        found: dict[tuple[int, int], tuple[str, int]] = {}
        seen: set[int] = set()
        for minus, i in scored:
            if -minus < THRESHOLD:
                break
            todo = [i]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                for span in own[at]:
                    found.setdefault(span, (self.sites[i].name, -minus))
                todo += goes[at]
        for (start, end), (name, points) in sorted(found.items()):
            if end > start:
                yield start, end, name, points


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,points:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("points", pa.int32())]))


def scan(text: str) -> list[dict]:
    """All spans of one text by start, then kind in the order of ``KINDS``."""
    out = [{"kind": k, "start": s, "end": e, "name": None, "points": None} for k, s, e in base_spans(text)]
    out += [{"kind": KINDS[3], "start": s, "end": e, "name": n, "points": p} for s, e, n, p in Lexer(text).secrets()]
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


# What a text must hold for one of the patterns, or for a pair of the lexer that scores, to be found in it. Looked for in whole
# columns at once, so that only texts that may have spans are read in Python.
_WORD = "(pass|pwd|secret|credential|key|token|bearer|auth|pw|pin|salt|cert|signature|session|cookie|login|connection|dsn)"
_NAME = r"[A-Za-z0-9_$.\-]*"
MAY_HOLD = "|".join(
    [
        r"""(?i:(password|passwd|secret|token|api_?key)["']? *[:=])""",
        "AKIA[A-Z0-9]{12}",
        "[0-9a-f]{32}",
        rf"""(?i:{_WORD}{_NAME}(["']\])?["']?[ \t]*(\+?=|:|<-|,[ \t]*["']))""",
        rf"(?i:<{_NAME}{_WORD}{_NAME}>)",
        rf"(?i:--{_NAME}{_WORD}{_NAME}[ \t])",
        r"""(?i:(value|content)["']?[ \t]*(\+?=|:|<-))""",
        "://",
    ]
)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row (doc_id, spans) per row of ``docs``: spans in code points, end exclusive, with the target name and points of
    those that the lexer found (kind ``literal``).

    A null text counts as empty and has no spans; rows without doc_id are left out; rows that repeat a doc_id are scanned
    each for itself; other columns are ignored whatever their names. Texts of any length are read whole, one at a time; an
    empty table gives an empty result. Two kinds may begin at one place (both stay); the lexer gives one span once, with the
    target that scores highest, the earlier of equals. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            may = pc.match_substring_regex(texts, MAY_HOLD).to_numpy(zero_copy_only=False)
            spans = [scan(texts[i].as_py()) if m else [] for i, m in enumerate(may)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return common.id_text(docs).mapInArrow(run, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the text of all spans."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` (all columns) with every span of its text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                text = batch.column(at)[i].as_py()
                texts.append(None if text is None else masked(text, mark))
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return common.map_rows(docs, run)


def masked(text: str, mark: str) -> str:
    out, done = [], 0
    for s in scan(text):
        if s["start"] >= done:
            out += [text[done : s["start"]], mark]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])
