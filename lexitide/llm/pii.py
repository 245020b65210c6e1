"""Personal data by bootstrapped contextual extraction.

Fixed expressions find emails, IP addresses, card and phone numbers; these are the seed entities. Then words around them
become patterns, and patterns find entities that no expression knows:

1. A pattern is a side and a *cue* of one to three words that stands there. Its confidence is the share of all occurrences
   of the cue in the corpus that stand beside an entity; it must have `SUPPORT` distinct entities and `CONFIDENCE`.
2. Whatever word stands beside a confident cue, and whatever run of up to three words between two, is an *instance*.
   The best cue on each side vouches for it (noisy or); a place vouched for to `VOUCHED` is personal data.
3. An instance vouched for so over all its places becomes an entity, whose other places are personal data too and support
   further patterns. One that may be an ordinary word (no digit, or under four characters) must have at least
   `CONFIDENCE` of all its occurrences in such places. Steps 1 to 3 go on until no entity is added.
4. Places of entities and places vouched for are spans of kind `context`.

A cue's occurrences are counted over the whole corpus, so common words, which stand beside anything, have no confidence.
Texts are never shuffled: each step scans them for hashes of cues or instances, first in a bitmap of fixed size, then by a
join that drops what only the bitmap took.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import stored
from lexitide.llm.textarrays import Spans, Words, slices

BASE = ("email", "ip", "card", "phone")
CONTEXT = "context"
SUPPORT, CONFIDENCE, VOUCHED = 5, 0.5, 0.7
LONGEST = 3  # words of a cue, and of an instance
_BITS = 22

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits fails where the run's own match failed, so runs are tried at their start.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>,;:!?.*#&%$|="
_EDGES = np.isin(np.arange(256), list(_EDGE.encode()))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` of seed entities in order of start, then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the run of local-part characters before the sign, back to the last match
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _lower(word: str) -> str:
    return word.encode().lower().decode()


def seed_cues(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[str], list[str]]]:
    """`(instance, cues before, cues after)` of seeds; cues are the one to three words beside it."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]

    def cue(i: int, j: int) -> str:
        return " ".join(_lower(text[a:b]) for a, b in words[i:j])

    out = []
    for start, _, end in spans:
        first = int(np.searchsorted(starts, start, side="right")) - 1
        last = int(np.searchsorted(starts, end - 1, side="right"))
        before = [cue(first - g, first) for g in range(1, min(LONGEST, first) + 1)]
        after = [cue(last, last + g) for g in range(1, min(LONGEST, len(words) - last) + 1)]
        out.append((_lower(text[start:end]), before, after))
    return out


_SPANS = "ARRAY<STRUCT<start: INT, kind: INT, end: INT>>"
_SEEN = "ARRAY<STRUCT<instance: STRING, before: ARRAY<STRING>, after: ARRAY<STRING>>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEEN_TYPE = pa.list_(pa.struct([("instance", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, fields = ("start", "kind", "end"), ("instance", "before", "after")
    for batch in batches:
        base, seen = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([dict(zip(names, s, strict=True)) for s in spans])
            seen.append([dict(zip(fields, c, strict=True)) for c in seed_cues(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(base, _SPAN_TYPE), pa.array(seen, _SEEN_TYPE)], ["doc_id", "text_key", "base", "seen"])


# ---- scans for hashes of word runs


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which leading bits of keys occur; its size is fixed, and a full one only lets more through to the joins."""
    held = keys.select(F.shiftrightunsigned("key", 64 - _BITS).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()
    bits = np.zeros(1 << _BITS, bool)
    bits[held] = True
    return np.packbits(bits)


class Runs:
    """Words of a column with hashes of their runs; `plain` strips punctuation from the edges of every word."""

    def __init__(self, column: pa.Array, plain: bool = False):
        self.words = w = Words(column, lower=True)
        self.start, self.end = w.start, w.end
        if plain:
            w.start, w.end = w.start.copy(), w.end.copy()
            for at, step, place in ((w.start, 1, 0), (w.end, -1, -1)):
                left = np.arange(len(w))
                while len(left):
                    left = left[(w.start[left] < w.end[left]) & _EDGES[w.data[np.minimum(at[left] + place, len(w.data) - 1)]]]
                    at[left] += step
        self.spans = Spans(w.hashes())

    def keys(self, g: int, at: np.ndarray) -> np.ndarray:
        return self.spans(at, at + g)

    def starts(self, g: int) -> np.ndarray:
        """First words of all runs of `g` words within a text."""
        at = np.arange(max(0, len(self.words) - g + 1))
        return at[self.words.row[at] == self.words.row[at + g - 1]]


def _held(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
    return (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _run_counts(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """`(key, n)` of runs of up to `LONGEST` words whose hash may be wanted."""
    for batch in batches:
        for part in slices(batch, "text"):
            runs = Runs(part.column("text"))
            keys = [runs.keys(g, runs.starts(g)) for g in range(1, LONGEST + 1)]
            h, n = np.unique(np.concatenate([k[_held(k, bits)] for k in keys]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["key", "n"])


def _cue_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = Words(batch.column("cue"))
        h = Spans(w.hashes())(w.first[:-1], w.first[1:])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "key"])


_PLACE = "text_key LONG, start INT, end INT, words INT, key LONG, sure BOOLEAN, before ARRAY<LONG>, after ARRAY<LONG>"
_PLACE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _places(batches: Iterator[pa.RecordBatch], instances: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of words outside seed spans with their cues: those that may be one of `instances`, or stand beside cues.

    A single word needs a cue before or after it that may be wanted, a longer run both. `sure` runs hold a digit and four
    characters or more, so they are no ordinary words.
    """
    names = ["doc_id", *(c.split()[0] for c in _PLACE.replace("ARRAY<LONG>", "LONG").split(", "))]
    for batch in batches:
        for part in slices(batch, "text"):
            runs, plain = Runs(part.column("text")), Runs(part.column("text"), plain=True)
            row, n = runs.words.row, len(runs.words)
            cues = {}
            for side in ("before", "after"):
                for g in range(1, LONGEST + 1):
                    at = runs.starts(g)
                    key = np.zeros(n + 1, np.uint64)
                    real = np.zeros(n + 1, bool)
                    # by the word next to the cue: the one that follows it, or the one that it follows
                    beside = at + g if side == "before" else at
                    key[beside], real[beside] = runs.keys(g, at), True
                    cues[side, g] = key, real
            wanted = {s: np.zeros(n + 1, bool) for s in ("before", "after")}
            for side, bits in (("before", before), ("after", after)):
                for g in range(1, LONGEST + 1) if bits is not None else ():
                    key, real = cues[side, g]
                    wanted[side] |= real & _held(key, bits)
            out = []
            for g in range(1, LONGEST + 1):
                at = runs.starts(g)
                if instances is not None:
                    at = at[_held(plain.keys(g, at), instances)]
                else:
                    # a cue belongs to the text of the run
                    left = wanted["before"][at] & (at > 0) & (row[at] == row[np.maximum(at - 1, 0)])
                    right = wanted["after"][at + g] & (at + g < n) & (row[at] == row[np.minimum(at + g, n - 1)])
                    at = at[left | right] if g == 1 else at[left & right]
                out += [(int(i), g) for i in at]
            if not out:
                continue
            texts, keys_part = part.column("text"), part.column("text_key")
            lead = np.r_[0, np.cumsum((runs.words.data & 0xC0) != 0x80)]
            origin = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))]
            seeds: dict[int, list] = {}
            rows = []
            for i, g in out:
                r = int(row[i])
                a, b = int(plain.words.start[i]), int(plain.words.end[i + g - 1])
                if a >= b or any(plain.words.start[k] >= plain.words.end[k] for k in range(i, i + g)):
                    continue
                if r not in seeds:
                    seeds[r] = base_spans(texts[r].as_py())
                first, last = int(lead[runs.start[i]] - lead[origin[r]]), int(lead[runs.end[i + g - 1]] - lead[origin[r]])
                if any(s < last and e > first for s, _, e in seeds[r]):
                    continue
                own = [[int(cues[side, k][0][x].view(np.int64)) for k in range(1, LONGEST + 1) if cues[side, k][1][x] and fit(k)] for side, x, fit in (
                    ("before", i, lambda k: i >= k and row[i - k] == r), ("after", i + g, lambda k: i + g + k <= n and row[i + g + k - 1] == r))]
                start, end = int(lead[a] - lead[origin[r]]), int(lead[b] - lead[origin[r]])
                sure = end - start >= 4 and bool(_DIGITS[runs.words.data[a:b]].any())
                rows.append((part.column("doc_id")[r], keys_part[r].as_py(), start, end, g, int(plain.keys(g, np.array([i]))[0].view(np.int64)), sure, *own))
            ids = pa.array([x[0].as_py() for x in rows], part.column("doc_id").type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[k + 1] for x in rows], t) for k, t in enumerate(_PLACE_TYPES)]], names)


# ---- the bootstrap


def _noisy_or(confidence):
    return 1 - F.exp(F.sum(F.log(1 - confidence)))


def bootstrap(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """`(doc_id, text_key, start, end)` of what cues find; `seen(instance, before, after)` has a row per seed, `docs` has `text_key`."""
    place = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_PLACE}"

    def scan(**bits):
        return docs.mapInArrow(lambda it: _places(it, **bits), place)

    sides = [seen.select(F.lit(s).alias("side"), F.explode(s).alias("cue"), F.xxhash64("instance").alias("instance")) for s in ("before", "after")]
    seeds = sides[0].unionByName(sides[1]).groupBy("side", "cue", "instance").agg(F.count("*").alias("n"))
    typed = "side STRING, cue STRING, instance LONG, n LONG, key LONG"
    edges = stored(seeds.mapInArrow(_cue_keys, typed).select("side", "key", "instance", "n", F.lit(1.0).alias("trust")), "pattern-edges")
    known = totals = spans = None
    while True:
        # occurrences in the corpus of cues that entities give enough support; those counted in an earlier round stand
        sums = edges.groupBy("side", "key").agg(F.sum(F.col("n") * F.col("trust")).alias("hits"), F.count_distinct("instance").alias("support")).where(F.col("support") >= SUPPORT)
        likely = sums.select("key").distinct()
        likely = likely if totals is None else likely.join(totals, "key", "left_anti")
        bits = _bitmap(likely)
        if bits.any():
            counted = docs.select("text").mapInArrow(lambda it, b=bits: _run_counts(it, b), "key LONG, n LONG").groupBy("key").agg(F.sum("n").alias("total"))
            counted = counted.join(likely, "key", "left_semi")
            totals = stored(counted if totals is None else totals.unionByName(counted), "cue-counts")
        if totals is None:
            break
        good = sums.join(totals, "key").withColumn("confidence", F.least(F.lit(0.999), F.col("hits") / F.col("total"))).where(F.col("confidence") >= CONFIDENCE)
        good = stored(good.select("side", "key", "confidence"), "patterns")
        if good.isEmpty():
            break
        beside = stored(scan(before=_bitmap(good.where("side = 'before'")), after=_bitmap(good.where("side = 'after'"))), "beside")
        at = ["doc_id", "text_key", "start", "end", "words", "key", "sure"]
        cues = [beside.select(*at, F.lit(s).alias("side"), F.explode(s).alias("cue")) for s in ("before", "after")]
        best = cues[0].unionByName(cues[1]).join(good.withColumnRenamed("key", "cue"), ["side", "cue"])
        best = stored(best.groupBy(*at, "side").agg(F.max_by(F.struct("confidence", "cue"), F.struct("confidence", "cue")).alias("by")), "vouching")
        vouched = best.groupBy(*at).agg(_noisy_or(F.col("by.confidence")).alias("trust"), F.count("*").alias("sides")).where((F.col("words") == 1) | (F.col("sides") == 2))
        vouched = stored(vouched, "vouched")
        spans = vouched.where(F.col("trust") >= VOUCHED).select("doc_id", "text_key", "start", "end")
        single = best.join(vouched.select("key").distinct(), "key", "left_semi").select("key", "sure", "side", "by").distinct()
        able = single.groupBy("key").agg(_noisy_or(F.col("by.confidence")).alias("trust"), F.max("sure").alias("sure")).where(F.col("trust") >= VOUCHED)
        able = able.join(vouched.groupBy("key").agg(F.count("*").alias("inside")), "key")
        able = stored(able if known is None else able.join(known.select("key"), "key", "left_anti"), "able")
        bits = _bitmap(able)
        if not bits.any():
            break
        found = scan(instances=bits).join(able.select("key", "trust", F.col("sure").alias("always"), "inside"), "key")
        # of rows that repeat, places count once in both
        found = stored(found.dropDuplicates(["doc_id", "text_key", "start", "end", "key"]), "occurrences")
        share = found.groupBy("key").agg((F.max("inside") / F.count("*")).alias("share"))
        fresh = stored(found.join(share, "key").where(F.col("always") | (F.col("share") >= CONFIDENCE)).select("doc_id", "text_key", "start", "end", "key", "trust", "before", "after"), "entities")
        if fresh.isEmpty():
            break
        known = stored(fresh if known is None else known.unionByName(fresh), "known")
        more = [fresh.select(F.lit(s).alias("side"), F.explode(s).alias("cue"), "key", "trust") for s in ("before", "after")]
        more = more[0].unionByName(more[1]).groupBy("side", "cue", "key").agg(F.count("*").alias("n"), F.max("trust").alias("trust"))
        more = more.select("side", F.col("cue").alias("key"), F.col("key").alias("instance"), "n", "trust")
        edges = stored(edges.unionByName(more), "pattern-edges")
    none = docs.select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    for part in (spans, known):
        none = none if part is None else none.unionByName(part.select("doc_id", "text_key", "start", "end"))
    return none.distinct()


def _personal(docs: DataFrame) -> DataFrame:
    """`(doc_id, text_key, base, found)` for every row: seed spans, and all spans."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = stored(base.mapInArrow(_find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key LONG, base {_SPANS}, seen {_SEEN}"), "spans")
    seen = rows.where(F.size("seen") > 0).select(F.explode("seen").alias("s")).select("s.*")
    more = bootstrap(seen, base).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", F.lit(len(BASE)).alias("kind"), "end")).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    same = rows["doc_id"].eqNullSafe(more["other_id"]) & (rows["text_key"] == more["other_key"])
    found = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))
    return rows.join(more, same, "left").select("doc_id", "text_key", "base", found.alias("found"))


def _listing(found):
    kinds = F.array(*[F.lit(k) for k in (*BASE, CONTEXT)])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """`(doc_id, text_key, found, n_email, n_ip, n_card, n_phone, base_sha256, spans)` for every row of `docs(doc_id, text)`.

    `found` lists `(start, kind, end)` by start, then kind (place in `BASE`, then `context`); `spans` spells it out as
    `kind:start:end`. Places count code points, the end is exclusive. A null text is empty. Rows that share id and text
    share their result; a null id is an id like any other; an empty table gives an empty result. Other columns of `docs`
    play no part.
    """
    rows = _personal(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return rows.select("doc_id", "text_key", "found", *counts, F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.col("found")).alias("spans"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"[{k.upper()}]" for k in (*BASE, CONTEXT)]
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            if text and found:
                parts, at = [], 0
                for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], names[s["kind"]]]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "clean_text"])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of personal data in `text` replaced by its kind in brackets; overlapping spans count as one.

    Every row stays, null texts stay null, and the other columns stay as they are (`n_chars` is that of the original).
    """
    rows = _personal(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key"), "found")
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = packed["doc_id"].eqNullSafe(rows["other_id"]) & (packed["text_key"] == rows["other_key"])
    joined = packed.join(rows, same, "left").select("row", "text", "found")
    done = joined.mapInArrow(_redact, f"row {packed.schema['row'].dataType.simpleString()}, clean_text STRING")
    return done.select("row.*", F.col("clean_text").alias("text")).select(*[f"`{c}`" for c in docs.columns])
