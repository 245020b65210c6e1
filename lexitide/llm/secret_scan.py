"""Find secrets by rules through a trigram inverted index, with DataFrame operations only.

Each rule's regular expression gives a Boolean query of trigrams that any match contains (`trigrams`). The index holds,
for each trigram that some rule asks for, the documents that contain it. Intersecting and uniting postings leaves the
candidate documents of each rule, and only those are matched against its expression. A rule without mandatory trigrams
(a run of hexadecimal digits) is matched against all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import let
from lexitide.llm.trigrams import derive, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group of a match, if it has one."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The first three kinds are the contract's. A run of 24 or more characters of a class is the same as a run of any length
# that has 24 or more, which spares listing short ones.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/@]{3,100}@"),
)


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index for the wanted trigrams: `(doc_id, text_key, trigram)`, texts in lower case."""
    text = F.lower(F.coalesce("text", F.lit("")))
    there = let(text, lambda t: F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(t, w)))
    return docs.select("doc_id", "text_key", F.explode(there).alias("trigram"))


def _holds(query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(q, held) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`(doc_id, text_key, kinds)`: the documents whose trigrams satisfy the queries of `kinds`."""
    queries = {r.kind: derive(r.pattern) for r in rules}
    wanted = list(dict.fromkeys(t for q in queries.values() for t in trigrams(q)))
    held = postings(docs, wanted).groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("held")), F.lit(k)) for k, q in queries.items() if q is not None]))
    return held.select("doc_id", "text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(rule: Rule, order: int, text: Column) -> Column:
    """Matches of a rule in order, each with the length of the text before it (since the last) and its own."""

    def with_gaps(found: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        long = let(groups, lambda g: F.transform(g, lambda x: F.length(x) >= rule.least))
        return let(
            F.struct(gaps.alias("gaps"), long.alias("long")),
            lambda s: F.transform(
                found,
                lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(F.get(s["gaps"], i)).alias("gap"), F.length(x).alias("size"), F.get(s["long"], i).alias("ok")),
            ),
        )

    kind = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"
    none = F.array().cast(kind)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, with_gaps(m).cast(kind)).otherwise(none))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(doc_id, text_key, found)` for every row of `docs(doc_id, text)`; `text_key` is `xxhash64(text)`.

    `found` lists `(start, kind, end)` in order of start, then of the rules; `kind` is the rule's place in `rules`; places
    count code points, the end is exclusive. Matches of one rule are leftmost and don't overlap; those whose group is too
    short are dropped. A null text is empty. Rows with one id and text have one result, repeated; rows with null ids are
    kept; an empty table gives an empty result. Other columns of `docs` play no part.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    likely = candidates(base, rules).withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    same = base["doc_id"].eqNullSafe(likely["other_id"]) & (base["text_key"] == likely["other_key"])
    asked = base.join(likely, same, "left").drop("other_id", "other_key")
    kind = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"
    arrays = []
    for k, rule in enumerate(rules):
        matched = _matches(rule, k, F.col("text"))
        free = derive(rule.pattern) is None
        arrays.append(matched if free else F.when(F.array_contains("kinds", rule.kind), matched).otherwise(F.array().cast(kind)))
    each = asked.select("doc_id", "text_key", F.concat(*arrays).alias("all"))
    hit = each.where(F.size("all") > 0).dropDuplicates(["doc_id", "text_key"])
    hit = hit.select("doc_id", "text_key", F.explode("all").alias("m")).select("doc_id", "text_key", "m.*")
    before = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hit.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int")).where("ok")
    spans = placed.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))).alias("found"))
    spans = spans.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    same = whole["doc_id"].eqNullSafe(spans["other_id"]) & (whole["text_key"] == spans["other_key"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return whole.join(spans, same, "left").select("doc_id", "text_key", F.coalesce("found", none).alias("found"))


def listing(found: Column, kinds: tuple[str, ...]) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
