"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Four kinds are found by pattern, leftmost and without overlaps. They are the seeds: the
words around them induce lexical patterns, and a graph of patterns and instances (tokens
that hold a digit or an @) is scored in rounds. A pattern is as good for a kind as its
distinct instances are, an instance as its patterns together; instances that score high
enough and overlap no seed become spans of that kind. All states are small rows of
candidates and are checkpointed; a hot context is summed up before it is shuffled.

Patterns run on a marked copy of equal length, in which a separator between two fitting
characters has a mark of its own: repeated groups become plain character classes, so
texts of any length and any run of digits or dots are safe.

Null texts count as empty. Positions are code points, ends exclusive. Repeated rows get
equal results; null ids are kept. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut_lineage, row_key

KINDS = ["email", "ip", "card", "phone"]
#: Marks of a dot inside a domain and of a separator between digits; taken out of the text first.
DOT, GAP = "\ue000", "\ue001"
ROUNDS = 3
#: A pattern needs so many distinct instances, and an instance this score.
SUPPORT, LEAST_SCORE, LEAST_CONFIDENCE = 3, 0.8, 0.5
CONTEXT = 60


def _fresh(characters: str) -> str:
    """Where a run of the characters begins, or the last match has ended.

    From a later place of a run that does not fit, nothing fits either; without this each
    place would read the rest of the run again.
    """
    return rf"(?:\G|(?<![{characters}]))"


def _marked(text: Column, kind: str) -> tuple[Column, str]:
    """A copy of equal length and the pattern that finds the kind in it."""
    clean = F.translate(text, DOT + GAP, "  ")
    if kind == "email":
        return (F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT),
                rf"{_fresh(f'A-Za-z0-9.{DOT}_%+-')}[A-Za-z0-9.{DOT}_%+-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]+")
    if kind == "ip":
        return clean, rf"{_fresh('0-9')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    if kind == "card":
        return F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", GAP), rf"[0-9][0-9{GAP}]+"
    if kind == "phone":
        return clean, r"\+[0-9][ ().0-9-]+[0-9]"
    return clean, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: (
        F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _holds(kind: Column, found: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    digits = _digits(found)
    n = F.length(digits)
    small = F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (
        F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "ip", small).when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).when(
        kind == "phone", n.between(9, 15)).otherwise(True)


def matches(rows: DataFrame) -> DataFrame:
    """(_k1, _k2, kind, start, end, found, left, right) of (_k1, _k2, text), for each kind and ``token``."""
    arrays = []
    for kind in [*KINDS, "token"]:
        marked, pattern = _marked(F.col("text"), kind)
        gate = F.lit(True) if kind == "token" else F.contains("text", F.lit({"email": "@", "phone": "+"}[kind])) if kind in (
            "email", "phone") else F.col("text").rlike("[0-9]")
        both = F.transform(F.array(marked), lambda m: F.struct(
            F.regexp_extract_all(m, F.lit(pattern), F.lit(0)).alias("hit"), F.split(m, pattern, -1).alias("gap")))
        found = F.flatten(F.transform(both, lambda b: F.transform(b["hit"], lambda h, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), h.alias("found"), F.length(F.get(b["gap"], i)).alias("gap"),
            F.right(F.get(b["gap"], i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get(b["gap"], i + 1), F.lit(CONTEXT)).alias("right")))))
        arrays.append(F.when(gate, found).otherwise(F.array().cast(
            "array<struct<kind:string,i:int,found:string,gap:int,left:string,right:string>>")))
    exploded = rows.where(F.col("text").rlike("[0-9@]")).select("_k1", "_k2", F.explode(F.concat(*arrays)).alias("m")).select(
        "_k1", "_k2", "m.*").dropDuplicates(["_k1", "_k2", "kind", "i"])
    upto = Window.partitionBy("_k1", "_k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    return exploded.withColumn("end", end).select(
        "_k1", "_k2", "kind", (F.col("end") - F.length("found")).alias("start"), "end",
        F.translate("found", DOT + GAP, ".-").alias("found"), "left", "right")


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[0-9]+", "0"))


def candidates(found: DataFrame) -> DataFrame:
    """Tokens with their trimmed span, instance text, patterns, and the kind of a seed that they overlap."""
    base = found.where(F.col("kind") != "token").select("_k1", "_k2", "start", "end", F.col("kind").alias("seed"))
    token = found.where(F.col("kind") == "token")
    lead = F.length("found") - F.length(F.regexp_replace("found", r"^[^0-9A-Za-z+]+", ""))
    inst = F.regexp_replace(F.regexp_replace("found", r"^[^0-9A-Za-z+]+", ""), r"[^0-9A-Za-z]++$", "")
    token = token.withColumns({"start": F.col("start") + lead, "inst": inst}).withColumn("end", F.col("start") + F.length("inst"))
    before = _word(F.regexp_extract("left", r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    near = _word(F.regexp_extract("left", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    after = _word(F.regexp_extract("right", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    token = token.where(F.length("inst") > 2).select(
        "_k1", "_k2", "start", "end", F.lit(None).cast("string").alias("seed"), "inst",
        F.array_compact(F.array(F.when(before != "", F.concat(F.lit("l:"), before)), F.when(
            (near != "") & (after != ""), F.concat(F.lit("m:"), near, F.lit(" * "), after)))).alias("patterns"))
    both = token.unionByName(base, allowMissingColumns=True)
    place = Window.partitionBy("_k1", "_k2").orderBy("start")
    earlier = F.max(F.when(F.col("seed").isNotNull(), F.struct("end", "seed"))).over(place.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(F.col("seed").isNotNull(), F.struct("start", "seed"))).over(place.rangeBetween(0, Window.unboundedFollowing))
    return both.withColumns({"_e": earlier, "_l": later}).where(F.col("inst").isNotNull()).withColumn("seed", F.when(
        F.col("_e.end") > F.col("start"), F.col("_e.seed")).when(F.col("_l.start") < F.col("end"), F.col("_l.seed"))).drop("_e", "_l")


def bootstrap(tokens: DataFrame) -> DataFrame:
    """(inst, kind): unseen instances that the patterns of the seeds accept."""
    edges = cut_lineage(tokens.select("inst", F.explode("patterns").alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= SUPPORT)
    edges = cut_lineage(edges.join(size, "pattern"))
    seeds = cut_lineage(tokens.where(F.col("seed").isNotNull()).groupBy("inst", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score")))
    scores = seeds
    for _ in range(ROUNDS):
        good = edges.join(scores, "inst").groupBy("pattern", "kind").agg(
            (F.sum("score") / F.first("size")).alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        found = edges.select("inst", "pattern").join(good, "pattern").groupBy("inst", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("score")).where(F.col("score") >= LEAST_SCORE)
        fresh = found.join(seeds.select("inst"), "inst", "left_anti")
        scores = cut_lineage(seeds.unionByName(fresh))
    fresh = scores.join(seeds.select("inst"), "inst", "left_anti")
    return fresh.groupBy("inst").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("best")).select("inst", F.col("best.kind").alias("kind"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    found = matches(docs)
    found = cut_lineage(found.where(_holds(F.col("kind"), F.col("found"))))
    tokens = cut_lineage(candidates(found))
    accepted = tokens.where(F.col("seed").isNull()).join(bootstrap(tokens), "inst").select("_k1", "_k2", "kind", "start", "end", F.lit(False).alias("base"))
    all_spans = found.where(F.col("kind") != "token").select("_k1", "_k2", "kind", "start", "end", F.lit(True).alias("base")).unionByName(accepted)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i + 1)) for i, k in enumerate(KINDS)])
    span = F.struct(rank.alias("k"), "start", "end")
    per_doc = all_spans.groupBy("_k1", "_k2").agg(
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), True)).alias(f"n_{k}") for k in KINDS],
        F.collect_set(F.when(F.col("base"), span)).alias("b"), F.collect_set(span).alias("a"))
    out = docs.select("doc_id", "_k1", "_k2").join(per_doc, ["_k1", "_k2"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce(_joined(F.col("b")), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(_joined(F.col("a")), F.lit("")).alias("spans"))
